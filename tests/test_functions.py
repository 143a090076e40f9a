"""Column functions on good, odd, empty and null values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomwork.functions import parsing, text


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_numbers(spark):
    rows = [("3.5",), (" 7 ",), ("-",), ("",), ("1_0",), ("x",), (None,)]
    assert values(spark, rows, "x string", parsing.safe_number(F.col("x"))) == [3.5, 7.0, None, None, None, None, None]
    assert values(spark, [("a 12.5mm",), ("none",), (None,)], "x string", parsing.number_in(F.col("x"))) == [12.5, None, None]
    assert values(spark, [("12 mil",), ("12 um",)], "x string", parsing.value_with_unit(F.col("x"), "mil")) == [12.0, None]


def test_die_geometry(spark):
    rows = [("X/30/*40 MIL", "9 x 9", "t 5"), ("X", " 3 X 4 ", None), ("X", "5", "x"), ("A/12mil/B", "-", "1"), ("A/5mil/B", "-", "1"), (None, None, None)]
    got = values(spark, rows, "d string, r string, t string", parsing.die_geometry(F.col("d"), F.col("r"), F.col("t")))
    assert [tuple(g) for g in got] == [(30, 40, 50, 5), (3, 4, 5, None), (5, 5, 7.0711, None), (12, 12, 16.9706, 1), (None, None, None, 1), (None,) * 4]


def test_descriptions(spark):
    wafer = values(spark, [("A/CHIP/1/2/3/4/5",), ("A/odd/1/2/3/4/5",), ("/CHIP/1/2/3/4/5",), ("A/B1/ c /2/3/4/5",), ("A/B",)], "x string", parsing.wafer_description(F.col("x")))
    assert [w and w.size for w in wafer] == ["1", None, None, "c", None]
    frames = values(spark, [("LF/P/HD/x/Ag/V",), ("LF/P/std/Ag/V",), ("XX/P/std/Ag/V",), ("LF/P",)], "x string", parsing.leadframe_description(F.col("x")))
    assert [f and (f.option, f.plating, f.vendor) for f in frames] == [("HD x", "Ag", "V"), ("std", "Ag", "V"), None, None]
    wires = values(spark, [("WIRE/1.2 mil/Au/V",), ("WIRE/8/Cu/V",), ("CLIP/3 mil/Cu/V",), ("W/x",)], "x string", parsing.wire_description(F.col("x")))
    assert [w and (w.diameter, w.is_clip) for w in wires] == [("1.2", False), ("8", False), ("", True), None]
    rows = [("WIRE/1 mil/Au/V", "WIR"), ("LF/P/std/Ag/V", None), ("what", "ZZZ"), ("A", "WAF"), (None, None)]
    found = values(spark, rows, "x string, k string", parsing.described(F.col("x"), F.col("k")))
    assert [(f.parser, f.success, f.error) for f in found] == [("WIR", True, None), ("LEF", True, None), (None, False, "unknown kind"), ("WAF", False, "unexpected shape"), (None, False, "unknown kind")]


def test_codes(spark):
    tables = {"package": {"ABCDEF": "p"}, "vendor": {"v": "V"}}
    rows = [("abcdef-1-22-33-4444-v",), ("abcdef-1-22-33-4444-V",), ("abc-1-22-33-4444-v",), ("nonsense",)]
    got = values(spark, rows, "x string", parsing.six_segments(F.col("x"), tables))
    assert [(g.success, g.package, g.vendor, len(g.errors)) for g in got] == [(True, "p", "V", 4), (True, "p", "UNKNOWN: V", 5), (False, "UNKNOWN: abc", "V", 5), (False, None, None, 1)]
    diff = values(spark, [("a-1-2-3-4-5", "a-1-9-3-4-5")], "a string, b string", parsing.code_differences(F.col("a"), F.col("b")))
    assert [tuple(d) for d in diff[0]] == [("die", "2", "9")]
    table = [("EP1", ["EPOXY", "RESIN"]), ("SI1", ["SILICON"])]
    assert values(spark, [("silicon epoxy",), ("Silicone",), ("x",), (None,)], "x string", parsing.first_code(F.col("x"), table)) == ["EP1", "SI1", None, None]


def test_confidence(spark):
    rows = [("high",), ("0.90",), ("0.60",), ("0.30",), ("LOW",), (None,)]
    assert values(spark, rows, "x string", parsing.confidence_label(F.col("x"))) == ["high", "high", "medium", "low", "low", None]
    with pytest.raises(Exception, match="not a confidence"):
        values(spark, [("1.20",)], "x string", parsing.confidence_label(F.col("x")))


def test_answers_and_delays(spark):
    rows = [("ok done",), ("checked 3 rows; null rate 0%; duplicate count 0",), (None,), ("none",)]
    assert values(spark, rows, "x string", parsing.low_signal(F.col("x"))) == [True, False, True, True]
    assert values(spark, [(1,), (3,)], "x int", parsing.backoff_seconds(F.col("x"), "exponential")) == [1.0, 4.0]


def test_tokens_and_scores(spark):
    assert values(spark, [("The Cat of 漢字 cat_1",), ("",), (None,)], "x string", text.target_tokens(F.col("x"))) == [["cat", "cat_1", "漢", "字"], [], None]
    rows = [("red ring", "red ring big"), ("red ring", "ring red"), ("a", "the"), ("one two", "three four")]
    assert values(spark, rows, "a string, b string", F.round(text.conflict_score(F.col("a"), F.col("b")), 4)) == [0.6667, 1.0, 0.0, 0.0]
    vectors = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])]
    assert values(spark, vectors, "a array<float>, b array<float>", text.cosine(F.col("a"), F.col("b"))) == [1.0, 0.0, 0.0]


def test_markdown(spark):
    body = "## One\nfirst\n\n## Two \n- none.\n- real question?\n* N/A\n## Three\n"
    assert values(spark, [(body,)], "x string", text.markdown_section(F.col("x"), "One")) == ["first"]
    assert values(spark, [(body,)], "x string", text.markdown_section(F.col("x"), "Four")) == [None]
    assert values(spark, [(body,)], "x string", text.open_questions(F.col("x"))) == [["real question?"]]
    assert values(spark, [("<!-- status=active refs=A|B -->",)], "x string", text.meta_pairs(F.col("x"))) == [{"status": ["active"], "refs": ["A", "B"]}]
    assert values(spark, [("a-b  'c'",)], "x string", text.text_match_query(F.col("x"))) == ["a b c"]


def test_dates(spark):
    d = dt.date
    rows = [(d(2024, 1, 30), d(2024, 3, 2)), (d(2024, 1, 2), d(2024, 1, 2))]
    months = values(spark, rows, "a date, b date", text.date_chunks(F.col("a"), F.col("b"), None))
    assert [tuple(x) for x in months[0]] == [(d(2024, 1, 30), d(2024, 1, 31)), (d(2024, 2, 1), d(2024, 2, 29)), (d(2024, 3, 1), d(2024, 3, 1))] and months[1] == []
    days = values(spark, [(d(2024, 1, 1), d(2024, 1, 6))], "a date, b date", text.date_chunks(F.col("a"), F.col("b"), 2))
    assert [tuple(x) for x in days[0]] == [(d(2024, 1, 1), d(2024, 1, 3)), (d(2024, 1, 3), d(2024, 1, 5)), (d(2024, 1, 5), d(2024, 1, 6))]
    ages = values(spark, [(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 4, 12))], "a timestamp, b timestamp", text.age_days(F.col("a"), F.col("b")))
    assert ages == [3.5]
