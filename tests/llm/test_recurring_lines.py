"""Lines that recur as they are or as templates, on planted lines."""

from loomwork.llm import line_dedup
from loomwork.llm.line_dedup import dedup_lines

SCHEMA = "doc_id long, text string, n_lines string"


def dropped(spark, texts, **settings):
    """Documents that lost each line, by the line."""
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, SCHEMA), **settings).collect()}
    assert len(got) == len(rows)
    out = {}
    for k, t, _ in rows:
        left = got[k].text.split("\n")
        assert got[k].n_lines == len(t.split("\n"))
        for line in set(t.split("\n")):
            if line not in left:
                out.setdefault(line, []).append(k)
    return out


def test_long_lines_go_from_two_documents(spark):
    passages = {n: " ".join(f"w{chr(97 + n)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(55)) for n in (2, 3, 4)}
    figures = " ".join(str(k * 37) for k in range(12))
    texts = ["\n".join([f"{c} alone {c}" for c in "abcdefgh"[k]] + [p for n, p in passages.items() if k < n] + [figures] * (k < 2) + ["short line twice"] * (k < 2)) for k in range(8)]
    assert dropped(spark, texts) == {passages[2]: [1], passages[3]: [1, 2], passages[4]: [1, 2, 3], figures: [1]}


def test_short_lines_and_any_white_space(spark):
    chinese, tabs = "这是一行没有空格的文字它在几份文件里一再出现并且应当删去", "one\ttwo\tthree\tfour\tfive\tsix\tseven\teight\tnine\tten"
    texts = ["\n".join([f"only{'abcdefg'[k]}", "", "And ornd.", "Page"] + ["Rare one"] * (k < 4) + [chinese] * (k < 2) + [tabs if k else tabs.replace("\t", "  ")] * (k < 3)) for k in range(6)]
    got = dropped(spark, texts)
    assert got == {"And ornd.": [1, 2, 3, 4, 5], "Page": [1, 2, 3, 4, 5], chinese: [1], tabs: [1, 2]}


def test_templates_need_constant_tokens_and_distinct_documents(spark):
    figures = [f"{k}1 {k}2 {k}3\na{k} b{k} c{k}\nrow {k} x{k} y{k} z{k}" for k in range(8)]
    logs = [f"User x{k} logged in from host alpha at night" for k in range(8)]
    assert dropped(spark, figures) == {}  # the data differ
    assert dropped(spark, logs).keys() == set(logs[1:])
    many = ["\n".join(f"name is word {a} {'xyz'[j] * 3} alike as ever" for j in range(3)) for a in ("lo", "hi")]
    assert dropped(spark, many) == {}  # six lines of one template, but two documents
    heads = [f"in the end {w} {w}s" for w in ("ab", "cd", "ef", "gh", "ij", "kl")]
    assert dropped(spark, heads) == {}  # only the leading tokens are constant
    assert dropped(spark, ["7 8 9"] * 3 + ["7 8 9\n7 8 9", "x\n7 8 9", "y\n7 8 9"]).keys() == {"7 8 9"}  # as it is


def test_awkward_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b c\n\nq", "x"), (3, "  \n\t\n", "x"), (3, "  \n\t\n", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = dedup_lines(docs, min_docs=2)
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got.collect()) == sorted([("1", None, 0, 0), ("2", "", 1, 0), ("None", "a b c\n\nq", 3, 0), ("3", "  \n\t\n", 3, 0), ("3", "  \n\t\n", 3, 0)])
    assert dedup_lines(docs.limit(0)).count() == 0


def test_texts_are_split_once_for_all_lines(spark, monkeypatch):
    """One pass splits the texts, once each, whatever the white space; templates come from what it wrote."""
    passes, plain = [], line_dedup.plain_lines
    monkeypatch.setattr(line_dedup, "plain_lines", lambda *of: passes.append(plain(*of)) or passes[-1])
    blanks = ["\t", "\r", "  ", "\x0b", "\f", "\x85", "\xa0", "\u1680", "\u2000", "\u2028", "\u202f", "\u205f", "\u3000"]
    texts = [f"{blank}User x{k} logged{blank}in from host alpha at night{blank}\nalone{k}" for k, blank in enumerate(blanks)]
    assert dropped(spark, texts).keys() == {t.split("\n")[0] for t in texts[1:]}
    assert len(passes) == 1
    plan = passes[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
