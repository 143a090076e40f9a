"""Graph, table and source operators on small fixtures; streams against their batch results."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomwork import catalogue, standin
from loomwork.operators import components, graph, search, tables
from loomwork.sources import instrument, logs, ranges
from loomwork.streaming import events as stream

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_components_against_union_find(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(90)] + [(7, 7), (500, 501), (501, 500)] + [(900, k) for k in range(901, 960)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_depths_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "y")], "u string, v string")
    start = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.depths(edges, start, 9)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(graph.path_length(edges, "a", "d")) == [(3,)] and rows(graph.path_length(edges, "a", "y")) == [(None,)] and rows(graph.path_length(edges, "a", "a")) == [(0,)]


def test_ready_nodes(spark):
    nodes = spark.createDataFrame([("a", "completed", []), ("b", "pending", ["a"]), ("c", "pending", ["a", "b"]), ("d", "pending", []), ("e", "pending", ["zz"])], "id string, status string, depends_on array<string>")
    assert rows(graph.ready(nodes)) == [("b",), ("d",)]


def test_imports_resolve(spark):
    modules = spark.createDataFrame([("lib/a.py", "lib.a", "a"), ("lib/x/u.py", "lib.x.u", "u"), ("src/u.py", "src.u", "u"), ("lib/b.py", "lib.b", "b")], "path string, dotted string, base string")
    imports = spark.createDataFrame([("src/m.py", "lib.a"), ("src/m.py", "lib.b.thing"), ("src/m.py", "u"), ("other/m.py", "u"), ("src/m.py", "b"), ("src/m.py", "os")], "importer string, name string")
    assert rows(graph.resolve_imports(imports, modules)) == [("src/m.py", "b", "lib/b.py"), ("src/m.py", "lib.a", "lib/a.py"), ("src/m.py", "lib.b.thing", "lib/b.py"), ("src/m.py", "u", "src/u.py")]


def test_upsert_and_append(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    assert rows(tables.upsert(old, new, ["id"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(tables.append_new(old, new, ["id"])) == [(1, "a"), (2, "b"), (3, "C")]
    assert tables.with_columns(old, {"v": F.lit(0), "w": F.lit(1)}).columns == ["id", "v", "w"]


def test_islands_split(spark):
    ids = spark.createDataFrame([("k", x) for x in (1, 2, 3, 4, 5, 9, 10, 10, 20)], "key string, at int")
    assert rows(tables.islands(ids, ["key"], "at")) == [("k", 1, 5, 5), ("k", 20, 20, 1), ("k", 9, 10, 2)]
    assert rows(tables.islands(ids, ["key"], "at", longest=3)) == [("k", 1, 3, 3), ("k", 20, 20, 1), ("k", 4, 5, 2), ("k", 9, 10, 2)]
    assert rows(tables.gaps(ids, ["key"], "at")) == [("k", 10, 20, 9), ("k", 5, 9, 3)]


def test_islands_by_one_sort(spark):
    held = [("k", x) for x in (None, None, 7, -(2**31), 2**31 - 1, 2**31 - 2, 8, 9, 9)] + [("l", None), (None, 3), (None, 4)]
    df = spark.createDataFrame(held, "key string, at int")
    runs = [("k", None, None, 1), ("l", None, None, 1), (None, 3, 4, 2), ("k", -(2**31), -(2**31), 1), ("k", 2**31 - 2, 2**31 - 1, 2)]
    assert set(map(tuple, tables.islands(df, ["key"], "at").collect())) == {*runs, ("k", 7, 9, 3)}
    assert set(map(tuple, tables.islands(df, ["key"], "at", longest=2).collect())) == {*runs, ("k", 7, 8, 2), ("k", 9, 9, 1)}
    for longest in (None, 2):
        plan = tables.islands(df, ["key"], "at", longest)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Sort [") == plan.count("Exchange hash") == 1 and "Aggregate" not in plan


def test_cooling(spark):
    cases = [("proposed", 999.0, True), ("failed", 29.9, True), ("failed", 30.0, False), ("overlap", 6.0, True), ("in_progress", 1.5, False), ("accepted", 0.1, False), ("failed", None, True), (None, None, False)]
    df = spark.createDataFrame(cases, "r string, a double, want boolean")
    assert df.where(~tables.cooling(F.col("r"), F.col("a")).eqNullSafe(F.col("want"))).count() == 0


def test_rectangles_that_touch_do_not_overlap(spark):
    rects = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (2, 1, 10.0, 0.0, 20.0, 10.0), (3, 1, 5.0, 5.0, 12.0, 7.0), (4, 2, 0.0, 0.0, 9.0, 9.0), (5, 1, 2.0, 2.0, 3.0, 3.0)], "id int, page int, x0 double, y0 double, x1 double, y1 double")
    assert rows(tables.overlapping(rects, 4.0)) == [(1, 3, 10.0), (1, 5, 1.0), (2, 3, 4.0)]


def test_exit_code(spark):
    found = spark.createDataFrame([("WARN", "a", "k", "m")], tables.ISSUE)
    assert rows(tables.exit_code(found)) == [(1,)] and rows(tables.exit_code(found.limit(0))) == [(0,)]


def test_similar_pairs_and_suppression(spark):
    left = spark.createDataFrame([(1, "red ring big"), (2, "blue bolt"), (3, None)], "id int, text string")
    right = spark.createDataFrame([(10, "big red ring"), (11, "red bolt")], "id int, text string")
    assert rows(search.similar_pairs(left, right, 0.3)) == [(1, 10, 1.0), (2, 11, 1 / 3)]
    assert rows(search.similar_pairs(left, right, 0.3, spark.createDataFrame([(10, 1)], "a int, b int"))) == [(2, 11, 1 / 3)]


def test_blocks_and_edges(spark, tmp_path):
    (tmp_path / "log.md").write_text("intro\n### D-001 First thing\nbody one\n<!-- supersedes=D-000 refs=D-002|D-003 -->\n### D-002: Second\nbody\n")
    found = logs.blocks(logs.read_whole(spark, str(tmp_path), "*.md"), r"D-\d+")
    assert [(r.id, r.title) for r in found.orderBy("pos").collect()] == [("D-001", "First thing"), ("D-002", "Second")]
    assert rows(logs.block_edges(found, {"supersedes": "supersedes", "refs": "references"})) == [("D-001", "D-000", "supersedes"), ("D-001", "D-002", "references"), ("D-001", "D-003", "references")]


def test_sections(spark):
    lines = ["before", "<!-- page 1 -->", "## Chapter 1 Start", "one two three four five", "<!-- page 2 -->", "more words here", "## Tiny", "few", "## Safety", "warning words are all over here"]
    df = spark.createDataFrame([("doc", i, x) for i, x in enumerate(lines)], "doc string, n int, line string")
    got = {r.title: r for r in logs.sections(df, "doc", "n", "line", [("safety", "warning")]).collect()}
    assert set(got) == {"Chapter 1 Start", "Safety"}
    assert (got["Chapter 1 Start"].source_page, got["Chapter 1 Start"].content_type) == ("p1-2", "other")
    assert (got["Safety"].page_start, got["Safety"].content_type, got["Safety"].chapter) == (2, "safety", "Chapter 1 Start")


CSV = "\n".join(
    ["Device,,,,,", *[f"h{k},,v" for k in range(6)], ",,,Std. Item,VF,IR,VF", ",,,User Item,VF1,,VF2", ",,,Upper,1.5,-,3", ",,,Lower,0.5,,1", ",,,Condition 1,10mA,,20mA", ",,,Time,1,2,3", ",,,Min.,,,", ",,,Max.,,,", ",,,Ave.,,,", ",,,Category Name,,,", "1,1,1,PASS,0.9,7,1.9", "2,1,1,FAIL,-,8,2.5", "x,1,1,skip,1,1,1", "3,1,1,PASS,1.1,,x", ",,,,"]
)


def test_instrument_files(spark):
    files = spark.createDataFrame([("d/lotA/LTX_DEV_TXS-1_GA12-3_2024010112.csv", CSV), ("d/lotA/LTX_DEV_TXS-1_GA12-3_2024010112_1.csv", CSV), ("d/lotA/short.csv", "a,b")], "path string, text string")
    parsed = instrument.parse_files(files)
    one = parsed.where("path like '%112.csv'")
    assert rows(one.where("kind = 'spec'").select("param", "std_item", "upper", "lower")) == [(0, "VF", 1.5, 0.5), (1, "IR", None, None), (2, "VF", 3.0, 1.0)]
    assert rows(instrument.measurements(one).select("unit", "param", "value")) == [(1, 0, 0.9), (1, 1, 7.0), (1, 2, 1.9), (2, 1, 8.0), (2, 2, 2.5), (3, 0, 1.1)]
    names = {r.path[-5:]: (r.lot, r.continuation, r.device, r.work_order) for r in instrument.file_names(files).collect()}
    assert names["2.csv"] == ("lotA/LTX_DEV_TXS-1_GA12-3_2024010112", 0, "DEV", "GA12") and names["1.csv"][1] == 1 and names["t.csv"][2] == "short"
    assert rows(instrument.lot_limits(parsed, files).select("param", "least", "most", "n"))[0] == (0, 0.9, 1.1, 4)


def test_date_range_source(spark):
    def fetch(start, end, options):
        yield start.isoformat(), (end - start).days

    spark.dataSource.register(ranges.date_ranges("spans", "start string, days int", fetch))
    df = spark.read.format("spans").option("start", "2024-01-01").option("end", "2024-01-18").option("days", "7").load()
    assert rows(df) == [("2024-01-01", 7), ("2024-01-08", 7), ("2024-01-15", 3)]


def test_event_log_skips_bad_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts": "2024-01-01", "event": "a"}\nnot json\n{"ts": "2024-01-02", "event": "b"}\n')
    assert logs.event_log(spark, str(tmp_path / "log.jsonl"), "ts string, event string").count() == 2


@pytest.mark.parametrize("make", [stream.window_counts, stream.sessions])
def test_stream_equals_batch(spark, tmp_path, make):
    spark.read.parquet(f"{SMALL}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    want = rows(make(batch))
    run = make(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("parquet")
    query = run.option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = rows(spark.read.parquet(str(tmp_path / "out")).select(*make(batch).columns))
    last = max(r.ts for r in batch.select(F.max("ts").alias("ts")).collect())
    closed = [r for r in want if max(x for x in r if isinstance(x, dt.datetime)) < last - dt.timedelta(days=2)]
    assert closed and {repr(r) for r in closed} <= {repr(r) for r in got} <= {repr(r) for r in want}


def test_equal_rectangles_meet_others_as_one(spark):
    shapes = {(0.0, 0.0, 4.0, 2.0): range(0, 3000), (1.0, 1.0, 3.0, 3.0): range(5000, 5002), (4.0, 0.0, 5.0, 2.0): [9000]}
    rects = spark.createDataFrame([(i, 1, *s) for s, ids in shapes.items() for i in ids], "id long, page int, x0 double, y0 double, x1 double, y1 double")
    found = tables.overlap_shares(rects, 2.0)
    got = found.groupBy("area", "share").count().collect()
    assert sorted(tuple(r) for r in got) == [(2.0, 0.5, 6000), (4.0, 1.0, 1), (8.0, 1.0, 3000 * 2999 // 2)]
    assert found.where("a >= b").isEmpty() and found.distinct().count() == found.count()


def test_relations_are_sorted_in_shares(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(standin, "SHARE", 10)
    held = [(k % 7, k % 5) for k in range(100)] + [(None, 1), (None, 1)]
    spark.createDataFrame(held, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = standin.Tables(spark, str(tmp_path)).relations()
    got = found.collect()
    assert len(got) == len(set(got)) == 36 and set(map(tuple, got)) == set(held)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and ", 11)" in plan


def test_first_row_of_equals(spark, tmp_path):
    held = [(1, 5, 2, float(q)) for q in (9, 4, 8, 3, 7)] + [(1, 6, 1, 0.0)]
    for k, rows_ in enumerate((held, held[::-1])):
        spark.createDataFrame(rows_, "l_partkey long, l_orderkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        assert rows(catalogue.QUERIES["first_row_per_key"](spark, f"{tmp_path}/{k}")) == [(1, 5, 2, 3.0)]
