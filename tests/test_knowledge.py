"""Knowledge, check and material operators on small fixtures; batches of a stream that are replayed."""

import pytest
from pyspark.sql import functions as F

from loomwork.functions import materials, text
from loomwork.operators import checks, conflicts, knowledge, search, tables
from loomwork.streaming import events as stream


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_not_in_follows_sql_nulls(spark):
    own = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    listed = spark.createDataFrame([(2,), (3,)], "v int")
    assert rows(tables.not_in(own, "k", listed, "v")) == [(1,)]
    assert rows(tables.not_in(own, "k", listed.union(spark.createDataFrame([(None,)], "v int")), "v")) == []
    assert rows(tables.not_in(own, "k", listed.limit(0), "v")) == [(1,), (2,), (None,)]


def test_phrases_in_any_script(spark):
    docs = spark.createDataFrame([(1, "知識庫的搜尋功能"), (2, "搜尋"), (3, None), (4, "Search 知識庫 and 知識庫"), (5, "知識庫知識庫")], "id int, text string")
    got = {r.id: r.score for r in search.phrase_bm25(docs, "id", "text", ["知識庫"]).collect()}
    assert got.keys() == {1, 4, 5} and got[5] > got[1] > 0  # twice in a shorter text
    assert {r.id for r in search.phrase_bm25(docs, "id", "text", ["知識庫", "search"]).collect()} == {4}


def test_conflicts_have_a_floor(spark):
    left = spark.createDataFrame([(1, "red ring"), (2, "模組 版本"), (3, None)], "id int, text string")
    right = spark.createDataFrame([(10, "the red ring of the large old machine"), (11, "blue bolt"), (12, "模組 版本 更新")], "id int, text string")
    assert rows(conflicts.conflicts(left, right)) == [(1, 10, 0.6), (2, 12, pytest.approx(4 / 6))]


def test_nearest_of_blocks_and_marks(spark, monkeypatch):
    vectors = spark.createDataFrame([(k, [float(k % 7), float(k % 5) - 2, 1.0], k % 3) for k in range(60)] + [(99, None, 0), (98, [0.0, 0.0, 0.0], 1)], "id long, v array<double>, mark int")
    queries = vectors.where("id % 10 = 0")
    want = rows(search.nearest(queries, vectors.repartition(5), "id", "v", k=4, unless="mark").select("query", "id", "rank"))
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    assert rows(search.nearest(queries, vectors, "id", "v", k=4, unless="mark").select("query", "id", "rank")) == want and len(want) == 24
    every = search.nearest(queries, vectors, "id", "v", least=0.9)
    assert all(r.query != r.id and r.similarity >= 0.9 for r in every.collect())
    assert search.nearest(queries.limit(0), vectors, "id", "v").count() == 0


def test_superseding_and_counters(spark):
    nodes = spark.createDataFrame([("a", "active"), ("b", "stale"), ("c", "active")], "id string, status string")
    edges = spark.createDataFrame([("x", "a", "supersedes"), ("x", "b", "supersedes"), ("x", "c", "affects")], "source_id string, target_id string, relation string")
    assert rows(knowledge.superseded(nodes, edges)) == [("a", "superseded"), ("b", "stale"), ("c", "active")]
    meta = spark.createDataFrame([('{"usage": "4", "x": "y"}',), ("not json",), (None,)], "m string").select(knowledge.bumped(F.col("m"), "usage", F.lit(2)).alias("m"))
    assert rows(meta.select(F.get_json_object("m", "$.usage"), F.get_json_object("m", "$.x"))) == [("2", None), ("2", None), ("6", "y")]
    assert rows(knowledge.guarded_edges(edges, spark.createDataFrame([("x",), ("c",)], "id string"))) == [("x", "c", "affects")]


def test_exact_tokens_and_labels(spark):
    df = spark.createDataFrame([("use sync-kb now",), ("sync-kb-all",), ("x sync-kb.",), ("async-kb",)], "t string")
    assert [r[0] for r in df.select(knowledge.exact_token(F.col("t"), "sync-kb")).collect()] == [True, False, True, False]
    labels = spark.createDataFrame([("./projects/a/",), (" /b ",), ("",)], "p string").select(knowledge.project_label(F.col("p")))
    assert [r[0] for r in labels.collect()] == ["a", "b", None]


def test_modules_resolve_when_unique(spark):
    modules = spark.createDataFrame([("lib/a.py",), ("lib/x/u.py",), ("src/u.py",)], "path string")
    asked = spark.createDataFrame([("lib/a.py",), ("a",), ("u",), ("x/u",), ("zz",)], "query string")
    assert rows(knowledge.resolved(asked, modules)) == [("a", "lib/a.py"), ("lib/a.py", "lib/a.py"), ("x/u", "lib/x/u.py")]


def test_attempts(spark):
    log = [("a", 1, False, 1.0, 5.0), ("a", 2, True, 9.0, 5.0), ("a", 3, True, 1.0, 5.0), ("a", 4, False, 1.0, 5.0), ("b", 1, False, 1.0, 5.0), ("c", 1, False, 1.0, 5.0), ("c", 2, False, 1.0, 5.0), ("c", 3, False, 1.0, 5.0)]
    got = knowledge.attempts(spark.createDataFrame(log, "node string, seq int, ok boolean, seconds double, limit double"))
    assert rows(got) == [("a", 3, "done", None), ("b", 1, "retry", 1.0), ("c", 3, "failed", None)]


def test_checks_find_what_is_planted(spark):
    numbers = spark.createDataFrame([(1,), (2,), (5,), (5,)], "n long")
    assert rows(checks.numbering(numbers, F.col("n")).select("key", "message")) == [("3", "2 missing"), ("5", "2 times")]
    files = spark.createDataFrame([("f", "# A\n# B\n# A\nsee old-name"), ("g", "# Scope\n\nFROM v_old")], "path string, text string")
    assert rows(checks.repeated_headings(files, "path", "text").select("key", "message")) == [("f", "# A")]
    assert rows(checks.missing_sections(files, "path", "text", ["Scope"]).select("key")) == [("f",)]
    assert rows(checks.pattern_issues(files, "path", "text", {"alias": "old-name", "table": r"(?i)\b(FROM|JOIN)\s+v_old\b"}).select("key", "message")) == [("f:4", "alias"), ("g:3", "table")]


def test_checklist_forms(spark):
    raw = spark.createDataFrame([('{"a": "x"}',), ('[{"id": "b", "evidence": "y"}]',), ("bad",), (None,)], "r string")
    assert [r[0] for r in raw.select(tables.responses(F.col("r"))).collect()] == [[("a", "x")], [("b", "y")], [], []]


def test_next_id_counts_numbers(spark):
    assert rows(tables.next_id(spark.createDataFrame([("D-999",), ("D-1000",), ("E-5",)], "id string"), F.col("id"), "D")) == [(1001, "D-1001")]


def test_material_parts(spark):
    df = spark.createDataFrame([("Die attach/tool/glue x/12",), ("wire bond/t/au WIRE/1.0",), ("x",)], "d string").select(materials.process_description(F.col("d")).alias("p"))
    assert [(r.p.kind, r.p.wire) for r in df.collect()] == [("DIE", None), ("WIRE", "wire bond"), (None, None)]
    cut = spark.createDataFrame([("Short one.\nmore",), ("A first sentence. " + "word " * 30,)], "t string").select(text.short_target(F.col("t")))
    assert [r[0] for r in cut.collect()] == ["Short one.", "A first sentence."]


def test_replayed_batches_lose_nothing(spark, tmp_path):
    folder = str(tmp_path / "table")
    run = stream.upsert_batches(folder, ["k"], ["ts"])
    batch = lambda *r: spark.createDataFrame(list(r), "k string, ts int, v string")
    run(batch(("a", 1, "x"), ("b", 1, "y")), 0)
    run(batch(("a", 2, "z")), 1)
    run(batch(("a", 2, "z")), 1)  # the same batch again
    (tmp_path / "table" / "v2").mkdir()  # a batch that died half-way
    run(batch(("c", 3, "w")), 2)
    at = stream.latest_version(spark, folder)
    assert at == 2 and rows(spark.read.parquet(f"{folder}/v{at}")) == [("a", 2, "z"), ("b", 1, "y"), ("c", 3, "w")]


def test_products_of_one_batch_are_bounded(spark, monkeypatch):
    queries = spark.range(0, 900).selectExpr("id", "array(sin(id), cos(id), 0.1D) AS v", "id % 3 AS mark")
    shapes, plain = spark.sparkContext.accumulator(0), search._matrix
    monkeypatch.setattr(search, "_matrix", lambda column: (shapes.add(len(column) > 600), plain(column))[1])
    found = search.nearest(queries, spark.range(0, 9000, 1, 1).selectExpr("id", "array(sin(id), cos(id), 0.1D) AS v", "id % 3 AS mark"), "id", "v", k=3, unless="mark")
    assert found.count() == 2700 and shapes.value <= 1  # the block of queries itself
