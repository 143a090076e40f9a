"""The kept index: batches leave what a rebuild gives, queries read their buckets, commits are whole or not at all."""

import random

import numpy as np
import pytest

from loomwork.operators import best_first, text_index
from loomwork.operators.search import bm25, phrase_bm25, top_k
from loomwork.operators.text_index import TextIndex, _terms
from loomwork.plans.versions import Conflict, Versions

SMALL = "/root/testdata/sf0.001"


def rows(rng, keys):
    words = ["aba", "Abab", "ababa", "été", "x1", "naïve café", "日本語", "本", "a", ""]
    return [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for k in keys]


def frame(spark, data):
    return spark.createDataFrame(data, "key long, text string")


def scores(df):
    return {r[0]: pytest.approx(r[1], abs=1e-9) for r in df.collect()}


def test_terms_of_a_text():
    n, grams = _terms("abab", "grams")
    assert n == 2 and {g: p.tolist() for g, p in grams} == {"aba": [0], "bab": [1], "ab\0": [2], "b\0\0": [3]}
    n, words = _terms("one two one", "words")
    assert n == 3 and {w: p.tolist() for w, p in words} == {"one": [0, 2], "two": [1]}
    assert _terms("", "grams") == (0, []) and _terms("日", "grams")[0] == 0


@pytest.fixture()
def few_blocks(monkeypatch):
    monkeypatch.setattr(text_index, "BUCKETS", 8)
    monkeypatch.setattr(best_first, "FIRST", 1)


@pytest.mark.parametrize("merged", [False, True])
def test_batches_equal_a_rebuild(spark, tmp_path, few_blocks, merged):
    rng = random.Random(2)
    grams, words = TextIndex(spark, f"{tmp_path}/g", "grams", "long"), TextIndex(spark, f"{tmp_path}/w", "words", "long")
    live = {}
    for batch in range(3):
        changed, lost = dict(rows(rng, rng.sample(range(60), 30))), rng.sample(range(60), 8) if batch else []
        lost = [k for k in lost if k not in changed]
        live = {k: t for k, t in (live | changed).items() if k not in lost}
        for index in (grams, words):
            index.apply(frame(spark, [*changed.items(), (None, "no key")]), spark.createDataFrame([(k,) for k in lost], "key long") if lost else None)
            if merged and batch:
                index.merge()
    docs = frame(spark, list(live.items()))
    state = words._state()[1]
    assert state["n"] == len(live) and len(state["segments"]) == (1 if merged else 3)
    for phrases in (["aba"], ["b"], ["本"], ["日本"], ["ÉTÉ", "ab"], ["naïve café"], ["baba"], ["nowhere"]):
        assert scores(grams.phrases(phrases)) == scores(phrase_bm25(docs, "key", "text", [p.lower() for p in phrases]))
    for terms in (["aba"], ["x1", "abab"], ["a", "ababa"], ["nowhere", "a"]):
        want = top_k(bm25(docs, "key", "text", terms).selectExpr("key", "round(score, 9) as score"), "key", 7)
        assert [tuple(r) for r in words.bm25(terms, 7).orderBy("rank").collect()] == [(r.key, pytest.approx(r.score, abs=1e-8), r["rank"]) for r in want.orderBy("rank").collect()]


def test_a_batch_of_deletes_and_an_empty_index(spark, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/i", "words", "long")
    assert index.bm25(["a"], 3).count() == 0 and index.documents().count() == 0
    index.apply(frame(spark, [(1, "a b"), (2, "a"), (2, "zz a")]))
    assert {r.key: r.length for r in index.documents().collect()} == {1: 2, 2: 2}
    index.apply(deletes=spark.createDataFrame([(1,), (7,)], "key long"))
    assert [r.key for r in index.bm25(["a"], 3).collect()] == [2]
    assert index.bm25(["b"], 3).count() == 0


def files_read(df):
    """Files that the scan of a collected DataFrame has opened."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numFiles").value()


def test_queries_read_their_buckets_only(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id as key", "text")
    index = TextIndex(spark, f"{tmp_path}/i", "grams", "long")
    index.apply(docs)
    everything = files_read(index.postings(prefixes=["t"]))
    assert files_read(index.postings(["the"])) <= text_index.SHARES < everything / 4
    assert files_read(index.postings(prefixes=["th"])) <= text_index.SHARES
    plan = index.postings(["the"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "term" in plan.split("PushedFilters:")[1].split("]")[0]


def test_bounds_leave_blocks_unread(spark, tmp_path, monkeypatch):
    """Documents that repeat a word lie in few blocks: the others' bounds are below the k-th score."""
    monkeypatch.setattr(best_first, "FIRST", 1)
    index = TextIndex(spark, f"{tmp_path}/i", "words", "long")
    for part in range(6):
        index.apply(frame(spark, [(part * 100 + k, "wanted " * (12 if part == 3 else 1) + "filler " * 30) for k in range(40)]))
    opened, plain = [], text_index.best_first
    monkeypatch.setattr(text_index, "best_first", lambda bounds, by, k, evaluate, ties, **more: plain(bounds, by, k, lambda o: (opened.append(o.count()), evaluate(o))[1], ties, **more))
    found = index.bm25(["wanted"], 5)
    assert [r.key for r in found.orderBy("rank").collect()] == [300, 301, 302, 303, 304] and 0 < sum(opened) <= 2


def test_of_two_writers_one_is_refused(spark, tmp_path):
    first, second = (TextIndex(spark, f"{tmp_path}/i", "words", "long") for _ in range(2))
    first.apply(frame(spark, [(1, "one")]))
    seen = second._state()
    first.apply(frame(spark, [(2, "two")]))
    second._state = lambda: seen
    with pytest.raises(Conflict):
        second.apply(frame(spark, [(3, "three")]))
    del second._state
    assert {r.key for r in second.documents().collect()} == {1, 2}
    second.apply(frame(spark, [(3, "three")]))
    assert {r.key for r in first.documents().collect()} == {1, 2, 3}


def test_a_killed_batch_leaves_no_trace(spark, tmp_path, monkeypatch):
    index = TextIndex(spark, f"{tmp_path}/i", "words", "long")
    index.apply(frame(spark, [(1, "one")]))

    def killed(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(Versions, "commit", killed)
    with pytest.raises(KeyboardInterrupt):
        index.apply(frame(spark, [(1, "other"), (2, "two")]))
    monkeypatch.undo()
    assert [r.key for r in index.bm25(["one"], 5).collect()] == [1] and index.bm25(["two"], 5).count() == 0
    versions = Versions(spark, f"{tmp_path}/i")
    assert versions.numbers() == [1] and versions.read(1)["n"] == 1


def test_positions_are_packed():
    rng = np.random.default_rng(3)
    own = [np.sort(rng.integers(0, n, n // 3)).astype(np.int32) for n in (0, 9, 300, 0, 70_000)] + [np.array([2**61, 0, 5, 2**31 - 1, 127, 64, -(2**61)]), np.zeros(0, np.int32)]
    packed = text_index._packed(own)
    assert text_index._unpacked(packed).tolist() == np.concatenate(own).tolist()
    assert text_index._unpacked(packed.slice(2, 3)).tolist() == np.concatenate(own[2:5]).tolist()
    assert text_index._unpacked(packed.slice(3, 1)).tolist() == text_index._unpacked(text_index._packed([])).tolist() == []
    assert packed.nbytes < 0.5 * sum(r.nbytes for r in own)


def test_postings_are_written_once(spark, tmp_path, monkeypatch):
    made, kept = [], text_index.materialize
    monkeypatch.setattr(text_index, "materialize", lambda df, name: made.append(name) or kept(df, name))
    index = TextIndex(spark, str(tmp_path), "words", "long")
    index.apply(spark.createDataFrame([(1, "one two two"), (2, ""), (3, None)], "key long, text string"))
    assert {r.key: r.length for r in index.documents().collect()} == {1: 3, 2: 0, 3: 0} and "postings" not in made


@pytest.mark.parametrize("most", [0, 1, 500])
def test_only_texts_of_repeated_keys_are_shuffled(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(text_index, "REPEATED", most)
    monkeypatch.setattr(text_index, "SMALL_BATCH", 0)
    plans, plain = [], text_index.materialize_in_groups

    def spy(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(text_index, "materialize_in_groups", spy)
    frame(spark, [(k, f"word w{k}") for k in range(20)]).write.parquet(f"{tmp_path}/once")
    once, index = spark.read.schema("key long, text string").parquet(f"{tmp_path}/once"), TextIndex(spark, f"{tmp_path}/i", "words", "long")
    index.apply(once)
    index.apply(once.union(frame(spark, [(3, "word zz z"), (3, "word a"), (4, "later"), (None, "x")])))
    assert "Exchange" not in plans[0] and {r.key: r.length for r in index.documents().collect()} == {k: 3 if k == 3 else 2 for k in range(20)}
    assert [r.key for r in index.bm25(["zz"], 5).collect()] == [3] and index.bm25(["later"], 5).count() == 0 and index.bm25(["word"], 50).count() == 20


def test_a_merge_keeps_postings_packed(spark, tmp_path, monkeypatch):
    """Blocks are joined and the dead dropped without a row per term and document."""
    rng = random.Random(6)
    monkeypatch.setattr(text_index, "BUCKETS", 4)
    monkeypatch.setattr(text_index, "BLOCK_DOCS", 8)
    index = TextIndex(spark, f"{tmp_path}/i", "words", "long")
    words, live = [f"w{k}" for k in range(12)], {}
    for batch in range(3):
        changed = {k: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for k in rng.sample(range(80), 50)}
        lost = [k for k in rng.sample(range(80), 10) if batch and k not in changed]
        live = {k: t for k, t in (live | changed).items() if k not in lost}
        index.apply(frame(spark, sorted(changed.items())), spark.createDataFrame([(k,) for k in lost], "key long"))
    opened, plain = [], text_index._each
    monkeypatch.setattr(text_index, "_each", lambda *args, **more: (opened.append(1), plain(*args, **more))[1])
    for _ in range(2):
        index.merge()
        assert not opened
        key = {r.id: r.key for r in index.documents().collect()}
        rows = index._segments(index._state()[1])
        got = {(r.term, key[r.id]): r.positions for r in plain(rows).collect()}
        assert got == {(w, k): [i for i, x in enumerate(t.split()) if x == w] for k, t in live.items() for w in set(t.split())}
        ids = rows.mapInArrow(text_index._opened(False), "term string, block long, id long, count int").groupBy("term", "block").agg({"id": "count", "count": "max"}).collect()
        assert {(r.term, r.block): (r.n, r.most) for r in rows.collect()} == {(r[0], r[1]): (r["count(id)"], r["max(count)"]) for r in ids} and len(ids) == rows.count()
