"""Names in texts: the automaton and the join on rarest grams agree with containment."""

import random

import pytest

from loomwork.operators import aliases
from loomwork.operators.aliases import alias_matches, grams
from loomwork.operators.search import similar_pairs, similar_to_items


def test_grams():
    assert len(grams("aaaa")) == 1 and len(grams("ab")) == 0 and len(grams("日本語だ")) == 2


@pytest.mark.parametrize("bound", [None, (0, 0)])
def test_equals_containment(spark, bound):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcÉ日") for _ in range(n))
    texts = [(k % 90, word(rng.randrange(40))) for k in range(120)] + [(200, None), (201, ""), (202, "xyz " * 20_000)]
    names = [word(rng.randrange(1, 7)) for _ in range(60)] + ["", None, "XYZ", "xyz", "nowhere", "yz x"]
    got = alias_matches(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names], "name string"), "id", "text", "name", bound)
    want = {(i, n.lower()) for i, t in texts for n in names if n and n.lower() in (t or "").lower()}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert alias_matches(spark.createDataFrame([], "id long, text string"), spark.createDataFrame([("a",)], "name string"), "id", "text", "name", bound).count() == 0


def test_short_grams_alone_are_no_candidates(spark, monkeypatch):
    made, kept = {}, aliases.materialize
    monkeypatch.setattr(aliases, "materialize", lambda df, name: made.setdefault(name, kept(df, name)))
    texts = [(k, "abc bcd cde def efg fgh") for k in range(40)] + [(50, "so ABCDEFGH it is")]
    found = alias_matches(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([("abcdefgh",)], "name string"), "id", "text", "name", (0, 0))
    assert [tuple(r) for r in found.collect()] == [(50, "abcdefgh")] and made["met"].count() == 1


def test_no_nested_loop(spark):
    texts, names = spark.createDataFrame([(1, "abc abd")], "id long, text string"), spark.createDataFrame([("abc",), ("bd",)], "name string")
    plan = alias_matches(texts, names, "id", "text", "name", (0, 0))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_items_against_all_texts(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice("red green blue the of cat dog 日 本".split()) for _ in range(rng.randrange(9)))
    left, right = (spark.createDataFrame([(k, text()) for k in range(n)] + [(99, None)], "id long, text string") for n in (20, 60))
    found = {(r.left_id, r.right_id): pytest.approx(r.score) for r in similar_pairs(left, right, 0.3).collect()}
    assert {(r.left_id, r.right_id): r.score for r in similar_to_items(left, right, 0.3).collect()} == found and len(found) > 50
