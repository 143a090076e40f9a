"""Many shortest paths at once equal one search for each pair, in half the rounds."""

import random

from pyspark.sql import functions as F

from loomwork.operators import graph
from loomwork.operators.graph import path_length, path_lengths


def brute(edges, a, b, most):
    seen, frontier, depth = {a}, {a}, 0
    while frontier and depth <= most:
        if b in frontier:
            return depth
        frontier = {v for u, v in edges if u in frontier} - seen
        seen, depth = seen | frontier, depth + 1
    return None


def test_equals_single_searches(spark):
    rng = random.Random(4)
    nodes = [f"n{k}" for k in range(40)]
    edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(55)} | {("x", "x"), ("hub", "n1"), ("hub", "n2")}
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(60)] + [("n1", "n1"), ("nowhere", "n1"), ("hub", "n3"), ("n1", "n2"), ("n1", "n2"), (None, "n1")]
    df = spark.createDataFrame(sorted(edges), "u string, v string")
    for most in (1, 4, 6):
        got = {(r.a, r.b): r.hops for r in path_lengths(df, spark.createDataFrame(pairs, "a string, b string"), most).collect()}
        assert got == {(a, b): brute(edges, a, b, most) for a, b in pairs if a}
    for a, b in [("hub", "n3"), ("n1", "n1")]:
        assert path_length(df, a, b, 6).first().hops == brute(edges, a, b, 6)


def test_each_end_goes_half_the_way(spark, monkeypatch):
    chain = [(k, k + 1) for k in range(20)]
    depths, plain = [], graph.materialize

    def spy(df, name="step"):
        out = plain(df, name)
        if name == "side" and not out.isEmpty():
            depths.append(out.first().depth)
        return out

    monkeypatch.setattr(graph, "materialize", spy)
    pairs = spark.createDataFrame([(0, 6), (3, 9)], "a int, b int")
    assert sorted(tuple(r) for r in path_lengths(spark.createDataFrame(chain, "u int, v int"), pairs, 6).collect()) == [(0, 6, 6), (3, 9, 6)]
    assert max(depths) == 3


def test_last_hop_is_not_kept(spark, monkeypatch):
    names, plain = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name="step": (names.append(name), plain(df, name))[1])
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "u int, v int")
    assert [tuple(r) for r in path_lengths(edges, spark.createDataFrame([(0, 2)], "a int, b int"), 2).collect()] == [(0, 2, 2)]
    assert names.count("side") == 3


def test_lists_are_dealt_and_edges_go_both_ways(spark, monkeypatch):
    monkeypatch.setattr(graph, "LIST", 3)
    monkeypatch.setattr(graph, "SUMS", 64)
    rng = random.Random(5)
    edges = {(2 * rng.randrange(25), 2 * rng.randrange(40) + 1) for _ in range(60)} | {(0, 2 * k + 1) for k in range(0, 40, 3)} | {(-6, 1), (-6, -7)}
    both = edges | {(v, u) for u, v in edges}
    nodes = sorted({u for edge in both for u in edge}) + [999]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(80)] + [(0, 0), (-7, 3), (999, 1)]
    df, asked = spark.createDataFrame(sorted(edges) * 2, "u long, v long"), spark.createDataFrame(pairs, "a long, b long")
    for most in (1, 2, 3, 5):
        want = {(a, b): brute(both, a, b, most) for a, b in pairs}
        for kind in (None, lambda node: F.pmod(node, F.lit(2))):
            assert {(r.a, r.b): r.hops for r in path_lengths(df, asked, most, symmetric=True, kind=kind).collect()} == want


def test_a_frontier_is_lists(spark, monkeypatch):
    """A hop writes a row per end and list, not a row per node that is reached."""
    rows, plain = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name="step": (out := plain(df, name), rows.append(out.count()) if name == "side" else None)[0])
    edges = spark.createDataFrame([(2 * u, 2 * v + 1) for u in range(4) for v in range(u, 200)], "u long, v long")
    found = path_lengths(edges, spark.createDataFrame([(0, 2), (2, 4), (4, 1001)], "a long, b long"), 3, symmetric=True)
    assert sorted((r.a, r.b, r.hops) for r in found.collect()) == [(0, 2, 2), (2, 4, 2), (4, 1001, None)] and sum(rows) < 20


def test_kinds_tell_which_pairs_no_walk_joins(spark, monkeypatch):
    asked, plain = [], graph._last_hop
    monkeypatch.setattr(graph, "_last_hop", lambda pairs, *more: (asked.append(pairs.count()), plain(pairs, *more))[1])
    edges = spark.createDataFrame([(0, 1), (2, 3), (2, 5), (4, 5)], "u long, v long")
    found = path_lengths(edges, spark.createDataFrame([(0, 2), (2, 4), (4, 3), (0, 3)], "a long, b long"), 3, symmetric=True, kind=lambda node: F.pmod(node, F.lit(2)))
    assert {(r.a, r.b): r.hops for r in found.collect()} == {(0, 2): None, (2, 4): 2, (4, 3): 3, (0, 3): None} and asked == [2]
