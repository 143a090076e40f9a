"""Numbers, sums, carried values, runs and gaps over a whole table, against plain Python; no task has all rows."""

import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import ordering


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(9)
    rows = [(k, rng.randrange(200), rng.choice([None, 1, 2, 5])) for k in range(500)]
    return rows, spark.createDataFrame(rows, "id int, at int, v int").repartition(6)


def test_numbers_sums_and_carried_values(spark, table):
    rows, df = table
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    assert [(r.id, r.number) for r in ordering.numbered(df, ["at", "id"]).orderBy("number").collect()] == [(r[0], k) for k, r in enumerate(ordered, 1)]
    down = ordering.numbered(df, [F.desc("id")], "n", start=0)
    assert {r.id: r.n for r in down.collect()} == {k: 499 - k for k in range(500)}
    total, last, want = 0, None, {}
    for k, _, v in ordered:
        total, last = total + (v or 0), last if v is None else v
        want[k] = (total, last)
    sums = {r.id: r.s for r in ordering.running_sum(df, ["at", "id"], "v", "s").collect()}
    lasts = {r.id: r.s for r in ordering.carried_forward(df, ["at", "id"], "v", "s").collect()}
    assert {k: (sums[k], lasts[k]) for k in sums} == want


def test_runs_gaps_and_new_ids(spark):
    rng = random.Random(1)
    values = sorted(rng.sample(range(-50, 300), 200))
    df = spark.createDataFrame([(v,) for v in values * 2] + [(None,)], "v int").repartition(5)
    want = [(a, b, b - a - 1) for a, b in zip(values, values[1:]) if b - a > 1]
    assert sorted(tuple(r) for r in ordering.gaps(df, "v").collect()) == want
    starts = [values[0]] + [b for _, b, _ in want]
    stops = [a for a, _, _ in want] + [values[-1]]
    assert sorted(tuple(r) for r in ordering.runs(df, "v").collect()) == [(a, b, b - a + 1) for a, b in zip(starts, stops)]
    rows = ordering.with_new_ids(df, spark.createDataFrame([("b",), ("a",)], "name string"), "v", ["name"])
    assert sorted((r.name, r.v) for r in rows.collect()) == [("a", values[-1] + 1), ("b", values[-1] + 2)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "v int")
    assert ordering.gaps(none, "v").count() == 0 and ordering.runs(none, "v").count() == 0 and ordering.numbered(none, ["v"]).count() == 0
    assert [r.v for r in ordering.with_new_ids(none, spark.createDataFrame([("x",)], "n string"), "v", ["n"]).collect()] == [1]


def test_no_window_over_the_whole_table(spark, table):
    """Windows without a key are over one row per partition only."""
    plan = ordering.numbered(table[1], ["at"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "sum(_n" in plan.split("Window")[1]
