"""Attempts as a stream: equal to the batch in any batching, after a restart, with timers that fire once."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomwork.operators.knowledge import attempts
from loomwork.operators.versioned import VersionedTable
from loomwork.streaming.attempts import RESULT, attempt_stream

SCHEMA = "node long, seq long, ok boolean, seconds double, limit double, at timestamp"


def rows(n=120):
    rng, made = random.Random(3), {}
    out = []
    for k in range(n):
        node = rng.randrange(30)
        made[node] = made.get(node, 0) + 1
        out.append((node, made[node], rng.random() < 0.3, float(rng.randrange(10)), 8.0, datetime(2024, 1, 1) + timedelta(minutes=k)))
    return out


@pytest.fixture()
def run(spark, tmp_path):
    """Runs the stream over what is in the folder now and gives the table of its rows."""
    table = VersionedTable(spark, f"{tmp_path}/out", RESULT, ["node", "kind"])

    def go(late="1 hour"):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        keep = lambda batch, number: table.apply(batch, batch=("attempts", number)) and None
        found = attempt_stream(stream, most=3, late=late).writeStream.foreachBatch(keep).outputMode("update")
        found.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return table.read()

    return go


@pytest.mark.parametrize("batches", [1, 3])
def test_equals_the_batch(spark, tmp_path, run, batches):
    data = rows()
    random.Random(batches).shuffle(data)
    for k in range(batches):
        spark.createDataFrame(data[k::batches], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = {(r.node, r.tries, r.state, r.wait) for r in run("1 day").where("kind = 'state'").collect()}
    want = attempts(spark.createDataFrame(data, SCHEMA).drop("at"), most=3)
    assert got == {(r.node, r.tries, r.state, r.wait) for r in want.collect()}
    assert {"done", "failed", "retry"} == {s for _, _, s, _ in got}


def test_goes_on_after_a_stop_and_timers_fire(spark, tmp_path, run):
    start = datetime(2024, 1, 1)
    first = [(1, 1, False, 1.0, 8.0, start), (2, 1, False, 1.0, 8.0, start), (3, 1, True, 9.0, 8.0, start)]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    assert {(r.node, r.tries, r.state, r.wait) for r in run().collect()} == {(k, 1, "retry", 1.0) for k in (1, 2, 3)}
    # Node 2 tries again; a later row of another node moves the time on.
    later = [(2, 2, True, 1.0, 8.0, start + timedelta(seconds=2)), (9, 1, True, 1.0, 8.0, start + timedelta(hours=9))]
    spark.createDataFrame(later, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    found = run()
    assert {(r.node, r.tries, r.state) for r in found.where("kind = 'state'").collect()} == {(1, 1, "retry"), (2, 2, "done"), (3, 1, "retry"), (9, 1, "done")}
    assert {(r.node, r.tries) for r in found.where("kind = 'due'").collect()} == {(1, 1), (3, 1)}
    assert found.where("kind = 'due'").select(F.unix_timestamp("due") - F.unix_timestamp(F.lit(start))).first()[0] == 1


def test_the_store_is_asked_by_the_node_not_by_the_row(spark, tmp_path):
    """Numbers over many blocks, among them gaps, negative ones, repeated ones and null, in three batches."""
    rng, start = random.Random(5), datetime(2024, 1, 1)
    numbers = {1: range(1, 3001), 2: range(1, 3001), 3: range(-900, 900), 4: range(10**9, 10**9 + 60000, 60), 5: range(1, 3), 6: [1, None]}
    good = {1: {2, 700, 2999}, 2: {1600, 1700, 3000}, 3: {5, 880}, 4: {10**9 + 30000}, 5: set(), 6: set()}
    data = [(node, seq, seq in good[node], 1.0, None, start) for node, seqs in numbers.items() for seq in seqs]
    rng.shuffle(data)
    again = [row for row in data if row[0] < 5][:500]
    for k in range(3):
        spark.createDataFrame(data[k::3] + again, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = VersionedTable(spark, f"{tmp_path}/out", RESULT, ["node", "kind"])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    keep = lambda batch, number: table.apply(batch, batch=("attempts", number)) and None
    found = attempt_stream(stream, late="1 day").writeStream.foreachBatch(keep).outputMode("update")
    query = found.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.node: (r.tries, r.state) for r in table.read().where("kind = 'state'").collect()}
    assert got == {1: (2, "done"), 2: (1600, "done"), 3: (906, "done"), 4: (501, "done"), 5: (2, "retry"), 6: (2, "retry")}
    done = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(done) == 3 and sum(p["numInputRows"] for p in done) == len(data) + 1500
    written = sum(s["numRowsUpdated"] for p in done for s in p["stateOperators"])
    assert written < len(data) / 10
