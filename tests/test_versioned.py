"""Versions of a keyed table: conflicts, killed and replayed batches, reading an earlier version, streams."""

import pytest

from loomwork.operators.versioned import VersionedTable
from loomwork.plans.versions import Conflict, Versions

SCHEMA = "id long, text string"


@pytest.fixture()
def table(spark, tmp_path):
    return VersionedTable(spark, f"{tmp_path}/table", SCHEMA, ["id"])


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def held(df):
    return {r.id: r.text for r in df.collect()}


def test_versions_can_be_read(spark, table):
    assert held(table.read()) == {}
    assert table.apply(frame(spark, (1, "a"), (2, "b"))) == 1
    assert table.apply(frame(spark, (2, "c"), (3, None)), removed=frame(spark, (1, ""), (3, ""), (9, ""))) == 2
    assert table.apply(frame(spark, (1, "again"), (4, "new")), new_only=True) == 3
    assert table.apply(frame(spark, (1, "kept"), (4, "kept")), new_only=True) == 4
    assert [held(table.read(v)) for v in (1, 2, 3)] == [{1: "a", 2: "b"}, {2: "c", 3: None}, {1: "again", 2: "c", 3: None, 4: "new"}]
    assert held(table.read()) == held(table.read(3))
    assert table.compact() == 5 and held(table.read()) == held(table.read(3)) and held(table.read(1)) == {1: "a", 2: "b"}
    assert table.apply(removed=frame(spark, (2, ""))) == 6 and held(table.read()) == {1: "again", 3: None, 4: "new"}
    assert [tuple(r) for r in table.history().orderBy("version").collect()][-2:] == [(5, 1, True, False), (6, 2, False, True)]


def test_a_replayed_batch_changes_nothing(spark, table):
    table.apply(frame(spark, (1, "a")), batch=("one", 0))
    table.apply(frame(spark, (1, "b")), batch=("two", 0))
    assert table.apply(frame(spark, (1, "a")), batch=("one", 0)) == 2
    assert held(table.read()) == {1: "b"}
    assert table.apply(frame(spark, (1, "c")), batch=("one", 1)) == 3


def test_a_killed_writer_and_one_that_comes_second(spark, table, monkeypatch):
    table.apply(frame(spark, (1, "a")))
    plain = Versions.commit

    def killed(self, number, state):
        raise KeyboardInterrupt

    monkeypatch.setattr(Versions, "commit", killed)
    with pytest.raises(KeyboardInterrupt):
        table.apply(frame(spark, (1, "lost"), (2, "lost")), batch=("w", 0))
    monkeypatch.setattr(Versions, "commit", plain)
    assert held(table.read()) == {1: "a"}
    # The other writer commits between this one's reading and its commit: this one goes again, after it.
    raced = []

    def overtaken(self, number, state):
        if not raced:
            raced.append(number)
            plain(self, number, {"parts": [*self.latest()[1]["parts"], {"at": number, "rows": other, "removed": None}], "batches": {"other": 0}})
        plain(self, number, state)

    other = "rows-other"
    frame(spark, (1, "other"), (3, "other")).write.parquet(f"{table.folder}/{other}")
    monkeypatch.setattr(Versions, "commit", overtaken)
    assert table.apply(frame(spark, (1, "mine"), (2, "mine")), batch=("w", 0)) == 3 and raced == [2]
    monkeypatch.setattr(Versions, "commit", plain)
    assert held(table.read()) == {1: "mine", 2: "mine", 3: "other"}
    with pytest.raises(Conflict):
        table.versions().commit(3, {})
    assert table.versions().numbers() == [1, 2, 3]


def test_a_stream_that_stops_and_goes_on(spark, table, tmp_path):
    folder = f"{tmp_path}/in"
    for part, rows in enumerate(([(1, "a"), (2, "b")], [(2, "c"), (3, "d")])):
        frame(spark, *rows).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        table.follow(stream, "stream", f"{tmp_path}/checkpoint").awaitTermination()
        # The same batch once more, as after a crash before the checkpoint was written.
        table.apply(frame(spark, *rows), batch=("stream", part))
    assert held(table.read()) == {1: "a", 2: "c", 3: "d"} and table.versions().numbers() == [1, 2]
