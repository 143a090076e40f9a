"""Logs and dated reports that grow: read once each, through stops; bad lines are counted, not lost."""

import json

from loomwork.operators.versioned import VersionedTable
from loomwork.sources import ranges
from loomwork.streaming.logs import LogReader

SCHEMA = "id long, kind string, at timestamp"


def test_a_log_is_read_once_and_bad_lines_are_kept(spark, tmp_path):
    source = tmp_path / "log"
    source.mkdir()
    line = lambda k, kind="a": json.dumps({"id": k, "kind": kind, "at": "2024-01-01T00:00:00"})
    (source / "one.jsonl").write_text("\n".join([line(1), "", "no json", line(2), '{"id": "x"}', '{"kind": "no id"}', "no json", line(3)[:-9]]))
    reader = LogReader(spark, str(source), f"{tmp_path}/kept", SCHEMA, ("id",), files=1)
    reader.catch_up()
    assert {r.id for r in reader.rows.read().collect()} == {1, 2}
    reader.catch_up()
    (source / "deeper").mkdir()
    (source / "deeper" / "two.jsonl").write_text("\n".join([line(2, "b"), line(4), "[1]"]))
    (source / "three.jsonl").write_text("\n".join([line(5)]))
    LogReader(spark, str(source), f"{tmp_path}/kept", SCHEMA, ("id",), files=1).catch_up()
    assert {(r.id, r.kind) for r in reader.rows.read().collect()} == {(1, "a"), (2, "b"), (4, "a"), (5, "a")}
    bad = {(r.path[-9:], r.line): r.n for r in reader.rejects.read().collect()}
    assert bad == {("one.jsonl", "no json"): 2, ("one.jsonl", '{"id": "x"}'): 1, ("one.jsonl", '{"kind": "no id"}'): 1, ("one.jsonl", line(3)[:-9]): 1, ("two.jsonl", "[1]"): 1}
    # The last batch once more, as after a crash before its checkpoint.
    before = reader.rows.versions().latest()[0]
    reader._batch(spark.createDataFrame([(line(9), "x")], "value string, path string"), 0)
    assert reader.rows.versions().latest()[0] == before


def test_dated_reports_go_on_where_they_stopped(spark, tmp_path):
    def fetch(start, end, options):
        yield start.isoformat(), (end - start).days

    spark.dataSource.register(ranges.date_ranges("reports", "start string, days int", fetch))
    table = VersionedTable(spark, f"{tmp_path}/out", "start string, days int", ["start"])

    def run(end):
        stream = spark.readStream.format("reports").option("start", "2024-01-01").option("end", end).option("days", "7").load()
        table.follow(stream, "reports", f"{tmp_path}/checkpoint").awaitTermination()
        return sorted((r.start, r.days) for r in table.read().collect())

    assert run("2024-01-10") == [("2024-01-01", 7), ("2024-01-08", 2)]
    assert run("2024-01-10") == [("2024-01-01", 7), ("2024-01-08", 2)]
    assert run("2024-01-20") == [("2024-01-01", 7), ("2024-01-08", 2), ("2024-01-10", 7), ("2024-01-17", 3)]
