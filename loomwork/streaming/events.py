"""The event log as a stream: windowed counts, usage counters, and upserts per micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.tables import latest


def timed(events: DataFrame, at: str = "ts") -> DataFrame:
    """The time column with a zone, as watermarks need it."""
    return events.withColumn(at, F.col(at).cast("timestamp"))


def window_counts(events: DataFrame, size: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """start, event_type, n, total of tumbling or sliding windows; rows later than ``late`` are dropped in streams."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = timed(events).withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """user_id, start, stop, n: runs of a user's events with no larger gap."""
    found = timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def upsert_batches(folder: str, keys: Sequence[str], order: Sequence[str], keep: int = 2):
    """A foreachBatch function that keeps the latest row per key in ``folder``, one version a batch.

    A batch is written whole as ``folder/v<epoch>`` before it counts: Spark's
    committer leaves ``_SUCCESS`` last, and readers take the newest version
    that has it (``latest_version``).  The version of an epoch is made from
    that of an earlier one, so a batch that is replayed after a crash gives the
    same rows, and nothing is dropped before its successor stands.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        newest = latest(batch, keys, [F.desc(c) for c in order])
        before = latest_version(spark, folder, below=epoch)
        if before is not None:
            newest = latest(spark.read.schema(batch.schema).parquet(f"{folder}/v{before}").unionByName(newest), keys, [F.desc(c) for c in order])
        newest.write.mode("overwrite").parquet(f"{folder}/v{epoch}")
        path, files = _files(spark, folder)
        for old in sorted(v for v in _versions(spark, folder) if v <= epoch)[:-keep]:
            files.delete(path(f"{folder}/v{old}"), True)

    return run


def _files(spark: SparkSession, folder: str):
    """Paths and the file system of a folder that any of Spark's stores may hold."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path, files = _files(spark, folder)
    found = files.globStatus(path(f"{folder}/v*/_SUCCESS")) or []
    return [int(s.getPath().getParent().getName()[1:]) for s in found]


def latest_version(spark: SparkSession, folder: str, below: int | None = None) -> int | None:
    """The newest complete version (before ``below``); None if there is none."""
    return max((v for v in _versions(spark, folder) if below is None or v < below), default=None)
