"""Where intermediate tables go: the shared folder that the cluster names.

``materialize`` is the one way this library cuts lineage.  It writes Parquet
below ``spark.checkpoint.dir`` and reads it back, so a lost executor costs a
re-read and never the recomputation of a long plan, and nothing lands in a
folder that only one machine can see.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where it is unset (tests)."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loomwork-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_in_groups(df: DataFrame, name: str = "step", size: int = 16 << 20) -> DataFrame:
    """The same in row groups of about ``size`` bytes, so that many tasks can read what one task has written."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", size).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A join side of few narrow columns, broadcast if it has at most ``most`` rows; otherwise as it is.

    ``df`` should read a written table, as its rows are counted first.
    """
    return F.broadcast(df) if df.count() <= most else df


def shuffled(df: DataFrame) -> DataFrame:
    """A join side that is never broadcast.

    Spark goes by a table's size on disk, which packed columns make many times
    smaller than the table that each broadcast builds in the driver.
    """
    return df.hint("merge")
