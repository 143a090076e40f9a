"""One order over a whole table, without a task that sees all rows.

Rows are dealt by ranges of the order and sorted inside their partitions; a
table with one row per partition carries counts, sums and last values across
the boundaries, so only that table (as long as there are partitions) is ever
in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.plans.storage import materialize

#: Bits of ``monotonically_increasing_id`` that number a partition's rows.
_BITS = 33


def _placed(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` written in order, with ``_part`` and ``_row``."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    written = materialize(dealt, "ordered")
    return written.withColumns({"_part": F.shiftright("_at", _BITS), "_row": F.col("_at").bitwiseAND((1 << _BITS) - 1)}).drop("_at")


def _earlier(parts: DataFrame, **sums: Column) -> DataFrame:
    """Per partition of the table the given window expressions over the partitions before it; one row a partition."""
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return F.broadcast(parts.select("_part", *[c.over(before).alias(name) for name, c in sums.items()]))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "number", start: int = 1) -> DataFrame:
    """``df`` with consecutive numbers in this order; rows that are equal in it are numbered in any order."""
    placed = _placed(df, order)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = _earlier(counts, _before=F.sum("_n"))
    return placed.join(offsets, "_part").withColumn(name, (F.col("_row") + F.coalesce("_before", F.lit(0)) + start).cast("long")).select(*df.columns, name)


def running_sum(df: DataFrame, order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows up to each, nulls as 0."""
    placed = _placed(df, order)
    totals = placed.groupBy("_part").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    offsets = _earlier(totals, _before=F.sum("_sum"))
    inner = W.partitionBy("_part").orderBy("_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = placed.withColumn("_own", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(offsets, "_part")
    return summed.withColumn(name, F.col("_own") + F.coalesce("_before", F.lit(0))).select(*df.columns, name)


def carried_forward(df: DataFrame, order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """``df`` with the last ``value`` that is not null, up to each row."""
    placed = _placed(df, order)
    lasts = placed.groupBy("_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_row"))).alias("_last"))
    offsets = _earlier(lasts, _before=F.last("_last", ignorenulls=True))
    inner = W.partitionBy("_part").orderBy("_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = placed.withColumn("_own", F.last(value, ignorenulls=True).over(inner)).join(offsets, "_part")
    return seen.withColumn(name, F.coalesce("_own", "_before")).select(*df.columns, name)


def runs(df: DataFrame, at: str) -> DataFrame:
    """first, last, n of the runs of consecutive integers of a whole column; nulls and repeats aside."""
    values = numbered(df.select(F.col(at).cast("long").alias("v")).where("v is not null").distinct(), ["v"], "k")
    return values.groupBy(F.col("v") - F.col("k")).agg(F.min("v").alias("first"), F.max("v").alias("last"), F.count("*").alias("n")).select("first", "last", "n")


def gaps(df: DataFrame, at: str) -> DataFrame:
    """after, before, n of the stretches that lack between the integers of a whole column."""
    found = materialize(numbered(runs(df, at), ["first"], "k"), "runs")
    following = found.select((F.col("k") - 1).alias("k"), F.col("first").alias("before"))
    met = found.select("k", F.col("last").alias("after")).join(following, "k")
    return met.select("after", "before", (F.col("before") - F.col("after") - 1).alias("n"))


def with_new_ids(df: DataFrame, rows: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """``rows`` with consecutive ids after the greatest ``key`` of ``df``, in this order."""
    greatest = df.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("_most"))
    ordered = numbered(rows, order, "_k")
    return ordered.crossJoin(F.broadcast(greatest)).withColumn(key, F.col("_k") + F.col("_most")).drop("_k", "_most")  # one row
