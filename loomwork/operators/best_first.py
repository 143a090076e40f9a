"""Best-first search of cells by bound, with exact stopping, in waves of Spark jobs.

Every group (a query, a source) has cells with an upper bound of the values
inside them.  A wave opens each group's next cells in order of bound, and a
group is done once no unseen cell's bound reaches its k-th value: cells whose
bound equals it are still opened, as ties are decided by other columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.plans.storage import materialize

#: Cells that a group opens in the first wave; every later wave opens GROWTH times as many.
FIRST, GROWTH = 8, 8


def best_first(bounds: DataFrame, by: Sequence[str], k: int, evaluate: Callable[[DataFrame], DataFrame], ties: Sequence[Column], least: int = 1, first: int | None = None) -> DataFrame:
    """The ``k`` rows of highest ``value`` (at least ``least``) of each group, with their ``rank``.

    ``bounds`` has the columns ``by``, cell and bound and should read a written
    table.  ``evaluate`` takes the opened cells (``by``, cell) and returns all
    their rows with ``by`` and value; ``ties`` orders rows of equal value.
    """
    by, width, best, state = list(by), first or FIRST, None, None
    turn = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("bound"), "cell"))
    while True:
        left = bounds.where(F.col("bound") >= least)
        if state is not None:
            unseen = (F.col("bound") < F.col("_bound")) | ((F.col("bound") == F.col("_bound")) & (F.col("cell") > F.col("_cell")))
            left = left.join(state, by).where((F.col("bound") >= F.col("_kth")) & unseen)
        opened = materialize(left.select(*by, "cell", "bound", turn.alias("_turn")).where(F.col("_turn") <= width), "opened")
        if opened.isEmpty():
            return best if best is not None else _ranked(evaluate(opened.select(*by, "cell")), by, k, ties, least)
        found = evaluate(opened.select(*by, "cell"))
        best = materialize(_ranked(found if best is None else found.unionByName(best.drop("rank")), by, k, ties, least), "best")
        kth = best.where(F.col("rank") == k).select(*by, F.col("value").alias("_kth"))
        seen = opened.groupBy(*by).agg(F.max_by(F.struct("bound", "cell"), "_turn").alias("_last"))
        seen = seen.select(*by, F.col("_last.bound").alias("_bound"), F.col("_last.cell").alias("_cell"))
        state = materialize(seen.join(kth, by, "left").withColumn("_kth", F.coalesce("_kth", F.lit(least))), "state")
        width *= GROWTH


def _ranked(found: DataFrame, by: Sequence[str], k: int, ties: Sequence[Column], least: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("value"), *ties))
    return found.where(F.col("value") >= least).withColumn("rank", rank).where(F.col("rank") <= k)
