"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.plans.storage import materialize, small_side


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours move to the least of them; ``large``: those above the node, else those below."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # Written first: the join then has two plain sides, and the neighbours of a large family's root can be split.
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    joined = both.join(small_side(least), "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of ``edges`` (u, v longs): root is the least node of its component.

    Self edges and repeated edges do no harm; nodes of self edges alone and
    rows with a null end are left out; no edges give no rows.  Each round is
    written out; the number of rounds grows with the logarithm of the longest
    path.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where(F.col("u") != F.col("v")).distinct()
    edges = materialize(edges, "edges")
    before = None
    for _ in range(rounds):
        edges = materialize(_stars(materialize(_stars(edges, True), "stars"), False), "stars")
        # Sums of hashes: equal for equal edge tables.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.col("v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v"))).distinct()
