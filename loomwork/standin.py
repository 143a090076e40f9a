"""The driver tables seen as the domain's: nodes, edges, entities and relations, lots and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a task of a deal by keys gets, about.
SHARE = 250_000


class Tables:
    """Tables of a folder by name, and views of them that several queries share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def nodes(self) -> DataFrame:
        """Documents and labels as nodes: status from the labels, target and summary are its first line and the text."""
        labels = self.labels.select("doc_id", "quality", "toxic")
        status = F.when(F.col("toxic").isNull(), "draft").when(F.col("toxic") == 1, "superseded").when(F.col("quality") == 1, "active").otherwise("stale")
        return self.documents.join(labels, "doc_id", "left").select(
            F.col("doc_id").alias("id"), F.col("source").alias("node_type"), F.col("lang").alias("project"), status.alias("status"),
            F.substring_index("text", "\n", 1).alias("target"), F.col("text").alias("summary"), "n_chars",
        )

    def relations(self) -> DataFrame:
        """Distinct supplier to part relations; a task sorts about SHARE rows and holds no table of them."""
        keys = ["l_suppkey", "l_partkey"]
        rows = self.lineitem.select(*keys)
        dealt = rows.repartition(1 + rows.count() // SHARE, *keys)
        return dealt.withColumn("_turn", F.row_number().over(W.partitionBy(*keys).orderBy(*keys))).where("_turn = 1").drop("_turn")

    def edges(self) -> DataFrame:
        """(u, v) both ways between suppliers and parts."""
        one = self.relations().select(F.concat(F.lit("S:"), "l_suppkey").alias("u"), F.concat(F.lit("P:"), "l_partkey").alias("v"))
        return one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v")))
