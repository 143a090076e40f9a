"""The corpus pipeline: quality rules, line dedup, near copies, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.decontamination import contamination
from loomwork.llm.jaccard_join import one_of_each
from loomwork.llm.line_dedup import dedup_lines
from loomwork.llm.names import fresh
from loomwork.llm.packing import pack
from loomwork.llm.quality_rules import quality_rules
from loomwork.plans.storage import materialize, small_side


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by id and text, as an id may repeat."""
    a, b = fresh(docs.columns, "_k1", "_k2")
    keyed = docs.withColumns({a: F.xxhash64("doc_id", "text"), b: F.xxhash64("text", F.lit(7), "doc_id")})
    rejected = materialize(quality_rules(keyed, host="source", keep=(a, b)).where("not kept").select(a, b).distinct(), "rejected")
    return keyed.join(small_side(rejected), [a, b], "left_anti").select(*docs.columns)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go, documents stay, even those that have no other line."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    (row,) = fresh(docs.columns, "_row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    found = contamination(keyed.select(F.col(row).alias("doc_id"), "text"), benchmark, threshold=0.8)
    leaked = materialize(found.select(F.col("doc_id").alias(row)).distinct(), "leaked")
    return keyed.join(small_side(leaked), row, "left_anti").select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_recurring_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_documents),
]

#: Tokenization and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
