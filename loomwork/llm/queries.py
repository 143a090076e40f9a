"""The queries of this subpackage: each runs its operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import divergence, line_dedup, secrets
from loomwork.llm import quality_rules as quality
from loomwork.llm.decontamination import contamination
from loomwork.llm.jaccard_join import jaccard_components
from loomwork.llm.licenses import license_scan
from loomwork.llm.packing import pack
from loomwork.llm.personal_data import personal_data
from loomwork.llm.ranked_search import ranked_search
from loomwork.llm.repeats import remove_repeats
from loomwork.llm.token_counts import token_counts
from loomwork.llm.toxicity import toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"), threshold=0.3)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=4096)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_documents(spark, sf_dir), host="source")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir), percent=80)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir), length=200).drop("text")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_documents(spark, sf_dir), unknown=True)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"), threshold=0.8)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_documents(spark, sf_dir))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"), k=20)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_documents(spark, sf_dir), least_docs=30, k=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_secrets": op3_secrets,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_repeats": op8_repeats,
    "op9_licenses": op9_licenses,
    "op10_decontamination": op10_decontamination,
    "op11_personal_data": op11_personal_data,
    "op12_ranked_search": op12_ranked_search,
    "op13_divergence": op13_divergence,
}

ORACLES: dict[str, str] = {
    "op3_secrets": secrets.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
