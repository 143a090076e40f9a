"""Entries with nested definitions, JSON columns and Markdown bodies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import markdown_section
from loomwork.operators.tables import issues


def delegates(definitions: DataFrame, agents: DataFrame) -> DataFrame:
    """workflow, agent of the nodes of definitions (name, nodes array) that agents (id, agent) have."""
    nodes = definitions.select(F.col("name").alias("workflow"), F.explode("nodes").alias("id"))
    return nodes.join(agents, "id").select("workflow", "agent").distinct()


def mentioned(texts: DataFrame, key: str, text: str, pattern: str, names: DataFrame) -> DataFrame:
    """key, name of the matches of a pattern that names (name) have."""
    found = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("name"))
    return found.join(names, "name", "left_semi").select(key, "name")


def map_entries(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key column, key, value of a column that holds JSON objects; other text has no entries."""
    return rows.select(key, F.explode(F.from_json(json, "map<string,string>")).alias("key", "value"))


def excluded(df: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Rows that no rule holds for; a rule is a SQL predicate, and one that is null does not hold."""
    return reduce(lambda kept, rule: kept.where(~F.coalesce(F.expr(rule), F.lit(False))), rules, df)


def compact_schema(named: dict[str, DataFrame]) -> DataFrame:
    """One line a table: its name and columns."""
    spark = next(iter(named.values())).sparkSession
    return spark.createDataFrame([(f"{name}({', '.join(df.columns)})",) for name, df in named.items()], "schema string")


def bundle(parts: Sequence[DataFrame]) -> DataFrame:
    """part (from 1), line of several reports (line)."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("part"), "line") for k, df in enumerate(parts, 1)])


def sections(text: Column, names: Sequence[str]) -> Column:
    """struct of the bodies of the named sections."""
    return F.struct(*[markdown_section(text, n).alias(n) for n in names])


def missing_paths(rows: DataFrame, key: str, json: str, paths: Sequence[str], check: str) -> DataFrame:
    """Paths that a row's JSON does not have, one issue each."""
    lost = F.array_compact(F.array(*[F.when(F.get_json_object(json, f"$.{p}").isNull(), p) for p in paths]))
    return issues(rows.select(F.col(key).alias("_key"), F.explode(lost).alias("path")), "ERROR", check, F.col("_key"), F.concat(F.lit("no "), "path"))


def without_output(rows: DataFrame, key: str, outputs: str, required: Sequence[str], check: str = "artifact") -> DataFrame:
    """Rows none of whose outputs contains a required text, one issue for each."""

    def has(need: str) -> Column:
        return F.exists(outputs, lambda x: x.contains(need))

    lost = F.array_compact(F.array(*[F.when(~has(r), r) for r in required]))
    return issues(rows.select(F.col(key).alias("_key"), F.explode(lost).alias("need")), "ERROR", check, F.col("_key"), F.concat(F.lit("no "), "need"))
