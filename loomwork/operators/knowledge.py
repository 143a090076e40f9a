"""Maintenance of a knowledge graph: superseding, counters, reviews, scopes, references, readiness of entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def superseded(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (id, status, ...) with active ones that a supersedes edge points to marked superseded."""
    targets = edges.where("relation = 'supersedes'").select(F.col("target_id").alias("id"), F.lit(True).alias("_old")).distinct()
    status = F.when(F.col("_old") & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))
    return nodes.join(targets, "id", "left").withColumn("status", status).drop("_old")


def bumped(meta: Column, counter: str, by: Column) -> Column:
    """A JSON object of strings with a counter raised; text that is no object counts as an empty one."""
    values = F.coalesce(F.from_json(meta, "map<string,string>"), F.create_map().cast("map<string,string>"))
    old = F.coalesce(F.try_element_at(values, F.lit(counter)).try_cast("long"), F.lit(0).cast("long"))
    rest = F.map_filter(values, lambda k, _: k != counter)
    return F.to_json(F.map_concat(rest, F.create_map(F.lit(counter), (old + by).cast("string"))))


def guarded_edges(proposed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct ``proposed`` edges (source_id, target_id, relation) both of whose ends are nodes (id)."""
    ids = nodes.select("id").distinct()
    kept = proposed.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return kept.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id", "target_id", "relation").distinct()


def migrated(nodes: DataFrame, bodies: DataFrame) -> DataFrame:
    """id, body, matched of ``bodies`` (id, body): whether a node takes it."""
    return bodies.join(nodes.select("id", F.lit(True).alias("_own")).distinct(), "id", "left").select("id", "body", F.coalesce("_own", F.lit(False)).alias("matched"))


def project_label(project: Column) -> Column:
    """A project's path without leading ``./`` and ``/`` and the projects folder; null for a blank one."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(project), r"^(\./)+", ""), "^/+", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(clean, "^projects/", ""), "/+$", ""), F.lit(""))


def activation(workflows: Column, commands: Column, documents: Column) -> Column:
    """workflow, command, documented or orphan, by the first list of references that is not empty."""
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return F.when(has(workflows), "workflow").when(has(commands), "command").when(has(documents), "documented").otherwise("orphan")


def with_references(entries: DataFrame, references: DataFrame) -> DataFrame:
    """``entries`` (id) with their sorted references of ``references`` (id, kind, source) by kind, and their activation."""
    kinds = ("workflow", "command", "document")
    found = references.groupBy("id").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("source")))).alias(f"{k}_refs") for k in kinds])
    return entries.join(found, "id", "left").withColumn("activation", activation(*[F.col(f"{k}_refs") for k in kinds]))


def manifest_entry(paths: DataFrame, exact: DataFrame, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """``paths`` (path) with owner: that of the exact entry (path, owner), else of the first pattern that matches, else null."""
    fallback = F.lit(None).cast("string")
    for pattern, owner in reversed(patterns):
        fallback = F.when(F.col("path").rlike(pattern), owner).otherwise(fallback)
    return paths.join(exact.select("path", F.col("owner").alias("_exact")), "path", "left").select("path", F.coalesce("_exact", fallback).alias("owner"))


def exact_token(text: Column, token: str) -> Column:
    """Whether a text has a token that is not part of a longer word or hyphenated name."""
    quoted = "".join(c if c.isalnum() or c == "_" else f"\\{c}" for c in token)
    return text.rlike(rf"(?<![\w-]){quoted}(?![\w-])")


def mentions_any(text: Column, words: Sequence[str]) -> Column:
    """Whether a text, case ignored, contains any of the words."""
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.lower(text).contains(w))


def reviewed(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """``reviews`` (id, status) after ``decisions`` (id, approve, evidence, impact): an approval needs evidence and impact."""
    told = (F.trim(F.coalesce("evidence", F.lit(""))) != "") & (F.trim(F.coalesce("impact", F.lit(""))) != "")
    next_ = F.when(F.col("approve") & told, "approved").when(~F.col("approve"), "rejected")
    return reviews.join(decisions, "id", "left").select("id", F.coalesce(next_, "status").alias("status"))


def resolved(queries: DataFrame, modules: DataFrame) -> DataFrame:
    """query, path: the module of that path, else of that base name if it is unique, else that contains it if it is unique."""
    base = F.element_at(F.split("path", "/"), -1)
    met = queries.join(modules.select("path", base.alias("base")), F.col("path").contains(F.col("query")))
    rank = F.when(F.col("path") == F.col("query"), 1).when((F.col("base") == F.col("query")) | (F.col("base") == F.concat("query", F.lit(".py"))), 2).otherwise(3)
    each = met.withColumn("rank", rank).groupBy("query", "rank").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    best = each.groupBy("query").agg(F.min_by(F.struct("n", "path"), "rank").alias("b"))
    return best.where("b.n = 1").select("query", F.col("b.path").alias("path"))


def resolved_exactly(queries: DataFrame, modules: DataFrame) -> DataFrame:
    """query, path: the module of that path, else of that base name if it is unique; both by equality, for many queries."""
    base = F.element_at(F.split("path", "/"), -1)
    names = modules.select("path", F.explode(F.array_distinct(F.array("path", base))).alias("query")).withColumn("whole", F.col("query") == F.col("path"))
    each = queries.distinct().join(names, "query").groupBy("query", "whole").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    best = each.groupBy("query").agg(F.max_by(F.struct("n", "path"), "whole").alias("b"))
    return best.where("b.n = 1").select("query", F.col("b.path").alias("path"))


def attempts(events: DataFrame, most: int = 3) -> DataFrame:
    """node, tries, state, wait of attempt events (node, seq, ok, seconds, limit): done, retry after a doubling wait, or failed.

    An attempt over its time limit counts as one that failed; what follows a
    success does not count.
    """
    good = F.col("ok") & (F.col("seconds") <= F.col("limit"))
    first = F.min(F.when(good, F.col("seq"))).over(W.partitionBy("node"))
    counted = events.withColumn("first_ok", first).groupBy("node").agg(F.max("first_ok").alias("first_ok"), F.count_if(F.col("first_ok").isNull() | (F.col("seq") <= F.col("first_ok"))).cast("int").alias("tries"))
    state = F.when(F.col("first_ok").isNotNull(), "done").when(F.col("tries") >= most, "failed").otherwise("retry")
    return counted.select("node", "tries", state.alias("state"), F.when(state == "retry", F.pow(F.lit(2.0), F.col("tries") - 1)).alias("wait"))


def row_json(*columns: str, limit: int = 300) -> Column:
    """A row as JSON without nulls; texts are cut at ``limit`` characters, as the report shows them."""
    return F.to_json(F.struct(*[F.substring(F.col(c).cast("string"), 1, limit).alias(c) for c in columns]))
