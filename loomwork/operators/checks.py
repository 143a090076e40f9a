"""Checks of entries, logs and files: each gives a DataFrame of issues (severity, check, key, message)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.ordering import gaps
from loomwork.operators.tables import issues


def numbering(entries: DataFrame, number: Column, check: str = "numbering") -> DataFrame:
    """Missing and repeated numbers of a sequence over the whole table."""
    numbered = entries.select(number.alias("number"))
    missing = issues(gaps(numbered, "number"), "ERROR", check, F.col("after") + 1, F.concat(F.col("n").cast("string"), F.lit(" missing")))
    twice = numbered.groupBy("number").count().where("count > 1")
    return missing.unionByName(issues(twice, "ERROR", check, F.col("number"), F.concat(F.col("count").cast("string"), F.lit(" times"))))


def dangling(edges: DataFrame, nodes: DataFrame, end: str, check: str = "dangling") -> DataFrame:
    """Ends of edges that no node has."""
    lost = edges.select(F.col(end).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return issues(lost, "ERROR", check, F.col("id"), f"no such {end}")


def required(entries: DataFrame, key: str, fields: Sequence[str], check: str = "fields") -> DataFrame:
    """Entries with a blank required field, one issue a field."""
    blank = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", c) for c in fields]))
    lost = entries.select(F.col(key).alias("_key"), F.explode(blank).alias("field"))
    return issues(lost, "WARN", check, F.col("_key"), F.concat(F.lit("no "), "field"))


def repeated_headings(files: DataFrame, key: str, text: str, check: str = "headings") -> DataFrame:
    """Headings that stand more than once in a file."""
    lines = files.select(F.col(key).alias("_key"), F.explode(F.split(text, "\n")).alias("line")).where(F.col("line").rlike("^#+ "))
    twice = lines.groupBy("_key", "line").count().where("count > 1")
    return issues(twice, "WARN", check, F.col("_key"), F.col("line"))


def missing_sections(files: DataFrame, key: str, text: str, sections: Sequence[str], check: str = "sections") -> DataFrame:
    """Sections that a file does not have."""
    lost = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(text).rlike(rf"(?m)^#+ {s}\s*$"), F.lit(False)), s) for s in sections]))
    return issues(files.select(F.col(key).alias("_key"), F.explode(lost).alias("section")), "ERROR", check, F.col("_key"), F.concat(F.lit("no "), "section"))


def pattern_issues(files: DataFrame, key: str, text: str, rules: dict[str, str], check: str = "patterns", severity: str = "WARN") -> DataFrame:
    """Lines that match a rule's pattern: stale names, legacy paths, tables that must not be read."""
    lines = files.select(F.col(key).alias("_key"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    hit = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), name) for name, p in rules.items()]))
    found = lines.select("_key", "pos", F.explode(hit).alias("rule"))
    return issues(found, severity, check, F.concat_ws(":", F.col("_key").cast("string"), (F.col("pos") + 1).cast("string")), F.col("rule"))


def long_files(files: DataFrame, key: str, text: str, most: int = 200, check: str = "length") -> DataFrame:
    """Files of more lines than ``most``."""
    sized = files.select(F.col(key).alias("_key"), F.size(F.split(text, "\n")).alias("n")).where(F.col("n") > most)
    return issues(sized, "WARN", check, F.col("_key"), F.concat(F.col("n").cast("string"), F.lit(" lines")))


def checksum_mismatch(read: DataFrame, exported: DataFrame, key: str, check: str = "checksum") -> DataFrame:
    """What was read (key, sha) against what was exported (key, text): other sums, or none at all."""
    own = exported.select(F.col(key).alias("_key"), F.sha2("text", 256).alias("_want"))
    met = own.join(read.select(F.col(key).alias("_key"), "sha"), "_key", "left").where(~F.col("_want").eqNullSafe(F.col("sha")))
    return issues(met, "ERROR", check, F.col("_key"), F.when(F.col("sha").isNull(), "not read").otherwise("another version"))


def too_old(exports: DataFrame, upstream: DataFrame, key: str, check: str = "freshness") -> DataFrame:
    """Exports (key, at) older than the newest of their upstream rows (key, at)."""
    newest = upstream.groupBy(F.col(key).alias("_key")).agg(F.max("at").alias("newest"))
    behind = exports.select(F.col(key).alias("_key"), "at").join(newest, "_key").where("at < newest")
    return issues(behind, "WARN", check, F.col("_key"), "older than its source")


def candidate_names(candidates: DataFrame, key: str, name: Column, check: str = "candidate") -> DataFrame:
    """Candidates whose suggested name is not in kebab case."""
    wrong = candidates.select(F.col(key).alias("_key"), name.alias("name")).where(~F.coalesce(F.col("name").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False)))
    return issues(wrong, "ERROR", check, F.col("_key"), F.concat(F.lit("not a name: "), F.coalesce("name", F.lit(""))))


def too_many(files: DataFrame, folder: Column, pattern: str, warn: int, error: int, check: str = "hygiene") -> DataFrame:
    """Folders with more temporary files (path) than allowed."""
    counted = files.where(F.col("path").rlike(pattern)).groupBy(folder.alias("folder")).agg(F.count("*").alias("n")).where(F.col("n") > warn)
    severity = F.when(F.col("n") > error, "ERROR").otherwise("WARN")
    return counted.select(severity.alias("severity"), F.lit(check).alias("check"), F.col("folder").cast("string").alias("key"), F.concat(F.col("n").cast("string"), F.lit(" files")).alias("message"))


def worst(found: DataFrame) -> DataFrame:
    """severity, n: issues by severity, for a report that is silent when there are none."""
    return found.groupBy("severity").agg(F.count("*").alias("n"))
