"""Text logs and documents: blocks by heading, Markdown sections, references in pages, registries, event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions.parsing import classify


def read_whole(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, text: one row per file."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def blocks(files: DataFrame, id_pattern: str, keep: Sequence[str] = ("path",)) -> DataFrame:
    """id, title, body, pos of ``### ID title`` blocks; text before the first heading is left out."""
    parts = F.split("text", rf"(?m)^(?=### {id_pattern}\b)")
    found = files.select(*keep, F.posexplode(parts).alias("pos", "block")).where(F.col("block").rlike(rf"^### {id_pattern}\b"))
    first = F.substring_index("block", "\n", 1)
    return found.select(
        *keep, "pos",
        F.regexp_extract(first, rf"^### ({id_pattern})", 1).alias("id"),
        F.trim(F.regexp_replace(first, rf"^### {id_pattern}[ :-]*", "")).alias("title"),
        F.trim(F.substring(F.col("block"), F.length(first) + 2, F.length("block"))).alias("body"),
    )


def block_edges(found: DataFrame, relations: dict[str, str]) -> DataFrame:
    """source_id, target_id, relation from ``key=ID|ID`` pairs of the blocks' comment lines."""
    legs = []
    for key, relation in relations.items():
        listed = F.regexp_extract("body", rf"{key}=([A-Za-z0-9|_-]+)", 1)
        legs.append(found.where(listed != "").select(F.col("id").alias("source_id"), F.explode(F.split(listed, r"\|")).alias("target_id"), F.lit(relation).alias("relation")))
    out = legs[0]
    for leg in legs[1:]:
        out = out.unionByName(leg)
    return out.where("target_id <> ''").distinct()


def sections(lines: DataFrame, key: str, order: str, line: str, rules: Sequence[tuple[str, str]], least_words: int = 5) -> DataFrame:
    """Markdown lines to sections: chapter, title, pages, content, class.

    Only ``## `` opens a section; ``<!-- page N -->`` lines set the page and go;
    a section starts on the last page seen; a chapter holds until the next;
    sections of fewer than ``least_words`` words go; the class is the first
    rule that the title and the first 200 characters match.
    """
    w = W.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    page = F.regexp_extract(line, r"^<!-- page (\d+) -->$", 1).try_cast("int")
    marked = lines.withColumns({"_page": page, "_title": F.nullif(F.regexp_extract(line, r"^## (.+)$", 1), F.lit(""))})
    placed = marked.withColumns({"_at": F.last("_page", True).over(upto), "_section": F.sum(F.col("_title").isNotNull().cast("int")).over(upto)})
    body = F.when(F.col("_page").isNull() & F.col("_title").isNull(), F.struct(F.col(order).alias("o"), F.col(line).alias("t")))
    grouped = placed.where("_section > 0").groupBy(key, "_section").agg(
        F.max("_title").alias("title"),
        F.min_by("_at", order).alias("page_start"),
        F.max("_at").alias("page_end"),
        F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(body)), lambda x: x["t"]), "\n")).alias("content"),
    )
    chapter = F.nullif(F.regexp_extract("title", r"(?i)^(chapter \d+|\d+\.? )", 0), F.lit(""))
    held = F.last(F.when(chapter.isNotNull(), F.col("title")), True).over(W.partitionBy(key).orderBy("_section").rowsBetween(W.unboundedPreceding, W.currentRow))
    n = F.size(F.filter(F.split("content", r"\s+"), lambda x: x != ""))
    out = grouped.withColumns({"chapter": held, "word_count": n}).where(F.col("word_count") >= least_words)
    kind = classify(F.concat_ws(" ", "title", F.substring("content", 1, 200)), rules, "other")
    return out.select(key, "chapter", "title", "page_start", "page_end", "content", kind.alias("content_type"), "word_count", source_page(F.col("page_start"), F.col("page_end")).alias("source_page"))


def source_page(start: Column, end: Column) -> Column:
    """``pA-B``, ``pA`` for one page or no end, null without a start."""
    one = F.concat(F.lit("p"), start)
    return F.when(end.isNull() | (end == start), one).otherwise(F.concat(one, F.lit("-"), end))


def page_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, href: distinct links of HTML pages."""
    return pages.select(key, F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1)))).alias("href"))


def referenced(lines: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """key, line, ref: every match with its line number from 1."""
    each = lines.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "_line"))
    return each.select(key, (F.col("pos") + 1).alias("line"), F.explode(F.regexp_extract_all("_line", F.lit(pattern), F.lit(0))).alias("ref"))


def registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entities of a registry document, one row each."""
    return spark.read.schema(f"entities array<{schema}>").option("multiLine", True).json(path).select(F.inline("entities"))


def event_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
