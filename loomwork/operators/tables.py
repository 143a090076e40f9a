"""Upserts, gaps, carry-forward, reports and the multi-check quality audit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.plans.storage import materialize


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those of equal keys."""
    return table.join(changes, list(keys), "left_anti").unionByName(changes)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in this order."""
    return df.withColumn("_turn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_turn = 1").drop("_turn")


def append_new(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` and those of ``rows`` whose keys it does not have."""
    return table.unionByName(rows.join(table, list(keys), "left_anti"))


def with_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Schema evolution: adds the columns that are missing."""
    return df.withColumns({c: v for c, v in columns.items() if c not in df.columns})


def islands(df: DataFrame, keys: Sequence[str], at: str, longest: int | None = None) -> DataFrame:
    """Runs of consecutive integers per key: first, last, n; longer runs are split at ``longest``."""
    w = W.partitionBy(*keys).orderBy(at)
    # One sort serves all steps, and no task holds a table of its runs.
    here, inside = F.col(at), w.rowsBetween(W.unboundedPreceding, W.currentRow)
    apart = lambda x, y: F.coalesce(F.try_subtract(y, x) > 1, F.lit(True))
    once = df.select(*keys, at).withColumns({"_n": F.row_number().over(w), "_before": F.lag(at).over(w)})
    once = once.where((F.col("_n") == 1) | ~here.eqNullSafe(F.col("_before"))).withColumn("_after", F.lead(at).over(w))
    once = once.withColumns({"_first": apart(F.col("_before"), here), "_last": apart(here, F.col("_after"))})
    if longest:
        place = here - F.last(F.when(F.col("_first"), here), ignorenulls=True).over(inside)
        once = once.withColumn("_place", F.coalesce(place, F.lit(0)))
        once = once.withColumns({"_first": F.col("_first") | (F.col("_place") % longest == 0), "_last": F.col("_last") | ((F.col("_place") + 1) % longest == 0)})
    ends = once.where("_first or _last").withColumn("last", F.when(F.col("_last"), here).otherwise(F.lead(at).over(w)))
    n = F.coalesce(F.col("last").cast("long") - F.col("first").cast("long") + 1, F.lit(1).cast("long"))
    return ends.where("_first").select(*keys, here.alias("first"), "last").withColumn("n", n)


def gaps(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Missing stretches between the integers of each key: after, before, n."""
    w = W.partitionBy(*keys).orderBy(at)
    following = df.select(*keys, at).distinct().withColumn("before", F.lead(at).over(w))
    return following.where(F.col("before") - F.col(at) > 1).select(*keys, F.col(at).alias("after"), "before", (F.col("before") - F.col(at) - 1).alias("n"))


def carried(value: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    """The last value that is not null, up to this row."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))


def within_budget(size: Column, keys: Sequence[str], order: Sequence[str], budget: int) -> Column:
    """Whether the sizes up to this row fit a budget."""
    return F.sum(size).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) <= budget


def membership(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """key and one flag per named set: the basis of Venn counts and differences."""
    tagged = reduce(DataFrame.unionByName, [df.select(key).distinct().withColumn("_set", F.lit(name)) for name, df in sets.items()])
    return tagged.groupBy(key).agg(*[F.bool_or(F.col("_set") == name).alias(name) for name in sets])


def null_rates(df: DataFrame, limit: float = 0.05) -> DataFrame:
    """column_name, null_rate, flagged: one pass over the table."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns])
    long = rates.unpivot([], df.columns, "column_name", "null_rate")
    return long.withColumn("flagged", F.col("null_rate") > limit)


def duplicates(df: DataFrame) -> DataFrame:
    """Whole rows that occur more than once, and how often."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("n")).where("n > 1")


def domains(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, least, most, n_distinct (as text) of several columns, in one pass."""
    flat = [F.struct(F.lit(c).alias("column_name"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("most"), F.countDistinct(c).alias("n_distinct")) for c in columns]
    return df.agg(F.array(*flat).alias("rows")).select(F.inline("rows"))


def excluded_by(column: str, prefixes: Sequence[str]) -> Column:
    """The first prefix (case ignored) that excludes a row, or null."""
    return F.coalesce(*[F.when(F.col(column).ilike(f"{p}%"), p) for p in prefixes])


def exclusion_summary(df: DataFrame, key: str, rule: Column, samples: int = 5) -> DataFrame:
    """rule, n, sample of the smallest keys per rule: every task keeps its own smallest before they are dealt."""
    ruled = df.select(rule.alias("rule"), F.col(key).alias("key")).where("rule is not null")
    counted = ruled.groupBy("rule").agg(F.count("*").alias("n"))
    return counted.join(_smallest(ruled, "rule", "key", samples, "sample"), "rule")


def _smallest(df: DataFrame, group: str, value: str, n: int, name: str) -> DataFrame:
    """group, name: the ``n`` smallest values of each group, joined by commas; at most ``n`` of a task's rows are dealt."""
    turn = F.row_number().over(W.partitionBy(group).orderBy(value))
    first = df.withColumn("_turn", turn).where(F.col("_turn") <= n)
    return first.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_turn", value))), lambda x: x[value].cast("string")), ",").alias(name))


def not_in(df: DataFrame, key: str, listed: DataFrame, value: str) -> DataFrame:
    """Rows whose key is NOT IN the listed values, with SQL's nulls, by an anti join and one row about the list."""
    about = listed.agg(F.count("*").alias("_n"), F.count_if(F.col(value).isNull()).alias("_nulls"))
    kept = df.join(listed.select(F.col(value).alias("_value")), F.col(key) == F.col("_value"), "left_anti")
    allowed = (F.col("_nulls") == 0) & (F.col(key).isNotNull() | (F.col("_n") == 0))
    return kept.crossJoin(F.broadcast(about)).where(allowed).drop("_n", "_nulls")


ISSUE = "severity string, check string, key string, message string"


def issues(failing: DataFrame, severity: str, check: str, key: Column, message: Column | str) -> DataFrame:
    """Rows that fail a check as issues; checks are united by ``audit``."""
    message = F.lit(message) if isinstance(message, str) else message
    return failing.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), key.cast("string").alias("key"), message.alias("message"))


def audit(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def exit_code(found: DataFrame) -> DataFrame:
    """One row: 2 if any issue is an error, else 1 if any is a warning, else 0."""
    worst = F.max(F.when(F.col("severity") == "ERROR", 2).when(F.col("severity") == "WARN", 1).otherwise(0))
    return found.agg(F.coalesce(worst, F.lit(0)).alias("exit_code"))


def transitions(df: DataFrame, key: str, at: Sequence[str], status: str) -> DataFrame:
    """Rows at which a key's status differs from its row before, with that status."""
    before = F.lag(status).over(W.partitionBy(key).orderBy(*at))
    return df.withColumn("from_status", before).where(F.col("from_status").isNotNull() & (F.col("from_status") != F.col(status))).withColumn("to_status", F.col(status))


def cooling(result: Column, age: Column) -> Column:
    """Whether an evaluated candidate must wait, by its last result and the days since; an unknown age must wait."""
    wait = F.when(result == "proposed", F.lit(1e9)).when(result.isin("below_threshold", "failed", "unknown"), 30.0).when(result == "overlap", 7.0).when(result == "in_progress", 1.0).otherwise(0.0)
    return F.when(result.isNull(), False).otherwise((wait > 0) & F.coalesce(age < wait, F.lit(True)))


#: Rows that are equal in shape and stay together in one row.
ALIKE = 1_024


def overlapping(rects: DataFrame, cell: float, tolerance: float = 0.0) -> DataFrame:
    """Pairs of rectangles (id, page, x0, y0, x1, y1) of a page that overlap by more than ``tolerance`` both ways: a, b, area."""
    return overlap_shares(rects, cell, tolerance).select("a", "b", "area")


def overlap_shares(rects: DataFrame, cell: float, tolerance: float = 0.0) -> DataFrame:
    """a, b, area of ``overlapping`` and the share of the smaller rectangle that the area covers.

    Equal rectangles meet others once, as lists of at most ALIKE
    ids, and are told apart in the result alone.  Shapes meet in the grid
    cells that they touch, and a pair is reported in the cell of its
    overlap's lower corner alone; edges that only touch do not overlap.
    """
    shape = ["page", "x0", "y0", "x1", "y1"]
    placed = rects.where(reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in ("id", *shape)]))
    counts = placed.groupBy(*shape).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    shapes = materialize(placed.groupBy(*shape, F.pmod(F.xxhash64("id"), F.lit(-(-most // ALIKE) or 1)).alias("_k")).agg(F.collect_list("id").alias("ids")), "shapes")
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    gridded = shapes.withColumn("cx", cells("x0", "x1")).withColumn("cy", cells("y0", "y1"))
    a, b = gridded.alias("a"), gridded.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("page", "cx", "cy")]
    x, y = F.greatest("a.x0", "b.x0"), F.greatest("a.y0", "b.y0")
    corner = (F.floor(x / cell) == F.col("a.cx")) & (F.floor(y / cell) == F.col("a.cy"))
    w, h = F.least("a.x1", "b.x1") - x, F.least("a.y1", "b.y1") - y
    size = lambda r: (F.col(f"{r}.x1") - F.col(f"{r}.x0")) * (F.col(f"{r}.y1") - F.col(f"{r}.y0"))
    least = F.least(size("a"), size("b"))
    own = lambda r: F.struct(*[F.col(f"{r}.{c}") for c in (*shape, "_k")])
    met = a.join(b, [*same, own("a") <= own("b"), corner, w > tolerance, h > tolerance])
    met = met.select((w * h).alias("area"), F.when(least <= 0, 0.0).otherwise(w * h / least).alias("share"), F.col("a.ids").alias("left"), F.col("b.ids").alias("right"), (own("a") == own("b")).alias("one"))
    every = met.select("area", "share", "one", "right", F.explode("left").alias("p")).select("area", "share", "one", "p", F.explode("right").alias("q"))
    return every.where(F.when(F.col("one"), F.col("p") < F.col("q")).otherwise(F.col("p") != F.col("q"))).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "area", "share")


def table_counts(named: dict[str, DataFrame]) -> DataFrame:
    """table_name, n, columns of several tables."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n", F.lit(len(df.columns)).alias("columns")) for name, df in named.items()])


def next_id(df: DataFrame, ids: Column, prefix: str) -> DataFrame:
    """One row: the number after the greatest of ``PREFIX-nnn`` ids (as numbers, not as texts), and that id."""
    number = F.regexp_extract(ids, rf"^{prefix}-(\d+)$", 1).try_cast("long")
    return df.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next")).select("next", F.format_string(f"{prefix}-%03d", "next").alias("id"))


def sample_values(df: DataFrame, columns: Sequence[str], n: int = 3) -> DataFrame:
    """column_name, samples: the least distinct values of each column, as text."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "value").where("value is not null").distinct()
    return _smallest(long, "column_name", "value", n, "samples")


TRACKING = ("_operation_id", "_source_file", "_source_version", "_source_row")


def traceability(df: DataFrame, columns: Sequence[str] = TRACKING) -> DataFrame:
    """column_name, present, nulls of the tracking columns of an ingested batch."""
    have = [c for c in columns if c in df.columns]
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in have]) if have else df.agg(F.lit(0).alias("_none"))
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(c in have).alias("present"), (F.col(c) if c in have else F.lit(None).cast("long")).alias("nulls")) for c in columns]
    return counted.select(F.inline(F.array(*rows)))


def bands(lines: DataFrame) -> DataFrame:
    """page, top, bottom of the stretches between lines (page, y) of a page."""
    below = F.lead("y").over(W.partitionBy("page").orderBy("y"))
    return lines.select("page", "y").distinct().withColumn("bottom", below).where("bottom is not null").select("page", F.col("y").alias("top"), "bottom")


def top_details(df: DataFrame, group: str, order: Sequence[Column], key: str, n: int = 3) -> DataFrame:
    """group, n, detail: rows of each group and the first keys of an order."""
    turn = F.row_number().over(W.partitionBy(group).orderBy(*order))
    first = df.withColumn("_turn", turn).where(F.col("_turn") <= n).groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_turn", key))), lambda x: x[key].cast("string")), ",").alias("detail"))
    return df.groupBy(group).agg(F.count("*").alias("n")).join(first, group)


def stale(df: DataFrame, at: str, now: Column, days: float) -> Column:
    """Whether a time is null or older than so many days."""
    return F.col(at).isNull() | ((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 86_400_000_000 > days)


def responses(raw: Column) -> Column:
    """Checklist answers as an array of (id, evidence), from a JSON map of ids or a JSON list of objects with id and evidence."""
    listed = F.from_json(raw, "array<struct<id:string,evidence:string>>")
    mapped = F.from_json(raw, "map<string,string>")
    entries = F.transform(F.map_entries(mapped), lambda e: F.struct(e["key"].alias("id"), e["value"].alias("evidence")))
    return F.coalesce(F.when(F.ltrim(raw).startswith("["), listed), F.when(F.ltrim(raw).startswith("{"), entries), F.array().cast("array<struct<id:string,evidence:string>>"))
