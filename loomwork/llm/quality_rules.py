"""Quality rules with host verdicts: rule failures per host, shrunk by an empirical beta prior.

A document's own measures come from one pass over its text, inside the JVM.
Failures are summed per host (partial sums first, so a host with a third of
all rows costs no more than another), the spread between hosts gives a beta
prior, and each host's shrunken failure rate decides how much a document of
that host may be forgiven.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.plans.storage import materialize

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Limits:
    """Per cent of words or lines, first for any host, then for a watched one; rates are shares of a host's documents."""

    least_words: int = 10
    most_repeat_words: int = 20
    symbols: tuple[int, int] = (25, 10)
    shouts: tuple[int, int] = (50, 20)
    dup_lines: tuple[int, int] = (40, 25)
    mean_word: tuple[float, float] = (2.0, 20.0)
    watched_rate: float = 0.35
    blocked_rate: float = 0.75


def _words(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def measures(docs: DataFrame, kept: list[str]) -> DataFrame:
    """Counts of every row's text besides the columns ``kept``; null text counts as empty.

    n_repeat_words counts the words inside any five-word window that occurs at
    least twice in the text: equal windows meet by sorting (window, position),
    then neighbouring positions tell how many new words each window covers.
    """
    text = F.coalesce("text", F.lit(""))
    read = docs.select(*kept, text.alias("_text"), _words(text).alias("_words"), F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(BLANKS)) != "").alias("_lines"))
    n = F.size("_words")
    windows = F.transform(F.slice("_words", 1, F.greatest(n - WINDOW + 1, F.lit(0))), lambda _, i: F.array_join(F.slice("_words", i + 1, WINDOW), " "))
    counted = read.select(
        *kept,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_text") - F.length(F.translate("_text", "!", ""))).cast("long").alias("n_shouts"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
    )
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = counted.withColumn("_sorted", F.when(repeated, F.sort_array(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    same = lambda x, i: F.coalesce(F.get("_sorted", i)["w"] == x["w"], F.lit(False))
    places = ordered.withColumn("_places", F.sort_array(F.transform(F.filter("_sorted", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("words"))
    covered = F.aggregate("_places", start, lambda s, p: F.struct(p.alias("last"), (s["words"] + F.least(F.lit(WINDOW), p - s["last"])).alias("words")))["words"]
    return places.select(*kept, "n_words", "word_chars", "n_symbols", "n_shouts", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _judged(measured: DataFrame, limits: Limits) -> DataFrame:
    """hard_failed: rules failed at the limits for any host; soft_failed: at those for a watched one."""
    words = F.col("n_words")
    base = (words < limits.least_words) | (100 * F.col("n_repeat_words") > limits.most_repeat_words * words)
    mean = F.coalesce(F.col("word_chars") / F.nullif(words, F.lit(0)), F.lit(0.0)).between(*limits.mean_word)

    def failed(k: int) -> Column:
        rules = [
            100 * F.col("n_symbols") > limits.symbols[k] * words,
            100 * F.col("n_shouts") > limits.shouts[k] * words,
            100 * F.col("n_dup_lines") > limits.dup_lines[k] * F.col("n_lines"),
            ~mean,
        ]
        return sum((r.cast("int") for r in rules), F.lit(0))

    return measured.withColumns({"base_failed": base, "hard_failed": failed(0), "soft_failed": failed(1)})


def host_verdicts(judged: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """host, n, failed, rate (shrunken), verdict: trusted, watched or blocked.

    The prior's mean is the overall failure rate, its strength the method of
    moments on the between-host variance, kept within 2 to 1000 documents.
    """
    bad = F.col("base_failed") | (F.col("hard_failed") > 0)
    hosts = materialize(judged.groupBy("host").agg(F.count("*").alias("n"), F.count_if(bad).alias("failed")), "hosts")
    row = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares")).first()
    n, mean = row["n"] or 1, (row["failed"] or 0) / (row["n"] or 1)
    noise = mean * (1 - mean)
    between = (row["squares"] or 0.0) / n - mean * mean - noise * row["hosts"] / n
    strength = min(1000.0, max(2.0, noise / between - 1)) if between > 0 else 1000.0
    rate = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    verdict = F.when(rate > limits.blocked_rate, "blocked").when(rate > limits.watched_rate, "watched").otherwise("trusted")
    return hosts.withColumns({"rate": rate, "verdict": verdict})


def quality_rules(docs: DataFrame, host: Column | str = "source", limits: Limits = Limits(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Measures and verdict of every row of ``docs`` (doc_id, text, a host column).

    kept is false for a base failure, for a blocked host, for any rule failed
    at the limits for all hosts, and on a watched host at its tighter limits.  Null text is empty and fails; a null
    host is a host of its own; equal rows are judged one by one; the columns
    ``keep`` come along, others are ignored; no rows give no rows.
    """
    host = F.col(host) if isinstance(host, str) else host
    # Not the given names: the table may have columns of these names itself.
    slim = docs.select(F.col("doc_id").alias("doc_id"), host.cast("string").alias("host"), F.col("text").cast("string").alias("text"), *keep)
    judged = materialize(_judged(measures(slim, ["doc_id", "host", *keep]), limits), "quality")
    hosts = host_verdicts(judged, limits).select(F.col("host").alias("_host"), "verdict")
    joined = judged.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left")
    spared = (F.col("hard_failed") == 0) & ((F.col("verdict") != "watched") | (F.col("soft_failed") == 0))
    kept = ~F.col("base_failed") & (F.col("verdict") != "blocked") & spared
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "hard_failed", "soft_failed", F.col("verdict").alias("host_verdict"), *keep)


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, doc_id, source, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT r, i, list_slice(ws, i, i + 4) AS five FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
d AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, five) > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM d, range(5) AS o(k) GROUP BY r),
m AS (SELECT doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             length(regexp_replace(x, '[^!]', '', 'g')) AS n_shouts, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN p USING (r)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             (100 * n_symbols > 25 * n_words)::INT + (100 * n_shouts > 50 * n_words)::INT + (100 * n_dup_lines > 40 * n_lines)::INT
             + (NOT coalesce(word_chars / nullif(n_words, 0)::DOUBLE, 0) BETWEEN 2 AND 20)::INT AS hard_failed,
             (100 * n_symbols > 10 * n_words)::INT + (100 * n_shouts > 20 * n_words)::INT + (100 * n_dup_lines > 25 * n_lines)::INT
             + (NOT coalesce(word_chars / nullif(n_words, 0)::DOUBLE, 0) BETWEEN 2 AND 20)::INT AS soft_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR hard_failed > 0) AS failed FROM j GROUP BY source),
s AS (SELECT sum(failed)::DOUBLE / sum(n) AS mean, count(*)::DOUBLE / sum(n) AS per, sum(failed * failed / n::DOUBLE) / sum(n) AS sq FROM h),
k AS (SELECT mean, CASE WHEN sq - mean * mean - mean * (1 - mean) * per > 0
             THEN least(1000, greatest(2, mean * (1 - mean) / (sq - mean * mean - mean * (1 - mean) * per) - 1)) ELSE 1000 END AS strength FROM s),
v AS (SELECT source, CASE WHEN (failed + mean * strength) / (n + strength) > 0.75 THEN 'blocked'
             WHEN (failed + mean * strength) / (n + strength) > 0.35 THEN 'watched' ELSE 'trusted' END AS verdict FROM h, k)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND verdict <> 'blocked' AND hard_failed = 0 AND (verdict <> 'watched' OR soft_failed = 0) AS kept,
       hard_failed::INT AS hard_failed,
       soft_failed::INT AS soft_failed, verdict AS host_verdict
FROM j JOIN v ON j.source IS NOT DISTINCT FROM v.source
"""
