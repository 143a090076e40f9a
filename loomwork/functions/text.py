"""Text, token, vector, JSON and date column functions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a target.
STOP_WORDS = ("a", "an", "and", "for", "in", "is", "of", "on", "or", "the", "to", "with")


def target_tokens(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct lower-case ASCII words without stop words, and single CJK characters (a fixed range)."""
    low = F.lower(text)
    words = F.array_except(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0)), F.array(*map(F.lit, stop)))
    return F.array_union(words, F.regexp_extract_all(low, F.lit(r"[\x{4e00}-\x{9fff}]"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def conflict_score(a: Column, b: Column) -> Column:
    """Token Jaccard, at least 0.6 if one lower-cased text contains the other; not rounded."""
    inside = F.lower(a).contains(F.lower(b)) | F.lower(b).contains(F.lower(a))
    return F.greatest(jaccard(target_tokens(a), target_tokens(b)), F.when(inside, 0.6).otherwise(0.0))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of equal length, in double."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """A vector of length 1 in the same direction; zeros stay zeros."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x / norm))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of equal length, in double; 0 if either has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def meta_pairs(comment: Column) -> Column:
    """map of ``key=value`` pairs of a comment; values end at blanks; lists are parted by ``|``."""
    pairs = F.regexp_extract_all(comment, F.lit(r"([A-Za-z_]+)=([^\s]+)"), F.lit(0))
    entry = lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.split(F.substring(p, F.instr(p, "=") + 1, F.length(p)), r"\|").alias("v"))
    return F.map_from_entries(F.transform(pairs, entry))


def markdown_section(text: Column, heading: str) -> Column:
    """Body of a ``## heading`` up to the next heading of that level; null if it is absent."""
    body = F.regexp_extract(text, rf"(?s)(?:^|\n)## {heading}[ \t]*\n(.*?)(?=\n## |\z)", 1)
    return F.nullif(F.trim(body, F.lit(" \t\r\n")), F.lit(""))


def open_questions(text: Column) -> Column:
    """Lines of bullets that are no placeholders such as none or n/a."""
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x).rlike("^[-*] ")), lambda x: F.trim(F.regexp_replace(F.trim(x), "^[-*] +", "")))
    return F.filter(lines, lambda x: ~F.lower(F.regexp_replace(x, r"[\s.()]", "")).isin("none", "n/a", "na", "nothing", "tbd", "-", ""))


def text_match_query(text: Column, limit: int = 200) -> Column:
    """A user's words as a text query: punctuation becomes blanks."""
    return F.substring(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " ")), 1, limit)


def content_id(prefix: str, *parts: Column) -> Column:
    """An id from content: prefix and eight upper-case digits of SHA-1."""
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 8)))


def age_days(at: Column, now: Column) -> Column:
    """Days between two timestamps; null if either is."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000


def date_chunks(start: Column, end: Column, days: int | None) -> Column:
    """array of struct(start, end): half-open steps of ``days``, or calendar months with inclusive ends.

    A start at or after the end has none.  In month mode the last piece ends
    the day before ``end``.
    """
    if days:
        starts = F.sequence(start, F.date_sub(end, 1), F.expr(f"interval {days} day"))
        pieces = F.transform(starts, lambda d: F.struct(d.alias("start"), F.least(F.date_add(d, days), end).alias("end")))
    else:
        months = F.sequence(F.trunc(start, "month"), F.date_sub(end, 1), F.expr("interval 1 month"))
        pieces = F.transform(months, lambda m: F.struct(F.greatest(m, start).alias("start"), F.least(F.last_day(m), F.date_sub(end, 1)).alias("end")))
    return F.when(start < end, pieces).otherwise(F.array().cast("array<struct<start:date,end:date>>"))


def embed_text(target: Column, summary: Column, body: Column) -> Column:
    """Parts that are not empty, joined by bars, the body's beginning last."""
    blank = F.lit("")
    return F.concat_ws(" | ", F.nullif(target, blank), F.nullif(summary, blank), F.nullif(F.substring(body, 1, 500), blank))


def pack_floats(vector: Column) -> Column:
    """A vector of floats as little-endian bytes."""

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return pack(vector)


def unpack_floats(blob: Column) -> Column:
    """A vector from its little-endian bytes; null where their number is no multiple of four."""

    @F.pandas_udf("array<float>")
    def unpack(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))

    return unpack(blob)


def timestamp_or_null(raw: Column) -> Column:
    """A timestamp from ISO text, null where it is none."""
    return F.try_to_timestamp(F.trim(raw))


def heading(text: Column) -> Column:
    """The first heading in the first 500 characters: chapter, numbered, Markdown or capitals; null if there is none."""
    head = F.substring(text, 1, 500)
    patterns = (r"(?im)^(chapter \d+[^\n]*)$", r"(?m)^(\d+(?:\.\d+)* +[A-Z][^\n]*)$", r"(?m)^#+ +([^\n]+)$", r"(?m)^([A-Z][A-Z ]{4,})$")
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(head, p, 1)), F.lit("")) for p in patterns])


def without_boilerplate(text: Column, patterns: Sequence[str] = (r"(?im)^\s*page \d+( of \d+)?\s*$", r"(?im)^\s*confidential\s*$")) -> Column:
    """A text without the lines of page numbers and marks, and without runs of empty lines."""
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, "")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"), F.lit("\n"))


def short_target(text: Column, limit: int = 80) -> Column:
    """The first line, cut after its last sentence that fits, else at the limit."""
    line = F.trim(F.substring_index(text, "\n", 1))
    head = F.substring(line, 1, limit)
    cut = F.regexp_extract(head, r"^(.*[.;!?])(?:\s|$)", 1)
    return F.when(F.length(line) <= limit, line).when(cut != "", cut).otherwise(head)


def superseded_ids(text: Column, own: Column, pattern: str = r"[A-Z]-\d+") -> Column:
    """Distinct ids after the word supersedes, in order, the text's own left out."""
    lines = F.regexp_extract_all(text, F.lit(rf"(?i)supersedes[: ]+((?:{pattern}[, ]*)+)"), F.lit(1))
    return F.array_remove(F.array_distinct(F.regexp_extract_all(F.array_join(lines, " "), F.lit(pattern), F.lit(0))), own)


def meta_line(**parts: Column) -> Column:
    """``<!-- key=value ... -->`` of the parts that are not null; lists are joined by bars."""
    return F.concat(F.lit("<!-- "), F.concat_ws(" ", *[F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}="), v)) for k, v in parts.items()]), F.lit(" -->"))


def question_class(line: Column) -> Column:
    """blocking, decision, data or other, by the words of an open question."""
    low = F.lower(line)
    return F.when(low.rlike("block|cannot|must"), "blocking").when(low.rlike("decide|choose|whether"), "decision").when(low.rlike("data|missing|value"), "data").otherwise("other")
