"""Audit of how the sources of a language part from it and from each other.

Every source of a language gives each kept term a smoothed share ``p`` in
integer thousand-millionths.  Two reports come from one table of postings
(language, term, and the counts of the sources that have it):

* terms: the terms that a source has most above its language.  A source's
  terms lie in buckets of like counts.  The greatest count of a bucket and the
  least count that its terms have in the language bound every value in it, so
  buckets are opened best first until no unseen one can reach the k-th value;
* pairs: the sums of differences of two sources over all kept terms.  Only
  terms that both have need both counts, and postings give them; terms of one
  source alone are summed against the other's share of absent terms, from a
  histogram of shares; terms of neither are counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.operators.best_first import best_first
from loomwork.llm.terms import LETTERS, terms_of
from loomwork.plans.storage import materialize

SCALE, SMOOTHING = 1_000_000_000, 5
#: A task hands on its partial counts when it holds so many terms or has read so many bytes.
FLUSH, FLUSH_BYTES = 400_000, 200 << 20
#: Differences that are computed at once, and sums of pairs that a task holds before it hands them on.
BLOCK, HELD = 1 << 21, 1 << 20
#: Buckets of counts per doubling.
PER_OCTAVE = 4


def _counts(flush: int, flush_bytes: int):
    """Partial sums of a task: (lang, source, term, n), (lang, null, term, df) and one row per (lang, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources: dict = {}
        langs: dict = {}
        held = read = 0

        def out():
            columns: list[list] = [[], [], [], [], []]
            for (lang, source), counter in sources.items():
                for column, values in zip(columns, ([lang] * len(counter), [source] * len(counter), counter.keys(), counter.values(), [0] * len(counter))):
                    column.extend(values)
                for column, value in zip(columns, (lang, source, None, 0, 0)):
                    column.append(value)
            for lang, counter in langs.items():
                for column, values in zip(columns, ([lang] * len(counter), [None] * len(counter), counter.keys(), [0] * len(counter), counter.values())):
                    column.extend(values)
            arrays = [pa.array(c, pa.binary()).cast(pa.string()) for c in columns[:3]] + [pa.array(c, pa.int64()) for c in columns[3:]]
            return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "df"])

        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).cast(pa.binary()) for k in range(3))):
                lang, source, text = lang.as_py(), source.as_py(), text.as_py()
                words = terms_of(text, LETTERS)
                own, every = sources.setdefault((lang, source), Counter()), langs.setdefault(lang, Counter())
                before = len(own) + len(every)
                own.update(words)
                every.update(set(words))
                held, read = held + len(own) + len(every) - before, read + len(text)
                if held > flush or read > flush_bytes:
                    yield out()
                    sources.clear(), langs.clear()
                    held = read = 0
        yield out()

    return run


def term_postings(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, term, total, sources (source, n) of the terms in at least so many documents of a language.

    A row of null term per language lists all its sources.  Partial sums are
    dealt once, by language and term.
    """
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = own.mapInArrow(_counts(FLUSH, FLUSH_BYTES), "lang string, source string, term string, n long, df long").repartition("lang", "term")
    summed = partial.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    listed = F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "n"))).alias("sources")
    return summed.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df"), listed).where((F.col("df") >= least_docs) | F.col("term").isNull())


def _share(count: Column | str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)), exactly at any size."""
    count = F.col(count) if isinstance(count, str) else count
    above = (count + SMOOTHING).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (F.col(total) + SMOOTHING * F.col(terms)).cast("decimal(19,0)")
    return F.call_function("div", above, below) + 1


def _pair_sums(block: int, most: int):
    """From postings (lang, place, share, absent as arrays): what terms of both of two sources add to the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def compact() -> int:
            for lang, parts in held.items():
                keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, inverse, np.concatenate([v for _, v in parts]))
                held[lang] = [(keys, sums)]
            return sum(len(parts[0][0]) for parts in held.values())

        def out():
            for lang, ((keys, sums),) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys >> 31), pa.array(keys & 0x7FFFFFFF), pa.array(sums)], ["lang", "a", "b", "value"])
            held.clear()

        for batch in batches:
            lists = batch.column(1)
            starts, flat = lists.offsets.to_numpy(), lists.values
            place, share, absent = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3))
            lang, length = np.array(batch.column(0).to_pylist(), object), np.diff(starts)
            for name, n in {(a, b) for a, b in zip(lang, length) if b > 1}:
                rows = starts[:-1][(lang == name) & (length == n)]
                # All pairs of n places, in blocks of first places and then of terms.
                for low in range(0, n - 1, max(1, block // n)):
                    i, j = np.nonzero(np.arange(low, min(n - 1, low + max(1, block // n)))[:, None] < np.arange(n)[None])
                    i = i + low
                    step = max(1, block // len(i))
                    for k in range(0, len(rows), step):
                        x, y = rows[k : k + step, None] + i, rows[k : k + step, None] + j
                        p, q, s, t = share[x], share[y], absent[x], absent[y]
                        value = np.abs(p - q) - np.abs(p - t) - np.abs(q - s) + np.abs(s - t)
                        held.setdefault(name, []).append(((np.minimum(place[x], place[y]) << 31 | np.maximum(place[x], place[y])).ravel(), value.ravel()))
                        size += value.size
                        if size > most:
                            size = compact()
                            if size > most // 2:
                                yield from out()
                                size = 0
        compact()
        yield from out()

    return run


def divergence(docs: DataFrame, least_docs: int = 30, k: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank for every source of every language of ``docs`` (lang, source, text).

    Part ``pair``: every other source of the language and the sum of
    differences over all kept terms.  Part ``term``: the ``k`` terms whose share
    is most above the language's.  Terms are runs of letters a-z (A-Z lowered)
    and characters beyond ASCII; a language keeps those in at least
    ``least_docs`` of its documents.  A null text, lang or source counts as
    empty; equal rows count each; a source without terms is a source; a
    language of one source has no pairs; without kept terms pairs are 0; equal
    values go by the item's bytes; other columns are ignored; no rows give none.
    """
    postings = materialize(term_postings(docs, least_docs), "postings")
    kept = postings.where("term is not null")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    counted = kept.select("lang", "term", "total", F.inline("sources"))
    named = postings.where("term is null").select("lang", F.inline("sources")).select("lang", "source")
    place = F.row_number().over(W.partitionBy("lang").orderBy("source"))
    own = counted.groupBy("lang", "source").agg(F.sum("n").alias("own_total"))
    zero = F.lit(0).cast("long")
    groups = named.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["own_total", "terms", "lang_total"])
    groups = materialize(groups.withColumn("place", place).withColumn("absent", F.when(F.col("terms") > 0, _share(zero, "own_total", "terms")).otherwise(zero)), "groups")
    shared = counted.join(groups, ["lang", "source"]).withColumns({"p": _share("n", "own_total", "terms"), "q": _share("total", "lang_total", "terms")})
    bucket = F.floor(F.log2(F.col("n").cast("double")) * PER_OCTAVE)
    shared = materialize(shared.select("lang", "source", "place", "absent", "term", "p", "q", bucket.alias("cell")), "shares")
    terms = _top_terms(shared, k).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    pairs = _pairs(shared, groups)
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank")).unionByName(terms)


def _top_terms(shared: DataFrame, k: int) -> DataFrame:
    """lang, source, term, value, rank: buckets of counts by the bound ``greatest p - least q``, best first."""
    bounds = materialize(shared.groupBy("lang", "source", "cell").agg((F.max("p") - F.min("q")).alias("bound")), "bounds")

    def evaluate(opened: DataFrame) -> DataFrame:
        met = shared.join(opened, ["lang", "source", "cell"])
        return met.select("lang", "source", "term", (F.col("p") - F.col("q")).alias("value"))

    return best_first(bounds, ("lang", "source"), k, evaluate, [F.col("term")])


def _pairs(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of all ordered pairs of sources of a language."""
    postings = shared.groupBy("lang", "term").agg(F.collect_list(F.struct("place", "p", "absent")).alias("list")).select("lang", "list")
    both = postings.mapInArrow(_pair_sums(BLOCK, HELD), "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    # A source's shares and the other sources' shares of absent terms, in one order: running sums give every sum of differences.
    shares = shared.groupBy("lang", "place", F.col("p").alias("at")).agg(F.count("*").alias("n")).select("lang", "place", "at", F.lit(None).cast("int").alias("other"), "n", (F.col("n") * F.col("at")).alias("mass"), F.lit(None).cast("long").alias("absent"), F.lit(None).cast("long").alias("terms"))
    others = groups.select("lang", F.col("place").alias("other"), F.col("absent").alias("at"))
    zero = F.lit(0).cast("long")
    probes = groups.select("lang", "place", "absent", "terms").join(others, "lang").where("place != other").select("lang", "place", "at", "other", zero.alias("n"), zero.alias("mass"), "absent", "terms")
    upto = W.partitionBy("lang", "place").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("lang", "place")
    placed = shares.unionByName(probes).withColumns({"n0": F.sum("n").over(upto), "m0": F.sum("mass").over(upto), "n1": F.sum("n").over(whole), "m1": F.sum("mass").over(whole)})
    apart = F.abs(F.col("absent") - F.col("at"))
    alone = (F.col("m1") - F.col("m0")) - (F.col("n1") - F.col("n0")) * F.col("at") + F.col("n0") * F.col("at") - F.col("m0") - F.col("n1") * apart
    probed = placed.where("other is not null")
    pair = lambda a, b, value: F.struct(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), value.alias("value"))
    mirrored = probed.select("lang", F.inline(F.array(pair("place", "other", alone + F.col("terms") * apart), pair("other", "place", alone))))
    twice = both.select("lang", F.inline(F.array(pair("a", "b", F.col("value")), pair("b", "a", F.col("value")))))
    total = mirrored.unionByName(twice).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    name = lambda at, to: groups.select("lang", F.col("place").alias(at), F.col("source").alias(to))
    return total.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value")


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
k AS (SELECT lang, term, count(*) AS n FROM d GROUP BY ALL HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) AS n FROM d SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(l.total), 0) AS lang_total, coalesce(any_value(own), 0) AS own
      FROM (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents) LEFT JOIN l USING (lang)
      LEFT JOIN (SELECT lang, source, sum(n) AS own FROM c GROUP BY ALL) USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, k.term, k.n AS lang_n, coalesce(c.n, 0) AS n, lang_total, v,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (own + 5 * v) AS p FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
t AS (SELECT lang, source, 'term' AS part, term AS item, p - (1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v)) AS value FROM p WHERE n > 0),
s AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
      ON x.lang = a.lang AND x.source = a.source AND x.item = b.source)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM t WHERE value > 0 UNION ALL FROM s))
WHERE part = 'pair' OR rank <= 50
"""
