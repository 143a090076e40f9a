"""Filters, keyword searches and scored retrieval."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions.text import jaccard, target_tokens
from loomwork.plans.storage import materialize


def any_like(columns: Sequence[str], keywords: Sequence[str]) -> Column:
    """Whether any column contains any keyword, case ignored; ``%`` and ``_`` of keywords are wildcards."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{k}%"), F.lit(False)) for c in columns for k in keywords])


def optional(**wanted) -> Column:
    """Equality filters of which those asked for with None hold for all rows."""
    return reduce(lambda a, b: a & b, [F.col(c) == v for c, v in wanted.items() if v is not None], F.lit(True))


def in_scope(project: str | None, own: str = "project", affects: str = "affects_project", exact: bool = False) -> Column:
    """Rows of a project, or that list it among those affected (as a substring unless ``exact``)."""
    if project is None:
        return F.lit(True)
    listed = F.array_contains(F.from_json(affects, "array<string>"), project) if exact else F.col(affects).contains(project)
    return (F.col(own) == project) | F.coalesce(listed, F.lit(False))


def cross_table(tables: dict[str, tuple[DataFrame, str, Sequence[str]]], keywords: Sequence[str], limit: int = 30) -> DataFrame:
    """Rows of several tables that match: table_name, id, hit; the first ``limit`` by id of each table."""
    legs = []
    for name, (df, key, columns) in tables.items():
        hit = F.substring(F.coalesce(*[F.when(any_like([c], keywords), F.col(c)) for c in columns]), 1, 60)
        legs.append(df.where(any_like(columns, keywords)).select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("id"), hit.alias("hit")).orderBy("id", "hit").limit(limit))
    return reduce(DataFrame.unionByName, legs)


def bm25(docs: DataFrame, key: str, text: str, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score of the documents that hold every term (words of a-z and 0-9): Okapi BM25, idf floored at 1e-6.

    One pass counts the terms of each document; corpus totals come from the
    same small table, so no postings of other words are ever shuffled.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    own = docs.select(key, low.alias("_low"))
    whole = lambda term: rf"(?<![a-z0-9]){term}(?![a-z0-9])"
    count = lambda term: F.when(F.col("_low").contains(term), F.regexp_count("_low", F.lit(whole(term)))).otherwise(0)
    counted = own.select(key, F.regexp_count("_low", F.lit("[a-z0-9]+")).alias("_len"), *[count(t).alias(f"_tf{k}") for k, t in enumerate(terms)])
    counted = materialize(counted, "counts")
    totals = counted.agg(F.count("*").alias("n"), F.avg("_len").alias("avg"), *[F.count_if(F.col(f"_tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))]).first()
    score = F.lit(0.0)
    for k in range(len(terms)):
        n, df = totals["n"], totals[f"df{k}"]
        idf = F.greatest(F.log(F.lit((n - df + 0.5) / (df + 0.5))), F.lit(1e-6))
        tf = F.col(f"_tf{k}")
        score = score + idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("_len") / F.lit(totals["avg"] or 1.0)))
    every = reduce(lambda x, y: x & y, [F.col(f"_tf{k}") > 0 for k in range(len(terms))])
    return counted.where(every).select(key, score.alias("score"))


def top_k(scored: DataFrame, key: str, k: int, score: str = "score") -> DataFrame:
    """The ``k`` rows of highest score, with their rank; ties go to the smaller key."""
    return scored.orderBy(F.desc(score), key).limit(k).withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(score), key)))


#: A block of queries that may be sent to all tasks.
QUERY_BLOCK = 1_000
#: Similarities that a task holds at once.
PRODUCTS = 1 << 19


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of length 1 (zeros stay zeros) from a column of lists of equal length."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norm == 0, 1, norm)


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str, least: float = -1.0, k: int | None = None, unless: str | None = None) -> DataFrame:
    """query, key, similarity of vectors by cosine, other than the query itself; with ``k`` the best of each query, and rank.

    The stated queries meet all vectors in blocks of QUERY_BLOCK, one matrix
    product of at most PRODUCTS numbers at a time; with ``k`` a task passes on
    its best of each query only, by similarities of nine decimals.  Pairs that agree in the column ``unless`` are left out.
    Vectors that are null are skipped.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[key]
    extra = [unless] if unless else []
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    n = 1 if n == 1 else 2 * n
    schema = f"query {kind}, {key} {kind}, similarity double"

    def search(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, own, marks = block.value
            best: list[tuple] = []  # (query, key, similarity) arrays
            floor = np.full(len(ids), least)  # with k: what a vector must reach to be among a query's best
            step = max(1, PRODUCTS // max(1, len(ids)))

            def cut(found):
                q, at, s = (np.concatenate(c) for c in zip(*found))
                order = np.lexsort((at, -np.round(s, 9), q))
                q, at, s = q[order], at[order], s[order]
                first = np.r_[True, q[1:] != q[:-1]]
                turn = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
                last = turn == k - 1
                floor[q[last]] = np.round(s[last], 9) - 1e-9
                return [(q[turn < k], at[turn < k], s[turn < k])]

            def out(q, at, s):
                return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(at), pa.array(s)], schema=wanted)

            wanted = None
            for whole in batches:
                wanted = wanted or pa.schema([("query", whole.column(0).type), (key, whole.column(0).type), ("similarity", pa.float64())])
                for start in range(0, whole.num_rows, step):
                    batch = whole.slice(start, step)
                    keys = batch.column(0).to_numpy(zero_copy_only=False)
                    near = own @ _matrix(batch.column(1)).T
                    ok = (near >= floor[:, None]) & (ids[:, None] != keys[None])
                    if marks is not None:
                        ok &= marks[:, None] != batch.column(2).to_numpy(zero_copy_only=False)[None]
                    q, at = np.nonzero(ok)
                    if k is None:
                        yield out(q, keys[at], near[q, at])
                    elif len(q):
                        best = cut([*best, (q, keys[at], near[q, at])])
            if best:
                yield out(*best[0])

        return run

    legs = []
    slim = vectors.where(F.col(vector).isNotNull()).select(key, vector, *extra)
    for part in range(n):
        rows = queries.where(F.col(vector).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(n)) == part)).select(key, vector, *extra).toArrow().combine_chunks()
        if rows.num_rows:
            columns = [rows[c].combine_chunks() for c in rows.column_names]
            block = spark.sparkContext.broadcast((columns[0].to_numpy(zero_copy_only=False), _matrix(columns[1]), columns[2].to_numpy(zero_copy_only=False) if unless else None))
            legs.append(slim.mapInArrow(search(block), schema))
    found = reduce(DataFrame.unionByName, legs) if legs else spark.createDataFrame([], schema)
    if k:
        order = W.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), key)
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found


def fuse(legs: Sequence[DataFrame], key: str, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked legs (key, rank): key, score of the best ``k``; ties go to the smaller key."""
    points = reduce(DataFrame.unionByName, [leg.select(key, (F.lit(1.0) / (constant + F.col("rank"))).alias("p")) for leg in legs])
    return points.groupBy(key).agg(F.sum("p").alias("score")).orderBy(F.desc("score"), key).limit(k)


def unmarked(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """The pairs (a, b) that ``marked`` (a, b) does not have, either way round."""
    known = marked.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    return pairs.join(known, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left_anti")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, suppressed: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """left_id, right_id, score of texts (id, text) whose token sets have at least this Jaccard similarity.

    Texts meet on the least frequent of their tokens only: of a set of n the
    first ``n - ceil(threshold n) + 1``, so frequent words make pairs of none
    but texts of little else; sizes too far apart never meet.  Pairs in
    ``suppressed`` (a, b, either way round) are left out; with ``ordered`` only
    those with left_id < right_id are made.
    """

    def sets(df: DataFrame) -> DataFrame:
        return materialize(df.select("id", target_tokens(F.col("text")).alias("t")).where(F.size("t") > 0), "tokens")

    a, b = sets(left), sets(right)
    words = a.select(F.explode("t").alias("token")).union(b.select(F.explode("t")))
    frequency = materialize(words.groupBy("token").agg(F.count("*").alias("f")), "frequency")

    def prefix(df: DataFrame, side: str) -> DataFrame:
        own = df.select("id", F.size("t").alias("n"), F.explode("t").alias("token")).join(frequency, "token")
        ranked = own.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("s"))
        first = F.slice("s", F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1)
        return ranked.select(F.col("id").alias(f"{side}_id"), F.col("n").alias(f"{side}_n"), F.explode(F.transform(first, lambda x: x["token"])).alias("token"))

    near = (F.col("left_n") >= threshold * F.col("right_n") - 1e-9) & (F.col("right_n") >= threshold * F.col("left_n") - 1e-9)
    met = prefix(a, "left").join(prefix(b, "right"), "token").where(near & (F.col("left_id") < F.col("right_id") if ordered else F.lit(True))).select("left_id", "right_id").distinct()
    full = met.join(a.select(F.col("id").alias("left_id"), F.col("t").alias("x")), "left_id").join(b.select(F.col("id").alias("right_id"), F.col("t").alias("y")), "right_id")
    both = F.size(F.array_intersect("x", "y"))
    score = both / (F.size("x") + F.size("y") - both)
    found = full.where(score >= threshold).select("left_id", "right_id", score.alias("score"))
    if suppressed is not None:
        renamed = found.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), "score")
        found = unmarked(renamed, suppressed).select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), "score")
    return found


def similar_to_items(items: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """left_id, right_id, score of a stated set of items (id, text) against all texts, at this Jaccard similarity (above 0) or more.

    Items go to all tasks in blocks, as for each token the items that have
    it; a task adds these up per text, so only pairs that reach the threshold
    are rows.  Ids are longs.
    """
    spark = texts.sparkSession
    sets = lambda df: df.select(F.col("id").cast("long").alias("id"), target_tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    asked = materialize(sets(items), "tokens")
    n = max(1, -(-asked.count() // QUERY_BLOCK))
    n = 1 if n == 1 else 2 * n
    schema, own, legs = "left_id long, right_id long, score double", sets(texts), []
    for part in range(n):
        rows = asked.where(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == part).collect()
        if rows:
            holders: dict[str, list[int]] = {}
            for k, r in enumerate(rows):
                for token in r.t:
                    holders.setdefault(token, []).append(k)
            block = spark.sparkContext.broadcast((np.array([r.id for r in rows]), np.array([len(r.t) for r in rows]), {t: np.array(k, np.int32) for t, k in holders.items()}))
            legs.append(own.mapInArrow(_overlaps(block, threshold), schema))
    return reduce(DataFrame.unionByName, legs) if legs else spark.createDataFrame([], schema)


def _overlaps(block, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, holders = block.value
        for batch in batches:
            found: list[tuple] = [(ids[:0], np.zeros(0, np.int64), np.zeros(0))]
            for key, tokens in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist()):
                held = [holders[t] for t in tokens if t in holders]
                if held:
                    both = np.bincount(np.concatenate(held), minlength=len(ids))
                    score = both / (sizes + len(tokens) - both)
                    at = np.flatnonzero(score >= threshold)
                    found.append((ids[at], np.full(len(at), key), score[at]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["left_id", "right_id", "score"])

    return run


def phrase_bm25(docs: DataFrame, key: str, text: str, phrases: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score of the documents that contain every phrase, in any script: BM25 over three-letter grams.

    A phrase of three letters or more is in a text's grams, in order, where the
    lower-cased text contains it; a document's length is its number of grams.
    """
    own = docs.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    count = lambda p: (F.length("_low") - F.length(F.replace("_low", F.lit(p), F.lit("")))) / len(p)
    counted = own.select(key, F.greatest(F.length("_low") - 2, F.lit(0)).alias("_len"), *[count(p.lower()).alias(f"_tf{i}") for i, p in enumerate(phrases)])
    counted = materialize(counted, "counts")
    totals = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(phrases))])
    joined, score, every = counted.crossJoin(F.broadcast(totals)), F.lit(0.0), F.lit(True)  # one row
    for i in range(len(phrases)):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.greatest(F.log((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
        every = every & (tf > 0)
    return joined.where(every).select(key, score.alias("score"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf of the words of a-z and 0-9: the rows of a text index."""
    words = docs.select(key, F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))
    return words.groupBy("term", key).agg(F.count("*").alias("tf"))


__all__ = ["any_like", "bm25", "cross_table", "fuse", "in_scope", "jaccard", "nearest", "optional", "phrase_bm25", "postings", "similar_pairs", "similar_to_items", "top_k", "unmarked"]
