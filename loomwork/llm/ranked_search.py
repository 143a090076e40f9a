"""Ranked lexical search over a clustered index, with exact stopping.

1. Every text is read once: its length and the counts of the terms that any
   query may hold (a bitmap of fixed size tells; false positives only cost).
2. Recursive graph bisection, fitted on a bounded sample of distinct rows of
   terms, routes every document to a leaf.  Leaves in order, and within a leaf
   the documents by length, are cut into shards; a shard's row holds its
   documents' impacts and each term's greatest impact.
3. A query's bound of a shard is the weighted sum of those.  Shards are opened
   in order of bound until no unseen one reaches the k-th score; those that
   equal it are opened too, so ties go by doc_id as they must.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.best_first import best_first
from loomwork.llm.bisection import SAMPLE, SLOTS, Bisection, fit_bisection
from loomwork.llm.bitmap import bitmap
from loomwork.llm.terms import LETTERS_AND_DIGITS, TermHashes
from loomwork.plans.storage import materialize

BITS = 22
#: A shard has at most so many documents and postings; it ends with its leaf once it has a quarter of the former.
SHARD_DOCS, SHARD_POSTINGS = 1024, 1 << 16
#: Queries, and terms of queries, that are sent to all tasks at once.
QUERY_BLOCK, TERM_BLOCK = 1_000, 200_000

FORWARD = "row long, doc_id long, n long, terms array<long>, counts array<int>"
SHARDS = "shard long, doc_ids array<long>, sizes array<int>, place array<int>, impact array<int>, own array<long>, top array<int>"


def _counted(marks):
    """(id, text) to FORWARD rows: terms with repeats, and hashes and counts of those marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TermHashes(marks.value, BITS) if marks else TermHashes()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [hashes.counted(text.as_py() or b"", LETTERS_AND_DIGITS) for text in batch.column(1).cast(pa.binary())]
            rows = pa.array(np.arange(row, row + len(found)))
            row += len(found)
            lists = [pa.array([f[k] for f in found], t) for k, t in ((0, pa.int64()), (1, pa.list_(pa.int64())), (2, pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), *lists], ["row", "doc_id", "n", "terms", "counts"])

    return run


def _edges(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of rows of terms, each once."""
    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    slots = lists.flatten().to_numpy().astype(np.int64) % SLOTS
    keys = np.unique(doc * SLOTS + slots)
    return keys // SLOTS, keys % SLOTS


def fit_order(forward: DataFrame, n: int) -> Bisection:
    """The bisection of at most SAMPLE rows of distinct terms, of the least hashes."""
    mixed = F.xxhash64("terms")
    share = min(1.0, 4 * SAMPLE / max(1, n))
    some = forward.where(F.size("terms") > 0).where(F.pmod(mixed, F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = some.groupBy(mixed.alias("h")).agg(F.first("terms").alias("terms")).orderBy("h").limit(SAMPLE).select("terms").toArrow().combine_chunks()
    lists = sample["terms"].combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.int64()))
    return fit_bisection(*_edges(lists), len(lists))


def _routed(order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = order.value.leaves(*_edges(batch.column("terms")), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], [*batch.schema.names, "leaf"])

    return run


def _shards(most_docs: int, most_postings: int):
    """Rows (doc_id, m, terms, counts, leaf) in order to SHARDS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        docs: list[tuple] = []
        postings = 0

        def out():
            nonlocal shard, postings
            sizes = np.array([len(d[2]) for d in docs], np.int32)
            terms, counts = np.concatenate([d[2] for d in docs]), np.concatenate([d[3] for d in docs]).astype(np.int64)
            m = np.repeat(np.array([d[1] for d in docs], np.int64), sizes)
            impact = 1_000_000_000 * counts // (1000 * counts + 12 * m)
            own, place = np.unique(terms, return_inverse=True)
            top = np.zeros(len(own), np.int64)
            np.maximum.at(top, place, impact)
            columns = [[d[0] for d in docs], sizes, place.astype(np.int32), impact.astype(np.int32), own, top.astype(np.int32)]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            row = pa.RecordBatch.from_arrays([pa.array([shard])] + [pa.array([c], pa.list_(t)) for c, t in zip(columns, types)], ["shard", "doc_ids", "sizes", "place", "impact", "own", "top"])
            docs.clear()
            shard, postings = shard + 1, 0
            return row

        for batch in batches:
            ids, m, leaf = (batch.column(c).to_pylist() for c in ("doc_id", "m", "leaf"))
            terms, counts = batch.column("terms"), batch.column("counts")
            bounds, flat, many = terms.offsets.to_numpy(), terms.values.to_numpy(), counts.values.to_numpy()
            shift = counts.offsets.to_numpy()
            for k in range(batch.num_rows):
                a, b = bounds[k], bounds[k + 1]
                full = len(docs) >= most_docs or postings + b - a > most_postings
                if docs and (full or (docs[-1][4] != leaf[k] and len(docs) * 4 >= most_docs)):
                    yield out()
                docs.append((ids[k], m[k], flat[a:b].copy(), many[shift[k] : shift[k + 1]].copy(), leaf[k]))
                postings += b - a
        if docs:
            yield out()

    return run


class _Block:
    """Queries whose terms are sent to all tasks: sorted terms, and for each the queries that weigh it."""

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray]):
        query = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        flat, weight = np.concatenate(terms), np.concatenate(weights)
        order = np.argsort(flat, kind="stable")
        self.query, self.weight, self.n = query[order], weight[order], len(terms)
        self.terms, self.starts = np.unique(flat[order], return_index=True)
        self.stops = np.r_[self.starts[1:], len(flat)]
        self.own = list(zip(terms, weights))

    def met(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``own`` and in the block's terms of the terms of both."""
        at = np.searchsorted(self.terms, own)
        ok = at < len(self.terms)
        ok[ok] = self.terms[at[ok]] == own[ok]
        return np.flatnonzero(ok), at[ok]


def _bounds(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for batch in batches:
            shards, parts = batch.column(0).to_pylist(), []
            for k in range(batch.num_rows):
                own, top = (batch.column(c)[k].values.to_numpy() for c in (1, 2))
                here, there = b.met(own)
                sizes = b.stops[there] - b.starts[there]
                entry = np.repeat(b.starts[there] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
                bound = np.zeros(b.n, np.int64)
                np.add.at(bound, b.query[entry], b.weight[entry] * np.repeat(top[here].astype(np.int64), sizes))
                q = np.flatnonzero(bound)
                parts.append((q.astype(np.int32), np.full(len(q), shards[k]), bound[q]))
            q, cell, bound = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(cell), pa.array(bound)], ["q", "cell", "bound"])

    return run


def _least(doc_ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k``, equal scores by id."""
    if len(score) > k:
        low = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= low)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((doc_ids[some], -score[some]))[:k]]


def _scores(block, k: int):
    """(queries, SHARDS columns but top) to the task's best (q, doc_id, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        best: dict[int, tuple] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                queries, sizes, place, impact, own = (batch.column(c)[r].values.to_numpy() for c in ("queries", "sizes", "place", "impact", "own"))
                ids = np.array([LAST if i is None else i for i in batch.column("doc_ids")[r].as_py()], np.int64)
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                impact = impact.astype(np.int64)
                for q in queries:
                    terms, weights = b.own[q]
                    at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                    ok = own[at] == terms
                    weight = np.zeros(len(own), np.int64)
                    weight[at[ok]] = weights[ok]
                    score = np.add.reduceat(weight[place] * impact, starts)
                    some = np.flatnonzero(score)
                    have = best.get(q)
                    if have is not None and len(have[0]) == k:
                        some = some[score[some] >= have[1][-1]]
                    if len(some):
                        i, s = (ids[some], score[some]) if have is None else (np.r_[have[0], ids[some]], np.r_[have[1], score[some]])
                        kept = _least(i, s, k)
                        best[q] = i[kept], s[kept]
        for q, (i, s) in best.items():
            ids = pa.array([None if v == LAST else v for v in i.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), q, np.int32)), ids, pa.array(s)], ["q", "doc_id", "value"])

    return run


#: Stands for a null id in numpy; such documents come last among equals.
LAST = np.iinfo(np.int64).max


def build_shards(forward: DataFrame, n: int, length: int) -> DataFrame:
    """The clustered index of FORWARD rows, ``n`` of which have terms, ``length`` in all."""
    spark = forward.sparkSession
    order = spark.sparkContext.broadcast(fit_order(forward, n))
    some = forward.where(F.size("terms") > 0).select("row", "doc_id", F.expr(f"75 + (25 * n * {n}L) div {max(1, length)}L").alias("m"), "terms", "counts")
    routed = materialize(some.mapInArrow(_routed(order), "row long, doc_id long, m long, terms array<long>, counts array<int>, leaf int"), "routed")
    dealt = routed.repartitionByRange("leaf", "m", "row").sortWithinPartitions("leaf", "m", "row")
    return materialize(dealt.mapInArrow(_shards(SHARD_DOCS, SHARD_POSTINGS), SHARDS), "shards")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the best ``k`` of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    Weights and lengths are those of the whole table.  Equal scores go by
    ascending doc_id, a null doc_id last; equal rows of documents are ranked
    each, equal rows of items answered once; null and empty texts have no terms
    and no rows; other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    slim = lambda df, key: df.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    wanted = materialize(slim(items, "item_id").distinct().mapInArrow(_counted(None), FORWARD).where("n > 0"), "items")
    places = wanted.select(F.explode("terms").alias("t")).distinct().select(F.col("t").bitwiseAND((1 << BITS) - 1).alias("place"))
    marks = spark.sparkContext.broadcast(bitmap(places.distinct(), BITS))
    forward = materialize(slim(docs, "doc_id").mapInArrow(_counted(marks), FORWARD).where("n > 0"), "forward")
    n, length = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = build_shards(forward, n, length)
    frequency = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = materialize(frequency.select("term", weight.alias("w")), "weights")
    # One row per query: its terms that occur, each with its weight times its repeats.
    listed = wanted.select("row", "doc_id", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("r")))).join(weights, "term")
    queries = materialize(listed.groupBy("row", F.col("doc_id").alias("item_id")).agg(F.collect_list("term").alias("terms"), F.collect_list(F.col("w") * F.col("r")).alias("weights")), "queries")
    n_queries, n_terms = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    parts = max(-(-n_queries // QUERY_BLOCK), -(-n_terms // TERM_BLOCK), 1)
    parts = 1 if parts == 1 else 2 * parts
    legs = []
    for part in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part).collect()
        if rows:
            legs.append(_answers(shards, rows, k))
    schema = "item_id long, rank int, doc_id long, score long"
    return reduce(DataFrame.unionByName, legs) if legs else spark.createDataFrame([], schema)


def _answers(shards: DataFrame, rows: list, k: int) -> DataFrame:
    spark = shards.sparkSession
    block = spark.sparkContext.broadcast(_Block([np.array(r.terms, np.int64) for r in rows], [np.array(r.weights, np.int64) for r in rows]))
    bounds = materialize(shards.select("shard", "own", "top").mapInArrow(_bounds(block), "q int, cell long, bound long"), "bounds")

    def evaluate(opened: DataFrame) -> DataFrame:
        asked = opened.groupBy(F.col("cell").alias("shard")).agg(F.collect_list("q").alias("queries"))
        met = shards.drop("top").join(asked, "shard")
        return met.mapInArrow(_scores(block, k), "q int, doc_id long, value long")

    found = best_first(bounds, ["q"], k, evaluate, [F.col("doc_id").asc_nulls_last()])
    names = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(rows)], "q int, item_id long")
    return found.join(F.broadcast(names), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.col("value").alias("score"))
