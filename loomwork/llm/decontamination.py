"""Benchmark decontamination: SimHash of item-sized windows, Hamming search, exact verification.

Each document slides a window of each item's length over its words.  A window
can reach the wanted similarity only if enough of its shingles are shingles of
some item at all, so prefix sums over such hits drop the other windows before
anything is fingerprinted.  The rest get a SimHash; the items' fingerprints are
indexed by blocks of bits, of which any fingerprint within the radius is near
on at least one; candidates within the radius are verified by weighted Jaccard
similarity of their shingle sets.

Items are handed to tasks in blocks of bounded size, so a benchmark of any
number of items is searched by several passes and never broadcast whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shingles import WORDS, distinct, mix, shingle_hashes, word_hashes
from loomwork.plans.storage import materialize

#: 22 blocks of 16 bits.  Windows at weighted similarity 0.8 differ in about 53 bits, with a deviation of 7;
#: random ones in 176.  A radius of 65 makes two blocks in a pair differ by at most 2 bits.
BLOCK, BITS, RADIUS = 16, 352, 65
#: Items, and characters of items, that one pass may broadcast.
BLOCK_ITEMS = 4_000
BLOCK_CHARS = 16_000_000
#: Windows that are fingerprinted at once, and the stretch of words that they may lie in besides their own length.
WINDOWS, STRETCH = 4_096, 8_192


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 per shingle and bit."""
    words = np.stack([mix(shingles + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(-(-BITS // 64))], axis=1)
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(shingles), -1), axis=1, bitorder="little", count=BITS)
    return bits.astype(np.int8) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """SimHash of rows of weighted sums per bit, as rows of BITS / BLOCK numbers."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u2")


class HammingIndex:
    """Finds every stored fingerprint of equal label within ``radius`` of a query by blocks of bits.

    Two fingerprints that differ in at most ``radius`` bits differ in at most
    ``radius // blocks`` on one of the blocks.  Each stored block is entered
    under every value that near to it, so looking each block up once misses none.
    """

    def __init__(self, prints: np.ndarray, labels: np.ndarray, radius: int = RADIUS):
        self.prints, self.labels, self.radius = prints, labels, radius
        near = radius // (BITS // BLOCK)
        values = np.arange(1 << BLOCK, dtype=np.uint16)
        masks = values[np.bitwise_count(values) <= near]
        self.tables = []
        for k in range(BITS // BLOCK):
            keys = (prints[:, k, None] ^ masks).ravel()
            order = np.argsort(keys, kind="stable")
            starts = np.searchsorted(keys[order], np.arange((1 << BLOCK) + 1)).astype(np.int32)
            self.tables.append((starts, (order // len(masks)).astype(np.int32)))

    def candidates(self, queries: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, stored) of equal label that some block brings together."""
        found = []
        for k, (starts, stored) in enumerate(self.tables):
            a = starts[queries[:, k]]
            n = starts[queries[:, k].astype(np.int64) + 1] - a
            at = np.repeat(np.arange(len(queries)), n)
            item = stored[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]
            own = labels[at] == self.labels[item]
            found.append(at[own].astype(np.int64) * len(self.prints) + item[own])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))

    def search(self, queries: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, stored) of equal label within the radius."""
        at, item = self.candidates(queries, labels)
        near = np.bitwise_count(queries[at] ^ self.prints[item]).sum(axis=1) <= self.radius
        return at[near], item[near]


#: Rows and slots (a power of two) of the sketch that counts items by shingle.
ROWS, SLOT_BITS = 2, 20


def _slots(shingles: np.ndarray, row: int) -> np.ndarray:
    return ((shingles >> np.uint64(64 - (row + 1) * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def _item_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, slot, n) of the distinct shingles of a batch of items."""
    for batch in batches:
        sets = [distinct(shingle_hashes(word_hashes(text.as_py() or ""))) for text in batch.column(0)]
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        for row in range(ROWS):
            slot, n = np.unique(_slots(flat, row), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), row, np.int32)), pa.array(slot.astype(np.int32)), pa.array(n)], ["row", "slot", "n"])


def shingle_weights(items: DataFrame) -> np.ndarray:
    """Per row and slot of the sketch 1 / (1 + log n), n being how many shingles of items lie there; 1 where none does.

    A shingle weighs the greatest of its slots' weights: one that several items
    share says less about each of them.  The sketch counts the whole benchmark
    and has a fixed size, so weights do not depend on the blocks of a search.
    """
    table = items.select("text").mapInArrow(_item_slots, "row int, slot int, n long").groupBy("row", "slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    weights = np.ones((ROWS, 1 << SLOT_BITS), np.float32)
    weights[table["row"].to_numpy(), table["slot"].to_numpy()] = 1 / (1 + np.log(table["n"].to_numpy()))
    return weights


class Benchmark:
    """The items of one block, ready to be searched; ``weights`` are those of ``shingle_weights``."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, radius: int, weights: np.ndarray):
        self.ids, self.sets, self.lengths = [], [], []
        for item_id, text in items:
            own = word_hashes(text or "")
            if len(own):
                self.ids.append(item_id), self.lengths.append(len(own)), self.sets.append(distinct(shingle_hashes(own)))
        self.threshold = threshold
        self.known = distinct(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.weights = weights
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.known >> np.uint64(44)] = True
        prints = [fingerprint((signs(own) * self.weigh(own)[:, None]).sum(axis=0, keepdims=True)) for own in self.sets]
        self.index = HammingIndex(np.concatenate(prints) if prints else np.zeros((0, BITS // BLOCK), np.uint16), np.array(self.lengths, np.int64), radius)

    def weigh(self, shingles: np.ndarray) -> np.ndarray:
        return np.max([self.weights[row][_slots(shingles, row)] for row in range(ROWS)], axis=0).astype(float)

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        maybe = self.filter[shingles >> np.uint64(44)]
        if maybe.any():
            asked = shingles[maybe]
            maybe[maybe] = self.known[np.minimum(np.searchsorted(self.known, asked), len(self.known) - 1)] == asked
        return maybe

    def search(self, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """item -> (similarity, first word, words) of its best window."""
        best: dict[int, tuple[float, int, int]] = {}
        if not len(self.ids):
            return best
        self._search(words, shingle_hashes(words), sorted({n for n in self.lengths if n >= WORDS}), best)
        for n in sorted({n for n in self.lengths if n < WORDS <= len(words)}):  # their shingles have their own size
            self._search(words, shingle_hashes(words, n), [n], best)
        if len(words) < WORDS:
            self._search(words, shingle_hashes(words), [n for n in {*self.lengths} if n == len(words)], best)
        return best

    def _search(self, words: np.ndarray, shingles: np.ndarray, lengths: list[int], best: dict) -> None:
        if not len(shingles) or not lengths:
            return
        hit = self.hits(shingles)
        if not hit.any():
            return
        before = np.concatenate([[0], np.cumsum(hit)])
        weights = self.weigh(shingles)
        shared, mass = (np.concatenate([[0.0], np.cumsum(x)]) for x in (np.where(hit, weights, 0.0), weights))
        repeats = len(distinct(shingles)) < len(shingles)
        first, spans, sizes = [], [], []
        for n in lengths:
            span = min(max(1, n - WORDS + 1), len(shingles))
            starts = np.nonzero(before[span:] > before[:-span])[0]
            # What a window shares with an item is at most the weight of its hits; their union weighs at least its
            # distinct shingles, of which a text with repeats may have a single one.
            least = weights.min() if repeats else mass[starts + span] - mass[starts]
            starts = starts[shared[starts + span] - shared[starts] + 1e-9 >= self.threshold * least]
            first.append(starts), spans.append(np.full(len(starts), span)), sizes.append(np.full(len(starts), n))
        first, spans, sizes = np.concatenate(first), np.concatenate(spans), np.concatenate(sizes)
        order = np.argsort(first, kind="stable")
        first, spans, sizes = first[order], spans[order], sizes[order]
        k = 0
        while k < len(first):
            end = min(k + WINDOWS, int(np.searchsorted(first, first[k] + STRETCH, "right")))
            self._verify(shingles, weights, first[k:end], spans[k:end], sizes[k:end], best)
            k = end

    def _verify(self, shingles, weights, first, spans, sizes, best) -> None:
        low, high = int(first.min()), int((first + spans).max())
        sums = np.concatenate([np.zeros((1, BITS)), np.cumsum(signs(shingles[low:high]) * weights[low:high, None], axis=0)])
        prints = fingerprint(sums[first - low + spans] - sums[first - low])
        query, stored = self.index.search(prints, sizes)
        for q, k in zip(query.tolist(), stored.tolist()):
            window = distinct(shingles[first[q] : first[q] + spans[q]])
            both = np.intersect1d(window, self.sets[k], assume_unique=True)
            weight = self.weigh(both).sum()
            similarity = weight / (self.weigh(window).sum() + self.weigh(self.sets[k]).sum() - weight)
            start = int(first[q])
            # More similar, or as similar and earlier.
            if similarity + 1e-9 >= self.threshold and (similarity, -start) > (best.get(k, (0.0, 0))[0] + 1e-9, -best.get(k, (0.0, 1 << 60))[1]):
                best[k] = (float(similarity), start, int(spans[q]) + WORDS - 1 if sizes[q] >= WORDS else int(sizes[q]))


def _search(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = known.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = benchmark.search(word_hashes(text.as_py() or ""))
                rows += [(doc_id, benchmark.ids[k], *v) for k, v in sorted(found.items())]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return run


def item_blocks(benchmark: DataFrame) -> list[list]:
    """Ranges [from, to) of item hashes so that each block stays within BLOCK_ITEMS and BLOCK_CHARS on average."""
    size = benchmark.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    n = max(1, -(-(size["n"] or 0) // BLOCK_ITEMS), -(-(size["chars"] or 0) // BLOCK_CHARS))
    n = 1 if n == 1 else 2 * n  # hashing deals unevenly
    return [(k, n) for k in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) and benchmark item found in it.

    doc_id, item_id, similarity, first_word, n_words of the most similar window
    of the item's length (of the whole text, where that is shorter), the first
    of equal ones.  Null or empty texts and items match nothing; equal rows
    are reported one by one; a null doc_id or item_id is kept; other columns
    are ignored; empty tables give no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, weights = [], shingle_weights(items)
    for k, n in item_blocks(items):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        known = docs.sparkSession.sparkContext.broadcast(Benchmark([(r["item_id"], r["text"]) for r in block], threshold, radius, weights))
        part = slim.mapInArrow(_search(known), "doc_id long, item_id long, similarity double, first_word long, n_words long")
        if n > 1:  # one block after the other, so that the driver never holds two
            part = materialize(part, "contamination")
            known.destroy()
        found.append(part)
    return reduce(DataFrame.unionByName, found)
