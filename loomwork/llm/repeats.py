"""Suffix-array dedup: bytes inside any string of a given length that starts twice are removed.

A suffix at every byte would be many times the text.  Suffixes are taken at
anchors only: the anchor of a window of ``length`` bytes is its 32-byte string
of least hash (the leftmost of equal ones), so equal windows have equal anchors
at equal places, and an anchor stands for the consecutive windows that chose
it.

1. Each anchor's row has the hash of its 32 leading bytes and a hash of all
   bytes of its windows.  Leading bytes that occur once cannot repeat; anchors
   all of whose bytes agree are one kind, and all windows of a kind that occurs
   twice repeat.
2. Each kind of leading bytes with several kinds is read once from the texts.
   Its windows are taken in blocks of STEP.  Two windows can be equal only if
   the bytes that all windows of their blocks have in common are; blocks that
   agree in all bytes repeat as a whole.  Both are counted by hashes, and what
   is left, a few windows at the ends of repeated passages, goes on.
3. Suffixes at these windows are range-partitioned by sampled splitters on
   their leading bytes.  A bucket is sorted by multikey quicksort, eight bytes
   at a time, and neighbours are compared byte by byte; the first and the last
   suffix of every bucket are compared across the boundaries.  Equal suffixes
   are ordered by their place, so a splitter may fall between them and no bucket
   needs all suffixes of one beginning.
4. The repeated windows of each text are merged and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.bitmap import bitmap, has_bit
from loomwork.llm.shingles import BASE, mix, powers
from loomwork.plans.storage import materialize

GRAM = 32
#: Windows of a text that are handled at once; a cut anchor is settled by comparison.
SEGMENT = 1 << 20
_PLACE_BITS = 24
#: Windows of a block; suffixes of a bucket, on average.
STEP, BUCKET = 16, 100_000


class Rolling:
    """Hashes of any substrings of a byte string, from one prefix sum."""

    def __init__(self, data: bytes):
        codes = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        up, self.down = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[:-1], out=self.sums[1:])

    def hashes(self, start, stop) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size))


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in every window of ``width`` values."""
    place = np.arange(len(key), dtype=np.uint64)
    low = np.uint64((1 << 21) - 1)
    both = (key & ~low) | place
    n = len(key) - width + 1
    rows = -(-len(key) // width)
    padded = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(key)] = both
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)


def anchors(data: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(gram hash, hash of all its windows' bytes, place, least and greatest distance back to its windows' starts)."""
    for base in range(0, len(data) - length + 1, SEGMENT):
        part = data[base : base + SEGMENT + length - 1]
        rolling = Rolling(part)
        grams = rolling.windows(GRAM)
        owner = _least(grams, length - GRAM + 1)
        new = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        last = np.r_[new[1:], len(owner)] - 1
        place = owner[new]
        whole = rolling.hashes(new, last + length)
        # The same bytes with the anchor elsewhere cannot be: the anchor follows from the bytes.
        yield grams[place].astype(np.int64), whole.astype(np.int64), place + base, place - last, place - new


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(7)).alias("k2")]


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, keys, size = [], [], 0
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for gram, whole, place, near, far in anchors(text.as_py().encode(), length):
                    found.append((gram, whole, place << 16 | far << 8 | near))
                    keys.append((k1, k2, len(gram)))
                    size += len(gram)
                if size > 300_000:
                    yield _rows(found, keys)
                    found, keys, size = [], [], 0
            yield _rows(found, keys)

    return run


def _rows(found, keys) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
    each = [n for _, _, n in keys]
    own = [np.repeat(np.array([k[i] for k in keys], np.int64), each) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*own, *columns)], ["k1", "k2", "gram", "whole", "at"])


def _block_ranges(at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, block, least and greatest distance back) of every block of windows of the anchors ``at``."""
    far, near = at >> 8 & 255, at & 255
    each = far // STEP - near // STEP + 1
    row = np.repeat(np.arange(len(at)), each)
    block = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(near // STEP, each)
    return row, block, np.maximum(block * STEP, near[row]), np.minimum(block * STEP + STEP - 1, far[row])


def _suffixes(length: int, known):
    """First the texts that may be asked for; then, of those asked for, each kind's bytes and the hashes of its blocks."""

    def texts(batches):
        bits = known.value
        for batch in batches:
            keep = pa.array([has_bit(bits, k % (1 << _PLACE_BITS)) for k in batch.column(0).to_pylist()], pa.bool_())
            yield batch.filter(keep)

    def made(keys, copies, ats, pieces) -> pa.RecordBatch:
        at = np.array(ats, np.int64)
        size = np.array([len(x) for x in pieces], np.int64)
        begin = np.cumsum(size) - size
        row, block, lo, hi = _block_ranges(at)
        place = (begin + (at >> 8 & 255))[row]  # of the anchor, in the joined pieces
        rolling = Rolling(b"".join(pieces))
        mark = np.uint64(BASE)
        core = rolling.hashes(place - block * STEP, place - block * STEP - STEP + 1 + length)
        core = mix(core + block.astype(np.uint64) * mark)
        union = mix(rolling.hashes(place - hi, place - lo + length) + (hi << 8 | lo).astype(np.uint64) * mark)
        offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=len(at)))], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (core, union)]
        k1, k2 = ([k[i] for k in keys] for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(at), pa.array(copies, pa.int64()), pa.array(pieces, pa.binary()), *lists], ["k1", "k2", "at", "copies", "bytes", "cores", "unions"])

    def cut(batches):
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for k1, k2, text, asked in zip(*(batch.column(c) for c in ("k1", "k2", "text", "asked"))):
                data, key = text.as_py().encode(), (k1.as_py(), k2.as_py())
                for a in asked.as_py():
                    place, far, near = a["at"] >> 16, a["at"] >> 8 & 255, a["at"] & 255
                    for column, value in zip(rows, (key, a["copies"], a["at"], data[place - far : place - near + length])):
                        column.append(value)
                    if len(rows[0]) >= 2_000:
                        yield made(*rows)
                        rows = ([], [], [], [])
            if rows[0]:
                yield made(*rows)

    return texts, cut


def _windows(length: int):
    """bytes, k1, k2, start: a suffix for each window of the blocks asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1_000):
                part = batch.slice(first, 1_000)
                strings, keys, starts = [], [], []
                for k1, k2, at, data, blocks in zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "at", "bytes", "blocks"))):
                    place, far, near = at >> 16, at >> 8 & 255, at & 255
                    for block in blocks:
                        j = near // STEP + block
                        for back in range(max(j * STEP, near), min(j * STEP + STEP - 1, far) + 1):
                            strings.append(data[far - back : far - back + length])
                            keys.append((k1, k2)), starts.append(place - back)
                columns = [pa.array(strings, pa.binary()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), pa.array(starts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["bytes", "k1", "k2", "start"])

    return run


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a matrix, first column first, and whether each row in it equals the one before.

    Multikey quicksort, level by level: rows that agree so far are sorted by
    the next column, and rows that have become single are left where they are.
    """
    n = len(words)
    order, equal = np.argsort(words[:, 0], kind="stable"), np.zeros(n, bool)
    equal[1:] = words[order[1:], 0] == words[order[:-1], 0]
    for k in range(1, words.shape[1]):
        tied = np.flatnonzero(equal | np.r_[equal[1:], False])
        if not len(tied):
            break
        group = np.cumsum(~equal[tied])
        own = order[tied]
        turn = np.lexsort((words[own, k], group))
        order[tied] = own[turn]
        value = words[order[tied], k]
        equal[tied[1:]] &= (value[1:] == value[:-1]) & (group[1:] == group[:-1])
    return order, equal


def _neighbours(length: int):
    """A bucket's repeated suffixes (k1, k2, start), and its first and last suffix with their bytes."""
    names = ["k1", "k2", "start", "edge"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        column = table["bytes"].chunk(0)
        n = len(column)
        flat = np.frombuffer(column.buffers()[2], np.uint8, n * length, int(np.frombuffer(column.buffers()[1], np.int32, 1, 4 * column.offset)[0]))
        wide = np.zeros((n, -(-length // 8) * 8), np.uint8)
        wide[:, :length] = flat.reshape(n, length)
        order, equal = multikey_order(wide.view(">u8").astype(np.uint64))
        hit = order[equal | np.r_[equal[1:], False]]
        edges = order[[0, -1]] if n > 1 else order
        own = table.select(["k1", "k2", "start"])
        for at, edge in ((hit, pa.nulls(len(hit), pa.binary())), (edges, column.take(pa.array(edges)))):
            part = own.take(pa.array(at)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(pa.array(part[c].to_numpy(), pa.int64()) for c in names[:3]), edge], names)

    return run


def repeated_suffixes(suffixes: DataFrame, length: int) -> DataFrame:
    """k1, k2, start of the suffixes (bytes, k1, k2, start) whose ``length`` bytes another one has too."""
    buckets = suffixes.count() // BUCKET + 1
    ranged = suffixes.repartitionByRange(buckets, "bytes", "k1", "k2", "start")
    found = materialize(ranged.mapInArrow(_neighbours(length), "k1 long, k2 long, start long, edge binary"), "neighbours")
    edges = found.where("edge is not null").groupBy("edge").agg(F.collect_set(F.struct("k1", "k2", "start")).alias("own")).where(F.size("own") > 1)
    return found.where("edge is null").select("k1", "k2", "start").union(edges.select(F.inline("own")))


def repeated_stretches(texts: DataFrame, length: int) -> DataFrame:
    """k1, k2, start, stop: bytes of a text (by its keys) covered by strings that start elsewhere too."""
    spark = texts.sparkSession
    rows = materialize(texts.mapInArrow(_anchor_rows(length), "k1 long, k2 long, gram long, whole long, at long"), "anchors")
    groups = rows.groupBy("gram").agg(F.count("*").alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most")).where("n > 1")
    groups = materialize(groups, "grams")  # a join of two plain shuffles can split a hot gram
    shared = materialize(rows.join(groups.select("gram", (F.col("least") != F.col("most")).alias("differ")), "gram"), "shared")
    differ = shared.where("differ")
    kinds = differ.groupBy("gram", "whole").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "at")).alias("one"))
    kinds = materialize(kinds, "kinds")
    alike = differ.join(kinds.where("copies > 1").select("gram", "whole"), ["gram", "whole"], "left_semi")
    place, far, near = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(255), F.col("at").bitwiseAND(255)
    full = shared.where("not differ").select("k1", "k2", "at").union(alike.select("k1", "k2", "at")).select("k1", "k2", (place - far).alias("start"), (place - near + length).alias("stop"))
    asked = kinds.groupBy("one.k1", "one.k2").agg(F.collect_list(F.struct("copies", F.col("one.at").alias("at"))).alias("asked"))
    asked = materialize(asked, "asked")
    known = spark.sparkContext.broadcast(bitmap(asked.select(F.pmod("k1", F.lit(1 << _PLACE_BITS)).alias("place")), _PLACE_BITS))
    maybe, cut = _suffixes(length, known)
    own = texts.mapInArrow(maybe, "k1 long, k2 long, text string").dropDuplicates(["k1", "k2"]).join(asked, ["k1", "k2"])
    own = materialize(own.mapInArrow(cut, "k1 long, k2 long, at long, copies long, bytes binary, cores array<long>, unions array<long>"), "pieces")
    each = own.select("k1", "k2", "at", "copies", F.posexplode(F.arrays_zip("cores", "unions")).alias("block", "b")).select("k1", "k2", "at", "copies", "block", F.col("b.cores").alias("core"), F.col("b.unions").alias("union"))
    cores = each.groupBy("core").agg(F.count("*").alias("n"), F.min("union").alias("least"), F.max("union").alias("most")).where("n > 1")
    cores = materialize(cores.select("core", (F.col("least") != F.col("most")).alias("open")), "cores")
    blocks = materialize(each.join(cores, "core"), "blocks")
    twice = materialize(blocks.groupBy("union").count().where("count > 1").select("union"), "unions")
    j = F.floor(near / STEP) + F.col("block")
    lo, hi = F.greatest(j * STEP, near), F.least(j * STEP + STEP - 1, far)
    whole = blocks.where("copies = 1").join(twice, "union", "left_semi").select("k1", "k2", (place - hi).alias("start"), (place - lo + length).alias("stop"))
    # Blocks that agree in all bytes are compared by one of them.
    units = blocks.where("open").groupBy("core", "union").agg(F.min(F.struct("k1", "k2", "at", "block")).alias("one"))
    units = materialize(units.groupBy("one.k1", "one.k2", "one.at").agg(F.collect_list("one.block").alias("blocks")), "units")
    parts = materialize(own.select("k1", "k2", "at", "bytes").join(units, ["k1", "k2", "at"]), "parts")
    suffixes = parts.mapInArrow(_windows(length), "bytes binary, k1 long, k2 long, start long")
    single = repeated_suffixes(suffixes, length).select("k1", "k2", "start", (F.col("start") + length).alias("stop"))
    return full.union(whole).union(single)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 3, pa.string()]
    for batch in batches:
        rows, size = [], 0
        for doc_id, text, starts, stops in zip(batch.column("doc_id").to_pylist(), *(batch.column(c) for c in ("text", "starts", "stops"))):
            data = text.as_py().encode()
            kept, at, spans = [], 0, 0
            if starts.is_valid:
                order = sorted(zip(starts.as_py(), stops.as_py()))
                begin, end = order[0]
                for a, b in [*order[1:], (len(data) + 1, len(data) + 1)]:
                    if a > end:
                        kept.append(data[at:begin])
                        at, spans = end, spans + 1
                        begin = a
                    end = max(end, b)
            kept.append(data[at:])
            rest = b"".join(kept)
            rows.append((doc_id, rest, len(data), len(data) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
            size += len(data)
            if size > 16_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                rows, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, kinds)], names)


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) without the bytes inside strings of ``length`` bytes that start twice.

    Columns: doc_id, text (binary: a cut may fall inside a character), n_bytes,
    n_removed, n_spans, kept_sha256.  Texts below ``length`` bytes keep all;
    equal texts of at least that lose all; null text counts as empty; a null
    doc_id is kept; other columns are ignored; no rows give no rows.  Strings
    count as equal when their bytes are, or 64-bit hashes of longer strings
    around them.
    """
    if not GRAM < length <= GRAM + 255:
        raise ValueError(f"length must be {GRAM + 1} to {GRAM + 255}")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keys(text), text.alias("text"))
    found = repeated_stretches(keyed.select("k1", "k2", "text"), length).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    spans = materialize(found.select("k1", "k2", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops")), "spans")
    joined = keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "starts", "stops")
    return joined.mapInArrow(_cut_out, "doc_id long, text binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
