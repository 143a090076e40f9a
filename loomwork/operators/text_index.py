"""A kept text index: postings in a shared folder, changed by batches, read by the terms of a query alone.

Every batch writes a segment: one row per term and block of documents, with
the documents' numbers, counts and positions, packed as steps.  Rows are partitioned by a
bucket of the term and sorted by term, so a query's scan lists the files of
its terms' buckets only and skips row groups by term.  Replaced and deleted
documents are listed as dead until a merge; ``plans.versions`` makes a batch
visible as a whole or not at all.

Terms are all runs of three characters of the lower-cased text (``grams``, for
phrases in any script) or its words of a-z and 0-9 (``words``).  Scores are
those of ``search.phrase_bm25`` and ``search.bm25`` over the live documents.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.best_first import best_first
from loomwork.operators.ordering import running_sum
from loomwork.plans.storage import materialize, materialize_in_groups, small_side
from loomwork.plans.versions import Versions

BUCKETS = 64
#: A block ends with so many documents or characters.
BLOCK_DOCS, BLOCK_CHARS = 1024, 4_000_000
#: Rows of one bucket are written by so many tasks, so that a hot term is not one task's.
SHARES = 8
#: Keys that repeat in a batch up to which other rows' texts are not shuffled.
REPEATED = 500_000
#: Rows of a batch up to which it is shuffled whole, as its parts would fill few blocks.
SMALL_BATCH = 16 * BLOCK_DOCS
#: Characters of ``grams``; END pads a text, so that its last characters begin a gram too.
GRAM, END = 3, "\0"

_WORD = re.compile("[a-z0-9]+")

POSTINGS = "term string, block long, n int, most int, shortest int, ids binary, counts binary, positions binary"


def _terms(text: str, kind: str) -> tuple[int, list[tuple[str, np.ndarray]]]:
    """The length of a text, in terms, and each term's positions in order."""
    if kind == "words":
        at: dict[str, list[int]] = {}
        n = 0
        for n, word in enumerate(_WORD.findall(text), 1):
            at.setdefault(word, []).append(n - 1)
        return n, [(w, np.array(p, np.int32)) for w, p in at.items()]
    if not text:
        return 0, []
    points = np.frombuffer((text + END * (GRAM - 1)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    order = np.argsort(codes, kind="stable").astype(np.int32)
    ranked = codes[order]
    cuts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    names = ["".join(map(chr, (c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF))) for c in ranked[cuts].tolist()]
    return max(0, len(text) - 2), list(zip(names, np.split(order, cuts[1:])))


def _length(text: str, kind: str) -> int:
    """The length of a text, in terms."""
    return len(_WORD.findall(text)) if kind == "words" else max(0, len(text) - GRAM + 1)


def _numbered(segment: int, kind: str):
    """(key, text) to (key, text, id, block, length): ids are unique, blocks bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = block = segment << 48 | TaskContext.get().partitionId() << 30
        chars = 0
        for batch in batches:
            ids, blocks, lengths = [], [], []
            for text in batch.column(1).to_pylist():
                if at - block >= BLOCK_DOCS or chars >= BLOCK_CHARS:
                    block, chars = at, 0
                ids.append(at), blocks.append(block), lengths.append(_length(text, kind))
                at, chars = at + 1, chars + len(text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64()), pa.array(blocks, pa.int64()), pa.array(lengths, pa.int32())], ["key", "text", "id", "block", "length"])

    return run


def _postings(kind: str):
    """(id, block, text), blocks in order, to POSTINGS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        lengths: list[tuple[int, int]] = []
        block = None

        def out() -> pa.RecordBatch:
            size = dict(lengths)
            rows = [(term, block, len(own), max(len(p) for _, p in own), min(size[i] for i, _ in own), [i for i, _ in own], [len(p) for _, p in own], np.concatenate([p for _, p in own])) for term, own in held.items()]
            held.clear(), lengths.clear()
            return _rows(rows)

        for batch in batches:
            for doc, own, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if block is not None and own != block:
                    yield out()
                block = own
                n, terms = _terms(text, kind)
                lengths.append((doc, n))
                for term, positions in terms:
                    held.setdefault(term, []).append((doc, positions))
        if block is not None:
            yield out()

    return run


_SCHEMA = pa.schema([("term", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("most", pa.int32()), ("shortest", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("positions", pa.binary())])


def _packed(rows: list[np.ndarray]) -> pa.Array:
    """Each row of numbers as bytes: the steps from one to the next, signs last, seven bits a byte."""
    return _packed_runs(np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), np.cumsum([len(r) for r in rows], dtype=np.int64))


def _packed_runs(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The same of rows that lie one after another and end at ``ends``."""
    steps = np.diff(flat, prepend=0)
    first = np.r_[0, ends[:-1]][np.diff(ends, prepend=0) > 0]
    steps[first] = flat[first]
    codes = steps << 1 ^ steps >> 63
    width = 1 + sum((codes >> 7 * k > 0).astype(np.int64) for k in range(1, 9))
    at = np.r_[0, np.cumsum(width)]
    out = np.zeros(at[-1], np.uint8)
    for k in range(width.max(initial=0)):
        has = np.flatnonzero(width > k)
        out[at[has] + k] = codes[has] >> 7 * k & 127 | (width[has] > k + 1) << 7
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at[np.r_[0, ends]].astype(np.int32)), pa.py_buffer(out)])


def _unpacked(packed: pa.Array) -> np.ndarray:
    """The numbers of all rows that ``_packed`` made, one after another."""
    _, offsets, data = packed.buffers()
    offsets = np.frombuffer(offsets, np.int32)[packed.offset : packed.offset + len(packed) + 1] if len(packed) else np.zeros(1, np.int32)
    if offsets[0] == offsets[-1]:
        return np.zeros(0, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    last = data < 128
    ends = np.flatnonzero(last) + 1
    starts = np.r_[0, ends[:-1]]
    place = np.arange(len(data)) - np.repeat(starts, ends - starts)
    codes = np.add.reduceat((data & 127).astype(np.int64) << 7 * place, starts)
    sums = np.r_[0, np.cumsum(codes >> 1 ^ -(codes & 1))]
    rows = np.r_[0, np.cumsum(last)][offsets - offsets[0]]
    return sums[1:] - np.repeat(sums[rows[:-1]], np.diff(rows))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    plain = [pa.array([r[k] for r in rows], field.type) for k, field in enumerate(_SCHEMA) if field.type != pa.binary()]
    return pa.RecordBatch.from_arrays([*plain, *(_packed([r[k] for r in rows]) for k in range(len(plain), len(_SCHEMA)))], schema=_SCHEMA)


def _opened(positions: bool):
    """POSTINGS rows to one row per term and document, with or without positions."""
    schema = pa.schema([("term", pa.string()), ("block", pa.int64()), ("id", pa.int64()), ("count", pa.int32())] + [("positions", pa.list_(pa.int32()))] * positions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _unpacked(batch.column("counts"))
            where = pa.array(np.repeat(np.arange(batch.num_rows), batch.column("n").to_numpy()))
            arrays = [batch.column("term").take(where), batch.column("block").take(where), pa.array(_unpacked(batch.column("ids"))), pa.array(counts, pa.int32())]
            if positions:
                offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(offsets, pa.array(_unpacked(batch.column("positions")), pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _each(rows: DataFrame, positions: bool = True) -> DataFrame:
    """term, block, id, count and positions of POSTINGS rows."""
    return rows.mapInArrow(_opened(positions), "term string, block long, id long, count int" + ", positions array<int>" * positions)


def _dead_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(to, ids array) to (block, ids packed)."""
    for batch in batches:
        lists = batch.column(1)
        ids = _packed([np.sort(own.values.to_numpy()) for own in lists])
        yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["block", "ids"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """POSTINGS rows and bucket, by bucket, term, block and ids, to rows of the live, one a term and block.

    Rows without a term come first in a bucket: their ids are the dead ones of
    a block.  The shortest document may be a dead one's, which leaves bounds
    bounds.
    """
    dead, bucket = np.zeros(0, np.int64), None
    held: tuple | None = None  # the last term and block, as its next rows may be in the next batch

    def out(keys: list[tuple], flat: list[np.ndarray], n: np.ndarray, shortest: np.ndarray) -> pa.RecordBatch:
        ids, counts, positions = flat
        some = np.flatnonzero(n > 0)
        ends = np.cumsum(n)
        counted = np.r_[0, np.cumsum(counts)]
        most = np.maximum.reduceat(counts, (ends - n)[some]) if len(some) else np.zeros(0, np.int64)
        keys = [keys[k] for k in some.tolist()]
        plain = [pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int64()), pa.array(n[some], pa.int32()), pa.array(most, pa.int32()), pa.array(shortest[some], pa.int32())]
        packed = [_packed_runs(ids, ends[some]), _packed_runs(counts, ends[some]), _packed_runs(positions, counted[ends[some]])]
        return pa.RecordBatch.from_arrays([*plain, *packed, pa.array([k[0] for k in keys], pa.int32())], schema=_SCHEMA.append(pa.field("bucket", pa.int32())))

    for batch in batches:
        own = batch.column("bucket").to_pylist()
        cuts = [k for k in range(1, len(own)) if own[k] != own[k - 1]]
        for start, end in zip([0, *cuts], [*cuts, len(own)]):  # the rows of one bucket
            part = batch.slice(start, end - start)
            if own[start] != bucket:
                bucket, dead = own[start], np.zeros(0, np.int64)
            gone = part.num_rows - part.column("term").null_count
            lost = part.slice(0, part.num_rows - gone)
            if lost.num_rows:
                dead = np.sort(np.r_[dead, _unpacked(lost.column("ids"))])
            part = part.slice(lost.num_rows)
            if not part.num_rows:
                continue
            ids, counts, positions = (_unpacked(part.column(c)) for c in ("ids", "counts", "positions"))
            n = part.column("n").to_numpy().astype(np.int64)
            if len(dead):
                live = dead[np.minimum(np.searchsorted(dead, ids), len(dead) - 1)] != ids
                n = np.diff(np.r_[0, np.cumsum(live)][np.r_[0, np.cumsum(n)]])
                ids, positions, counts = ids[live], positions[np.repeat(live, counts)], counts[live]
            keys = list(zip(own[start:end][lost.num_rows :], part.column("term").to_pylist(), part.column("block").to_pylist()))
            shortest = part.column("shortest").to_numpy()
            if held is not None:
                keys, n, shortest = [held[0], *keys], np.r_[held[1], n], np.r_[held[2], shortest]
                ids, counts, positions = (np.r_[x, y] for x, y in zip(held[3], (ids, counts, positions)))
            firsts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1])]
            n, shortest, keys = np.add.reduceat(n, firsts), np.minimum.reduceat(shortest, firsts), [keys[k] for k in firsts]
            last = len(ids) - n[-1]
            at = counts[:last].sum()
            held = keys[-1], n[-1:], shortest[-1:], (ids[last:], counts[last:], positions[at:])
            if len(keys) > 1:
                yield out(keys[:-1], [ids[:last], counts[:last], positions[:at]], n[:-1], shortest[:-1])
    if held is not None:
        yield out([held[0]], list(held[3]), held[1], held[2])


def _bucket(term: Column | str, kind: str) -> Column:
    """Of a word, or of the first two characters of a gram, so that a phrase of two is in one bucket."""
    term = F.col(term) if isinstance(term, str) else term
    return F.pmod(F.xxhash64(F.substring(term, 1, 2) if kind == "grams" else term), F.lit(BUCKETS)).cast("int")


def _apart(places: Column, size: int) -> Column:
    """How many of these places, from the left, begin after the one before has ended."""
    step = lambda s, at: F.when(at >= s["free"], F.struct((at + size).alias("free"), (s["n"] + 1).alias("n"))).otherwise(s)
    return F.aggregate(F.array_sort(places), F.struct(F.lit(0).alias("free"), F.lit(0).alias("n")), step)["n"]


@dataclass
class TextIndex:
    """An index in ``folder``, of ``grams`` or ``words``, with keys of type ``key``; its state is the last committed version."""

    spark: SparkSession
    folder: str
    kind: str = "grams"
    key: str = "string"

    def __post_init__(self):
        self.document = f"key {self.key}, id long, block long, length int"

    def _versions(self) -> Versions:
        return Versions(self.spark, self.folder)

    def _state(self) -> tuple[int, dict]:
        number, state = self._versions().latest()
        return number, state or {"segments": [], "dead": [], "n": 0, "length": 0}

    def _read(self, paths: Sequence[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _segments(self, state: dict) -> DataFrame:
        """POSTINGS rows and bucket of the live segments."""
        paths, base = [f"{self.folder}/postings/segment={s}" for s in state["segments"]], f"{self.folder}/postings"
        schema = POSTINGS + ", segment string, bucket int"
        rows = self.spark.read.schema(schema).option("basePath", base).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.drop("segment")

    def documents(self, state: dict | None = None) -> DataFrame:
        """key, id, block, length of the live documents."""
        state = state or self._state()[1]
        docs = self._read([f"{self.folder}/documents/{s}" for s in state["segments"]], self.document)
        return docs.join(self._dead(state).select("id"), "id", "left_anti") if state["dead"] else docs

    def _dead(self, state: dict) -> DataFrame:
        return self._read([f"{self.folder}/{d}" for d in state["dead"]], "id long, block long")

    def postings(self, terms: Sequence[str] = (), prefixes: Sequence[str] = (), state: dict | None = None) -> DataFrame:
        """POSTINGS rows of the terms, and of all terms with one of the prefixes; only their buckets are listed.

        A prefix of one character is looked up in all buckets.
        """
        state = state or self._state()[1]
        rows = self._segments(state)
        wanted = F.col("term").isin(list(terms)) if terms else F.lit(False)
        for prefix in prefixes:
            wanted = wanted | F.col("term").startswith(prefix)
        if any(len(p) < 2 for p in prefixes):
            return rows.where(wanted)
        seen = self.spark.range(1).select(*[_bucket(F.lit(t), self.kind).alias(f"b{k}") for k, t in enumerate((*terms, *prefixes))]).first()
        return rows.where(F.col("bucket").isin(sorted(set(seen))) & wanted)

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
        """One batch: rows (key, text) that replace those of their keys, and keys to delete; the new version's number.

        Null keys are ignored, null texts are empty; of
        rows of one key that of the greatest text stays.  Rows are read twice
        and should come the same each time, as from a scan or a written table.  If another writer was
        first nothing changes and ``versions.Conflict`` is raised: the batch may
        be applied again.
        """
        number, state = self._state()
        name, keys = f"segment-{number + 1}-{uuid.uuid4().hex}", []
        added = {"n": 0, "length": 0}
        if upserts is not None:
            low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
            rows = upserts.select(F.col("key").cast(self.key).alias("key"), low.alias("text")).where("key is not null")
            rows = self._once(rows).mapInArrow(_numbered(number + 1, self.kind), f"key {self.key}, text string, id long, block long, length int")
            staged = materialize_in_groups(rows, "staged")
            self._write_segment(name, staged)
            added = self._read([f"{self.folder}/documents/{name}"], self.document).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first().asDict()
            keys.append(staged.select("key"))
        if deletes is not None:
            keys.append(deletes.select(F.col("key").cast(self.key).alias("key")))
        dead, gone = [], {"n": 0, "length": 0}
        if keys and state["segments"]:
            lost = materialize(self.documents(state).join(reduce(DataFrame.unionByName, keys).distinct(), "key", "left_semi").select("id", "block", "length"), "dead")
            gone = lost.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first().asDict()
            if gone["n"]:
                dead = [f"dead-{number + 1}-{uuid.uuid4().hex}"]
                lost.select("id", "block").write.parquet(f"{self.folder}/{dead[0]}")
        new = {"segments": state["segments"] + ([name] if upserts is not None else []), "dead": state["dead"] + dead}
        new |= {k: state[k] + added[k] - gone[k] for k in ("n", "length")}
        self._versions().commit(number + 1, new)
        return number + 1

    def _once(self, rows: DataFrame) -> DataFrame:
        """Rows (key, text) with one of each key; only texts of keys that repeat are shuffled, unless those are many or the batch is small."""
        seen = Observation()
        again = materialize(rows.observe(seen, F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated")
        n, greatest = again.count(), lambda df: df.groupBy("key").agg(F.max("text").alias("text"))
        if n > REPEATED or seen.get["n"] <= SMALL_BATCH:
            return greatest(rows)
        if not n:
            return rows
        several = greatest(rows.join(F.broadcast(again), "key", "left_semi"))
        return rows.join(F.broadcast(again), "key", "left_anti").unionByName(several)

    def _write_segment(self, name: str, staged: DataFrame) -> None:
        # A staged file has its blocks in order.  Where a read cuts a block in two, its terms have two rows, as between segments.
        staged.select("key", "id", "block", "length").write.parquet(f"{self.folder}/documents/{name}")
        rows = staged.select("id", "block", "text").mapInArrow(_postings(self.kind), POSTINGS)
        self._write_postings(name, self._dealt(rows.withColumn("bucket", _bucket("term", self.kind))))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows by bucket and a share of the blocks, in order."""
        return rows.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(SHARES))).sortWithinPartitions("bucket", "term", "block")

    def _write_postings(self, name: str, dealt: DataFrame) -> None:
        dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/postings/segment={name}")

    def merge(self) -> int:
        """All segments as one, without dead documents, in blocks of up to BLOCK_DOCS; the new version's number.

        Rows of postings stay packed until the task that joins them, which also
        gets the dead of its blocks.
        """
        number, state = self._state()
        name = f"segment-{number + 1}-{uuid.uuid4().hex}"
        docs = materialize(self.documents(state), "live")
        sizes = docs.groupBy("block").agg(F.count("*").alias("n"))
        # Blocks in order are joined while they fit; ``to`` numbers the joined ones.
        moved = running_sum(sizes, ["block"], "n", "upto").select("block", (F.lit((number + 1) << 48) + F.floor((F.col("upto") - 1) / BLOCK_DOCS)).alias("to"))
        moved = small_side(materialize(moved, "moved"))
        docs.join(moved, "block").select("key", "id", F.col("to").alias("block"), "length").write.parquet(f"{self.folder}/documents/{name}")
        columns = ["term", "block", "n", "most", "shortest", "ids", "counts", "positions", "bucket"]
        rows = self._segments(state).join(moved, "block").drop("block").withColumnRenamed("to", "block").select(*columns)
        if state["dead"]:
            lost = self._dead(state).join(moved, "block").groupBy("to", F.col("block").alias("own")).agg(F.collect_list("id").alias("ids"))
            packed = lost.select("to", "ids").mapInArrow(_dead_rows, "block long, ids binary")
            nothing = {"term": "string", "n": "int", "most": "int", "shortest": "int", "counts": "binary", "positions": "binary"}
            every = packed.select("*", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("bucket"))
            rows = rows.unionByName(every.select(*columns))
        schema = POSTINGS + ", bucket int"
        joined = self._dealt(rows).mapInArrow(_joined, schema)
        self._write_postings(name, joined.sortWithinPartitions("bucket", "term", "block"))
        self._versions().commit(number + 1, state | {"segments": [name], "dead": []})
        return number + 1

    def _live(self, rows: DataFrame, state: dict) -> DataFrame:
        opened = _each(rows)
        return opened.join(self._dead(state).select("id"), "id", "left_anti") if state["dead"] else opened

    def bm25(self, terms: Sequence[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """key, score, rank of the ``k`` best documents that hold every one of these words; ties go to the smaller key.

        Scores are rounded to 9 places before they are ranked.  A block's
        bound, from each term's greatest count and the shortest document that
        holds it, decides whether its documents are scored.
        """
        state = self._state()[1]
        terms = list(dict.fromkeys(terms))
        rows = materialize(self.postings(terms, state=state).drop("bucket", "positions"), "found")
        df = dict.fromkeys(terms, 0) | {r.term: r.n for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        if state["dead"]:
            touched = self._dead(state).select("block").distinct()
            dead = self._dead(state).select("id")
            lost = _each(rows.join(touched, "block", "left_semi"), positions=False).select("term", "id").join(dead, "id", "left_semi")
            df |= {r.term: df[r.term] - r.n for r in lost.groupBy("term").agg(F.count("*").alias("n")).collect()}
        n, mean = state["n"], state["length"] / max(1, state["n"]) or 1.0
        idf = F.create_map(*[F.lit(x) for t in terms for x in (t, max(float(np.log((n - df[t] + 0.5) / (df[t] + 0.5))), 1e-6))])
        part = lambda count, length: idf[F.col("term")] * (F.col(count) * (k1 + 1)) / (F.col(count) + k1 * (1 - b + b * F.col(length) / F.lit(mean)))
        whole = rows.groupBy(F.lit(0).alias("q"), F.col("block").alias("cell")).agg(F.count_distinct("term").alias("held"), F.sum(part("most", "shortest")).alias("bound"))
        bounds = materialize(whole.where(F.col("held") == len(terms)).select("q", "cell", (F.col("bound") * (1 + 1e-12) + 1e-9).alias("bound")), "bounds")
        docs = self.documents(state)

        def evaluate(opened: DataFrame) -> DataFrame:
            found = _each(rows.join(opened.select(F.col("cell").alias("block")), "block"), positions=False)
            scored = found.join(docs.select("id", "key", "length"), "id").groupBy("id", "key").agg(F.count("*").alias("held"), F.sum(part("count", "length")).alias("value"))
            return scored.where(F.col("held") == len(terms)).select(F.lit(0).alias("q"), "key", F.round("value", 9).alias("value"))

        return best_first(bounds, ["q"], k, evaluate, [F.col("key")], least=0).select("key", F.col("value").alias("score"), "rank")

    def phrases(self, phrases: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """key, score of the documents that contain every phrase (case ignored), of any length from one character on.

        A phrase's occurrences are the positions at which its grams follow one
        another; those that overlap an earlier one are not counted.
        """
        state = self._state()[1]
        found, tf = [], []
        for p, phrase in enumerate(x.lower() for x in phrases):
            hits = self._occurrences(phrase, state)
            found.append(materialize(hits.select("id", _apart(F.col("at"), len(phrase)).alias(f"tf{p}")), "phrase"))
            tf.append(found[-1].count())
        docs, n = self.documents(state), state["n"]
        met = reduce(lambda x, y: x.join(y, "id"), found).join(docs, "id")
        mean, score = state["length"] / max(1, n) or 1.0, F.lit(0.0)
        for p, df in enumerate(tf):
            idf = max(float(np.log((n - df + 0.5) / (df + 0.5))), 1e-6)
            score = score + F.lit(idf) * F.col(f"tf{p}") * (k1 + 1) / (F.col(f"tf{p}") + k1 * (1 - b + b * F.col("length") / F.lit(mean)))
        return met.select("key", score.alias("score"))

    def _occurrences(self, phrase: str, state: dict) -> DataFrame:
        """id, at (where the phrase begins, in any order) of the live documents that contain it."""
        if len(phrase) < GRAM:
            rows = self._live(self.postings(prefixes=[phrase], state=state), state)
            return rows.groupBy("id").agg(F.flatten(F.collect_list("positions")).alias("at"))
        # Every third gram and the last one cover the phrase.
        places = sorted({*range(0, len(phrase) - GRAM + 1, GRAM), len(phrase) - GRAM})
        named = [(phrase[p : p + GRAM], p) for p in places]
        rows = self._live(self.postings([g for g, _ in named], state=state), state)
        offsets = F.create_map(*[x for gram in dict.fromkeys(g for g, _ in named) for x in (F.lit(gram), F.array(*[F.lit(p) for g, p in named if g == gram]))])
        shifted = rows.select("id", "positions", F.explode(offsets[F.col("term")]).alias("p")).select("id", F.transform("positions", lambda x: x - F.col("p")).alias("at"))
        held = shifted.groupBy("id").agg(F.count("*").alias("n"), F.collect_list("at").alias("all")).where(F.col("n") == len(named))
        common = F.aggregate("all", F.element_at("all", 1), lambda s, x: F.array_intersect(s, x))
        return held.select("id", common.alias("at")).where(F.size("at") > 0)
