"""Which names of a registry table stand in which texts, case ignored.

A registry within AUTOMATON names and characters goes to all tasks as one
automaton, which reads each text once for all names.  A longer one is joined:
every name waits under its rarest gram, of the largest of SIZES that it has,
texts bring the grams that some name waits under, and the pairs that meet are
verified.  Of the texts' grams only those are shuffled whose bit is set among the
waiting ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.plans.storage import materialize, shuffled

#: Names, and characters of names, of a registry that is sent to all tasks.
AUTOMATON = (100_000, 4_000_000)
#: Characters of grams; the longer they are, the fewer texts meet a name in vain.
SIZES = (3, 5, 8, 12)
#: Distinct grams that a task holds before it hands on their counts.
FLUSH = 500_000
#: Bits that tell which grams none waits under, in a map of 2 MB; where they fill up, the join alone tells.
BITS = 1 << 24

#: An odd number whose multiples mix all bits.
_MIX = np.uint64(0x9E3779B97F4A7C15)

_BUILT: dict = {}


def _automaton(names):
    """One automaton per worker process and registry."""
    if names.id not in _BUILT:
        import ahocorasick

        built = ahocorasick.Automaton()
        for name in names.value:
            built.add_word(name, name)
        built.make_automaton()
        _BUILT.clear()
        _BUILT[names.id] = built
    return _BUILT[names.id]


class _Sent:
    """A broadcast list with a number, so that a worker knows which it has built."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return self.broadcast, self.id

    def __setstate__(self, state):
        self.broadcast, self.id = state

    @property
    def value(self):
        return self.broadcast.value


def _scanned(names):
    """(key, lower-case text) to (key, alias), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(names)
        for batch in batches:
            at, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = {name for _, name in automaton.iter(text)} if len(automaton) else ()
                at += [k] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(found, pa.string())], ["key", "alias"])

    return run


def grams(text: str, sizes: Sequence[int] = SIZES[:1]) -> np.ndarray:
    """Hashes of the distinct runs of these numbers of characters, in order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = [np.zeros(0, np.uint64)]
    for size in sizes:
        if size <= len(points):
            found.append(np.full(len(points) - size + 1, size, np.uint64))
            for k in range(size):
                found[-1] = (found[-1] ^ points[k : len(points) - size + 1 + k]) * _MIX
    return np.unique(np.concatenate(found)).view(np.int64)


def _bits(waiting: DataFrame):
    """A map with the bits of these grams set, sent to all tasks."""
    place = F.pmod("gram", F.lit(BITS)) + 1  # Spark counts from 1
    rows = waiting.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("map")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * len(r["map"])
        out[at : at + len(r["map"])] = np.frombuffer(r["map"], np.uint8)
    return waiting.sparkSession.sparkContext.broadcast(out)


def _awaited(own: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The grams whose bit is set."""
    place = own % BITS
    return own[bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1]


def _gram_counts(sizes: Sequence[int], bits):
    """(text) to (gram, n): in how many of the texts a gram is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], ["gram", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(_awaited(grams(text, sizes), bits.value))
                size += len(held[-1])
                if size > FLUSH:
                    yield out()
                    size = 0
        yield out()

    return run


def _grams_of(sizes: Sequence[int], bits):
    """(key, text) to (key, gram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _spread(batch.column(0), "key", [_awaited(grams(text, sizes), bits.value) for text in batch.column(1).to_pylist()])

    return run


def _named_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(alias) to (alias, gram)."""
    for batch in batches:
        yield _spread(batch.column(0), "alias", [grams(name, [_size(len(name))]) for name in batch.column(0).to_pylist()])


def _size(length: int) -> int:
    """The grams that a name of this length waits under."""
    return max(size for size in SIZES if size <= length)


def _spread(keys: pa.Array, name: str, own: list[np.ndarray]) -> pa.RecordBatch:
    """A row per key and gram."""
    at = np.repeat(np.arange(len(own)), [len(g) for g in own])
    return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))], [name, "gram"])


def alias_matches(texts: DataFrame, registry: DataFrame, key: str, text: str, alias: str, bound: tuple[int, int] | None = None) -> DataFrame:
    """key, alias (lower case) of the texts that contain it, each pair once a row of ``texts``.

    Null and empty names and null texts match nothing; names that are equal
    but for case are one; rows of one key are reported together.
    """
    spark, kind = texts.sparkSession, texts.schema[key].dataType.simpleString()
    names = materialize(registry.select(F.lower(F.col(alias)).alias("alias")).where("alias <> ''").distinct(), "aliases")
    low = texts.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("low")).where("low <> ''")
    count, chars = names.agg(F.count("*"), F.coalesce(F.sum(F.length("alias")), F.lit(0))).first()
    most = AUTOMATON if bound is None else bound
    if count <= most[0] and chars <= most[1]:
        sent = _Sent(spark.sparkContext.broadcast([r.alias for r in names.collect()]))
        found = low.mapInArrow(_scanned(sent), f"key {kind}, alias string")
        return found.distinct()
    short = names.where("length(alias) < 3")
    long = names.where("length(alias) >= 3")
    sizes = sorted({_size(r.n) for r in long.select(F.least(F.length("alias"), F.lit(SIZES[-1])).alias("n")).distinct().collect()})
    waiting = materialize(long.mapInArrow(_named_grams, "alias string, gram long"), "waiting")
    counted = low.select("low").mapInArrow(_gram_counts(sizes, _bits(waiting)), "gram long, n long").join(shuffled(waiting.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("n"))
    rarest = waiting.join(shuffled(counted), "gram", "left").groupBy("alias").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("one"))
    rarest = materialize(rarest.where("one.n > 0").select("alias", "one.gram"), "rarest")
    brought = low.mapInArrow(_grams_of(sizes, _bits(rarest)), f"key {kind}, gram long").join(shuffled(rarest.select("gram").distinct()), "gram", "left_semi").distinct()
    met = materialize(brought.join(shuffled(rarest), "gram").select("key", "alias"), "met")
    found = met.join(shuffled(low), "key").where(F.col("low").contains(F.col("alias"))).select("key", "alias")
    if not short.isEmpty():  # names of one or two characters are as many as there are characters: the automaton's
        sent = _Sent(spark.sparkContext.broadcast([r.alias for r in short.collect()]))
        found = found.union(low.mapInArrow(_scanned(sent), f"key {kind}, alias string"))
    return found.distinct()

