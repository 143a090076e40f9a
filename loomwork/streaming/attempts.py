"""Attempts at nodes as a stream with state: success, failure, or another try that falls due after a doubling wait.

A node's state is its attempts up to the first success, by their numbers, so
rows may come in any order and any batches.  A node that may try again has a
timer at the end of its wait, in event time; the timer goes when a later
attempt comes, and fires as a row of its own otherwise.

Every call to the state store is a round trip of its own, so a batch's rows of
a node are put together before the store is asked, and numbers are kept as bits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
RESULT = "node long, kind string, tries int, state string, wait double, due timestamp"

#: Numbers a block, as a power of two; blocks that a task puts together before it writes them.
SHIFT, HELD = 9, 4096
BLOCK = 1 << SHIFT
#: Stands for a number that is null: the last of all, and never a success.
UNNUMBERED = (1 << 63) - 1


def _packed(bits: int) -> bytes:
    return bits.to_bytes((bits.bit_length() + 7) // 8, "little")


def _upto(bits: int, block: int, last: int | None) -> int:
    """A block's bits without the numbers after ``last``."""
    over = BLOCK if last is None else last + 1 - block * BLOCK
    return bits & ((1 << max(over, 0)) - 1)


class Attempts(StatefulProcessor):
    """Rows (node, seq, good, at) to RESULT rows: kind ``state`` where it may have changed, ``due`` when a wait ends.

    ``node`` is the number of the first success, the time of the last attempt,
    the time of the timer, the attempts in ``blocks``, and the numbers of block
    0 as bits; ``blocks`` are the bits of all other numbers.
    """

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.node = handle.getValueState("node", "first long, latest long, due long, others long, bits binary")
        self.blocks = handle.getMapState("blocks", "block long", "bits binary")

    def _put(self, found: dict[int, int]) -> int:
        """Adds numbers to the blocks; how many were new."""
        new = 0
        for block, bits in found.items():
            held = self.blocks.getValue((block,))
            old = int.from_bytes(held[0], "little") if held else 0
            if bits | old != old:
                self.blocks.updateValue((block,), (_packed(bits | old),))
                new += (bits & ~old).bit_count()
        found.clear()
        return new

    def _cut(self, first: int) -> int:
        """Takes the numbers after ``first`` out of the blocks; how many stay."""
        left = 0
        for (block,) in list(self.blocks.keys()):
            if block > first >> SHIFT:
                self.blocks.removeKey((block,))
                continue
            old = int.from_bytes(self.blocks.getValue((block,))[0], "little")
            bits = _upto(old, block, first)
            if bits != old:
                self.blocks.updateValue((block,), (_packed(bits),))
            left += bits.bit_count()
        return left

    def _now(self, first: int | None, latest: int, tries: int) -> tuple[int, str, float | None, int | None]:
        """tries, state, wait, milliseconds at which the next try falls due."""
        if first is not None:
            return tries, "done", None, None
        if tries >= self.most:
            return tries, "failed", None, None
        wait = 2.0 ** (tries - 1)
        return tries, "retry", wait, latest + int(wait * 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.node.get()
        success, latest, timer, others, packed = held or (None, None, None, 0, b"")
        first, bits, found = success, int.from_bytes(packed, "little"), defaultdict(int)
        for _, seq, good, at in rows:
            number = UNNUMBERED if seq is None else seq
            if first is not None and number > first:
                continue
            if good and seq is not None:
                first = number
            then = int(at.replace(tzinfo=at.tzinfo or timezone.utc).timestamp() * 1000) if at else 0
            latest = then if latest is None else max(latest, then)
            if number >> SHIFT:
                found[number >> SHIFT] |= 1 << (number & BLOCK - 1)
                if len(found) >= HELD:
                    others += self._put(found)
            else:
                bits |= 1 << number
        others += self._put(found)
        if first != success:
            bits, others = _upto(bits, 0, first), self._cut(first) if others else 0
        tries, state, wait, due = self._now(first, latest, bits.bit_count() + others)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        kept = (first, latest, due, others, _packed(bits))
        if kept != held:
            self.node.update(kept)
        yield self._row(key, "state", tries, state, wait, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first, latest, _, others, packed = self.node.get()
        self.node.update((first, latest, None, others, packed))  # Spark takes the timer out
        tries, state, wait, due = self._now(first, latest, int.from_bytes(packed, "little").bit_count() + others)
        if state == "retry":
            yield self._row(key, "due", tries, state, wait, due)

    def _row(self, key, kind: str, tries: int, state: str, wait: float | None, due: int | None) -> Row:
        return Row(node=key[0], kind=kind, tries=tries, state=state, wait=wait, due=None if due is None else datetime.fromtimestamp(due / 1000, timezone.utc))

    def close(self) -> None:
        pass


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session, with the state store that states of several columns need."""
    spark.conf.set(*PROVIDER)
    return spark


def attempt_stream(events: DataFrame, most: int = 3, late: str = "0 seconds") -> DataFrame:
    """RESULT rows, as they change, of a stream of attempts (node, seq, ok, seconds, limit, at).

    An attempt counts as good within its limit (a null limit is none); null
    ``ok`` or ``seconds`` as failed; a number that comes twice counts once, as
    good if it ever was; null nodes are one node.  Rows that come later than ``late`` after a newer
    one, in event time, are dropped by the watermark.
    """
    with_state_store(events.sparkSession)
    good = F.col("ok") & F.col("seconds").isNotNull() & (F.col("limit").isNull() | (F.col("seconds") <= F.col("limit")))
    slim = events.select("node", "seq", F.coalesce(good, F.lit(False)).alias("good"), "at").withWatermark("at", late)
    return slim.groupBy("node").transformWithState(statefulProcessor=Attempts(most), outputStructType=RESULT, outputMode="Update", timeMode="EventTime")
