"""Bitmaps of fixed size that say which rows cannot be wanted, so that a join sees few others: for tasks and for plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """2^bits bits, set at the values of column ``place`` (at most 2^(bits - 5) rows reach the driver)."""
    word = F.floor(F.col("place") / 32).cast("int").alias("word")
    table = places.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 32 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[table["word"].to_numpy()] = table["bits"].to_numpy().astype(np.uint32)
    return out


def has_bit(words: np.ndarray, place: int) -> bool:
    return bool(int(words[place >> 5]) >> (place & 31) & 1)


#: Bits of the bitmap of a plan: 512 KB, whatever the number of entries.
PLAN_BITS = 1 << 22


def plan_bitmap(entries: DataFrame, column: str) -> DataFrame:
    """One row, one array of PLAN_BITS / 64 longs, with the bits of a column of hashes set."""
    bit = F.pmod(column, F.lit(PLAN_BITS))
    words = entries.groupBy(F.floor(bit / 64).cast("long").alias("id")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({column}, {PLAN_BITS}) % 64 as int))")).alias("bits"))
    dense = entries.sparkSession.range(PLAN_BITS // 64).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    ordered = dense.agg(F.sort_array(F.collect_list(F.struct("id", "bits"))).alias("all"))
    return ordered.select(F.transform("all", lambda x: x["bits"]).alias("bitmap"))


def in_bitmap(entry: Column, bitmap: DataFrame) -> Column:
    """Whether the bit of a hash is set in a written ``plan_bitmap``."""
    bit = F.pmod(entry, F.lit(PLAN_BITS))
    word = F.get(bitmap.select("bitmap").scalar(), F.shiftright(bit, 6).cast("int"))
    return F.coalesce(F.getbit(word, (bit % 64).cast("int")) == 1, F.lit(False))
