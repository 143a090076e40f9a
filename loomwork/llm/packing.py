"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

1. Tasks tokenize and cut; only (doc_id, piece, start, length, crc) is written.
2. Counts per (length, salt) give the histogram from which ``packing_plan``
   makes runs, and the rank at which each salt of a length begins.  The salt
   splits a length that a large share of all documents may have.
3. Each piece's rank within its length, from a window over (length, salt),
   finds its run, hence its sequence and offset.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.llm.packing_plan import make_plan
from loomwork.llm.token_counts import load_tokenizer
from loomwork.plans.storage import materialize

END_OF_DOCUMENT = 1
#: Blank-separated strings that a task, and words in them that a worker remembers, of so many characters at most; it starts anew beyond that.
REMEMBERED_STRINGS, REMEMBERED_WORDS, REMEMBERED_CHARS = 500_000, 300_000, 40
#: Strings of a text between two looks at how much is remembered.
STRETCH = 100_000
#: Separators to str.split, but not to the tokenizer.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Composed letters that the tokenizer's normalizer only lower-cases.
_PLAIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Words(dict):
    """Lower-case strings and their ids, encoded when first seen."""

    def __init__(self, tokenizer):
        super().__init__()
        self.encode, self.split, self.merge = tokenizer.encode, tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize

    def __missing__(self, string: str) -> bytes:
        value = array("I", self.encode(string, add_special_tokens=False).ids).tobytes()
        if len(string) <= REMEMBERED_CHARS:
            self[string] = value
        return value

    def plain(self, word: str) -> bytes:
        """The ids of lower-case composed letters, of which normalization and splitting make one piece."""
        value = self.get(word)
        if value is None:
            [(piece, _)] = [(word, None)] if word.isascii() else self.split(word)
            value = array("I", [t.id for t in self.merge(piece)]).tobytes()
            if len(word) <= REMEMBERED_CHARS:
                self[word] = value
        return value


class WordIds(dict):
    """Little-endian 32-bit ids of blank-separated strings, right for tokenizers that drop white space.

    ``Word,`` is the word and the mark; words of plain letters are encoded once
    whatever their case and mark, anything else is encoded as it stands.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.words = tokenizer, _Words(tokenizer)

    def __missing__(self, string: str) -> bytes:
        word, mark = (string[:-1], string[-1]) if string[-1] in ".,;:!?" else (string, "")
        if _PLAIN_WORD.fullmatch(word):
            value = self.words.plain(word.lower())
            if mark:
                value += self.words[mark]
        else:
            value = self.words[string]
        if len(string) <= REMEMBERED_CHARS:
            self[string] = value
        return value

    def of(self, text: str) -> bytes:
        if _NOT_SPACE.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        strings, parts = text.split(), []
        for k in range(0, len(strings), STRETCH):
            if len(self) > REMEMBERED_STRINGS:
                self.clear()
            if len(self.words) > REMEMBERED_WORDS:
                self.words.clear()
            parts.append(b"".join(map(self.__getitem__, strings[k : k + STRETCH])))
        return b"".join(parts)


_WORDS: dict[str, WordIds] = {}


def _cut(tokenizer_path: str, capacity: int):
    end, most = np.array([END_OF_DOCUMENT], "<u4").tobytes(), 4 * capacity
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _WORDS:
            _WORDS[tokenizer_path] = WordIds(load_tokenizer(tokenizer_path))
        words = _WORDS[tokenizer_path]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = words.of(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(data), most)):
                    part = data[at : at + most]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        words.clear()  # few strings of one task are in the next; a worker that waits should hold little

    return run


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int) -> DataFrame:
    """Lengths and checksums of the pieces of every document; the last piece may be shorter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(tokenizer_path, capacity), PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text) with its sequence_id and offset.

    Null and empty texts are the end-of-document id alone; equal rows are
    packed one by one; a null doc_id is kept; other columns are ignored; no
    rows give no rows.  Sequences are gapless from offset 0.
    """
    pieces = materialize(tokenized_pieces(docs, tokenizer_path, capacity), "packing")
    return place(pieces, capacity)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (any table with a length from 1 to ``capacity``) with sequence_id and offset."""
    spark = pieces.sparkSession
    salts = max(16, min(1024, pieces.count() // 2_000_000))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counted = salted.groupBy("length", "salt").count().toArrow()  # at most capacity * salts rows
    counts = np.zeros((capacity + 1, salts), dtype=np.int64)
    counts[counted["length"].to_numpy(), counted["salt"].to_numpy()] = counted["count"].to_numpy()
    begins = np.cumsum(counts, axis=1) - counts
    known = spark.sparkContext.broadcast((begins, make_plan(counts.sum(axis=1), capacity)))
    columns = pieces.columns
    order = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, plan = known.value
        for batch in batches:
            length, salt = batch.column("length").to_numpy(), batch.column("salt").to_numpy()
            rank = begins[length, salt] + batch.column("turn").to_numpy() - 1
            sequence, offset = plan.place(length, rank)
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*columns, "sequence_id", "offset"])

    schema = f"{', '.join(f'{n} {t}' for n, t in pieces.dtypes)}, sequence_id long, offset long"
    return salted.withColumn("turn", F.row_number().over(order)).mapInArrow(locate, schema)
