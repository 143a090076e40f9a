"""Token counts without ids: pieces once per distinct pre-token, joined to document frequencies.

A byte-pair tokenizer cuts a text into pre-tokens and merges inside each of
them, so a document's token count is the sum over its pre-tokens of
``frequency * pieces(pre-token)``.  Three passes:

1. every task counts its pre-tokens; the sums over tasks are the vocabulary;
2. each distinct pre-token is encoded once, only to count its pieces;
3. every document's pre-token frequencies meet those counts.  The head of the
   vocabulary (at most ``head_words`` entries of at most ``HEAD_CHARS``
   characters, so its size has a bound) is broadcast and summed on the spot;
   the tail goes through a join on the pre-token and a sum per document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.plans.storage import materialize

HEAD_WORDS = 400_000
HEAD_CHARS = 64
#: A task hands on its partial counts when it holds this many distinct pre-tokens.
FLUSH = 400_000

# Character classes of the byte-level split for code points up to U+02AF and common punctuation.
_L = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
_N = "0-9²³¹¼-¾"
_S = "\t-\r \u0085 "
_UNUSUAL = re.compile("[^\u0000-ʯ‐-‧€]|[\x1c-\x1f]")
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

_LOADED: dict = {}


def load_tokenizer(path: str):
    """One tokenizer per worker process and file."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def specials_of(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def pretokens(text: str, tokenizer, special: re.Pattern | None) -> tuple[list[str], int]:
    """The pre-tokens of ``text`` and how many added tokens stand between them.

    Usual characters are split by an equal pattern of the standard library;
    a part with any other character is split by the tokenizer itself.
    """
    parts = special.split(text) if special else [text]
    found: list[str] = []
    for part in parts:
        if not part:
            continue
        if _UNUSUAL.search(part):
            found += [part[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        else:
            found += _SPLIT.findall(part)
    return found, len(parts) - 1


def _special_pattern(tokenizer) -> re.Pattern | None:
    words = specials_of(tokenizer)
    return re.compile("|".join(map(re.escape, sorted(words, key=len, reverse=True)))) if words else None


def _vocabulary(tokenizer_path: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_path)
        special = _special_pattern(tokenizer)
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(pretokens(text.as_py() or "", tokenizer, special)[0])
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
        yield out()

    return run


def _pieces(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_path)
        for batch in batches:
            words = batch.column("word").to_pylist()
            for k in range(0, max(1, len(words)), 20_000):
                sizes = [len(e) for e in tokenizer.encode_batch(words[k : k + 20_000], add_special_tokens=False)]
                part = batch.slice(k, 20_000)
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array(sizes, pa.int64())], ["word", "n", "pieces"])

    return run


def _frequencies(tokenizer_path: str, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_path)
        special = _special_pattern(tokenizer)
        known = head.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, ids, sizes, words, counts = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                found, total = pretokens(text, tokenizer, special)
                for word, n in Counter(found).items():
                    pieces = known.get(word)
                    if pieces is None:
                        rows.append(row), ids.append(None), sizes.append(None), words.append(word), counts.append(n)
                    else:
                        total += pieces * n
                # This row's word joins nothing and spreads over the partitions; no pre-token has digits after \0.
                rows.append(row), ids.append(doc_id), sizes.append(len(text.encode())), words.append(f"\0{row}"), counts.append(total)
                row += 1
                if len(rows) > 200_000:
                    yield _frequency_batch(rows, ids, sizes, words, counts)
                    rows, ids, sizes, words, counts = [], [], [], [], []
            yield _frequency_batch(rows, ids, sizes, words, counts)

    return run


def _frequency_batch(rows, ids, sizes, words, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(words, pa.string()), pa.array(counts, pa.int64())],
        ["row", "doc_id", "n_bytes", "word", "n"],
    )


def piece_table(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """One row per distinct pre-token of ``docs``: word, n (occurrences), pieces."""
    words = docs.select(F.col(text)).mapInArrow(_vocabulary(tokenizer_path, text), "word string, n long")
    vocabulary = words.groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(vocabulary.mapInArrow(_pieces(tokenizer_path), "word string, n long, pieces long"), "pieces")


def _head(vocabulary: DataFrame, head_words: int) -> dict[str, int]:
    """The most frequent pre-tokens, whole frequency classes at a time, at most ``head_words`` of them."""
    usable = vocabulary.where(F.length("word") <= HEAD_CHARS)
    scale = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    classes = sorted(usable.groupBy(scale.alias("scale")).count().collect(), reverse=True)
    taken, least = 0, None
    for scale_value, n in classes:
        if taken + n > head_words:
            break
        taken, least = taken + n, scale_value
    if least is None:
        return {}
    table = usable.where(scale >= least).select("word", "pieces").toArrow()
    return dict(zip(table["word"].to_pylist(), table["pieces"].to_pylist()))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, head_words: int = HEAD_WORDS) -> DataFrame:
    """Tokens per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have 0 tokens; equal rows are counted one by one; a
    null doc_id is kept; other columns are ignored; no rows give no rows.  An
    added token's string inside a text counts as that one token.
    """
    vocabulary = piece_table(docs, tokenizer_path)
    head = docs.sparkSession.sparkContext.broadcast(_head(vocabulary, head_words))
    frequencies = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _frequencies(tokenizer_path, head), "row long, doc_id long, n_bytes long, word string, n long"
    )
    counted = frequencies.join(vocabulary.select("word", "pieces"), "word", "left")
    return (
        counted.groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
