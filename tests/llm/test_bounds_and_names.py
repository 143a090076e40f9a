"""Weights that do not depend on blocks of items, a bound on training rows, and columns that clash with working names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import decontamination
from loomwork.llm.decontamination import contamination, shingle_weights
from loomwork.llm.jaccard_join import one_of_each
from loomwork.llm.line_dedup import dedup_lines
from loomwork.llm.names import fresh
from loomwork.llm.toxicity import training_rows

SMALL = "/root/testdata/sf0.001"


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]


def weighted(text, item, counts):
    """Brute-force weighted similarity of the best window of the item's length."""
    grams = lambda ws: {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}
    weight = lambda g: 1 / (1 + np.log(max(1, counts.get(g, 0))))
    own, ws = grams(item.split()), text.split()
    n = min(len(item.split()), len(ws))
    best = 0.0
    for k in range(len(ws) - n + 1):
        window = grams(ws[k : k + n])
        both = sum(map(weight, window & own))
        best = max(best, both / sum(map(weight, window | own)))
    return best


def test_weights_are_those_of_the_whole_benchmark(spark, monkeypatch):
    rng = random.Random(4)
    common = words(rng, 30)
    items = [(k, " ".join(words(rng, 20) + common + words(rng, 20))) for k in range(60)]
    docs = []
    for k in range(0, 60, 6):
        copy = items[k][1].split()
        copy[3] = "changed"
        docs.append((k, " ".join(words(rng, 15) + copy + words(rng, 15))))
    docs.append((99, " ".join(words(rng, 20) + common + words(rng, 20))))
    counts = {}
    for _, text in items:
        ws = text.split()
        for g in {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}:
            counts[g] = counts.get(g, 0) + 1
    want = {(d, i): weighted(text, item, counts) for d, text in docs for i, item in items}
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {}
    for block in (4_000, 20, 2):
        monkeypatch.setattr(decontamination, "BLOCK_ITEMS", block)
        found[block] = {(r.doc_id, r.item_id): r.similarity for r in contamination(d, i).collect()}
        assert found[block] == pytest.approx(found[4_000])
    assert found[2] == pytest.approx({k: v for k, v in want.items() if v >= 0.8}, abs=1e-6)
    assert set(found[2]) == {(k, k) for k in range(0, 60, 6)}
    assert shingle_weights(i).shape == (decontamination.ROWS, 1 << decontamination.SLOT_BITS)
    assert shingle_weights(i.limit(0)).min() == 1


def test_training_rows_are_bounded_though_an_id_repeats(spark):
    docs = spark.range(3_000).select(F.lit(4).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    rows = training_rows(docs, spark.createDataFrame([(4, 1)], "doc_id long, toxic int"), train_rows=10)
    assert rows.count() == 10


def test_fresh_names():
    assert fresh(["_K1", "_k1_", "a"], "_k1", "_k2", "_K2") == ["_k1__", "_k2", "_K2_"]


NAMES = ["_k1", "_k2", "_row", "_key", "_other", "_gone", "k1", "k2", "_k1_", "cid", "line"]


def test_columns_with_working_names_keep_their_values(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    named = docs.withColumns({name: (F.col("doc_id") * 7 + k).cast("string") for k, name in enumerate(NAMES)})
    stages = dict(corpus_pipeline.STAGES)
    for step in (lambda d: one_of_each(d), dedup_lines, *(lambda d, s=stages[n]: s(spark, d, SMALL) for n in ("quality_rules", "line_dedup", "jaccard_join", "decontamination"))):
        got, plain = step(named), step(docs)
        assert all(got.where(F.col(name) != (F.col("doc_id") * 7 + k).cast("string")).isEmpty() for k, name in enumerate(NAMES))
        assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in plain.select("doc_id").collect())


def test_remembered_strings_are_short_and_few(monkeypatch):
    import public_tokenizers

    from loomwork.llm import packing
    from loomwork.llm.token_counts import load_tokenizer

    tokenizer = load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(packing, "REMEMBERED_STRINGS", 50)
    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 50)
    monkeypatch.setattr(packing, "STRETCH", 20)
    rng = random.Random(3)
    known = packing.WordIds(tokenizer)
    for text in ("一二三四五六七八九十" * 500, "x" * 3_000 + " y", " ".join(words(rng, 400)), "Word, word! WORD (word) " * 40):
        assert np.frombuffer(known.of(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(known) <= 70 and len(known.words) <= 70 and max(map(len, (*known, *known.words)), default=0) <= packing.REMEMBERED_CHARS


def test_a_hot_group_of_copies_is_one_text_of_the_sample(spark):
    from loomwork.llm.licenses import corpus_paragraphs

    rng = random.Random(7)
    texts = [" ".join(words(rng, 12)) for _ in range(300)]
    docs = spark.createDataFrame([(t,) for t in texts] + [("the same text of all copies\n\nthe same text of all copies",)] * 600, "text string").repartition(4)
    found = corpus_paragraphs(docs, sample=100)
    assert len(found) == len(set(found)) > 50
