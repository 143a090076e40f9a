"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Training rows are labelled rows outside the held-out fold; at most
   ``train_rows`` of them, of the least hashes.  Their words and word stems
   become hashed 0/1 features.
2. Voters are lexicon entries (words and stems, picked by how often the
   training labels call their rows toxic), counts of entries of a kind, and
   patterns of shouting, censoring and disguise.  The label model is fitted to
   their votes alone: it learns how often each votes on either class and which
   of them depend on one another.  The training labels only say what share is
   toxic and which of the two classes is.
3. A logistic regression on words and stems, for and against, learns the
   posterior labels and then scores every whole text; only its weights travel.
   Its scale is fitted to the labels of the training rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.label_model import LabelModel, calibrate, fit_label_model, fit_logistic
from loomwork.plans.storage import materialize

TRAIN_ROWS = 20_000
BUCKETS = 1 << 22
STEMS = (4, 5, 6)
#: Decimal digits by which chance must fail to explain a lexicon voter's share of toxic rows (Chernoff's bound).
SURPRISE = 3.5
#: Words whose features a worker remembers.
REMEMBERED = 300_000
#: Log-odds of every text when there is nothing to learn from.
EMPTY_BIAS = -3.0
_WORD = re.compile(r"[^\W\d_]+")
#: Patterns that vote: shouting, insistence, stretched, disguised and censored words.
PATTERNS = [re.compile(p) for p in (r"(?:\b[A-ZÀ-Þ]{3,}\b\W+){3}", r"[!?]{2,}|(?:![^!]{0,80}){3}", r"([^\W\d_])\1\1", r"[^\W\d_][0-9@$][^\W\d_]", r"[^\W\d_]\*+[^\W\d_]?")]


def features_of(word: str) -> list[int]:
    """Hashed features of a lower-case word: the word, and its leading letters of each stem length."""
    names = [f"={word}", *(word[:n] for n in STEMS if len(word) >= n)]
    return [xxhash.xxh32_intdigest(name) % BUCKETS * 4 + k for k, name in enumerate(names)]


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(4)) == 2, F.lit(False))


class _Remembering(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = self.make(word)
        return value


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Remembering(features_of)
    for batch in batches:
        texts = [t.as_py() or "" for t in batch.column("text")]
        found = [sorted({f for w in set(_WORD.findall(t.lower())) for f in known[w]}) for t in texts]
        patterns = [[k for k, p in enumerate(PATTERNS) if p.search(t)] for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32())), pa.array(patterns, pa.list_(pa.int32()))], ["toxic", "features", "patterns"])


@dataclass
class ToxicityModel:
    weights: dict[int, float]  # feature -> weight
    bias: float
    voters: list[int]  # features that are lexicon voters
    accuracies: np.ndarray  # of lexicon voters, counts and patterns


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """toxic, features of at most ``train_rows`` rows of labelled documents outside the held-out fold.

    Of the rows of the chosen ids, those of the least hashes of id and text,
    as an id may repeat.
    """
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = int(min(1.0, train_rows / max(1, own.count())) * 1_000_000)
    order = F.xxhash64(F.lit("train"), "doc_id")
    own = own.where(F.pmod(order, F.lit(1_000_000)) <= share * 11 // 10).orderBy(order, "doc_id").limit(train_rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(own), "doc_id")  # at most train_rows ids
    joined = joined.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(train_rows).select("toxic", "text")
    return materialize(joined.mapInArrow(_hashed, "toxic int, features array<int>, patterns array<int>"), "toxicity")


def chosen_features(rows: DataFrame, most: int, against: int) -> tuple[np.ndarray, np.ndarray]:
    """Features that speak for toxicity, best first, then those that speak against it; and their share of toxic rows."""
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    base = (total["bad"] or 0) / max(1, total["n"])
    counts = rows.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    lift = (F.col("bad") + 1) / (F.col("n") + 2)
    best = counts.where((F.col("bad") >= 2) & (lift >= 0.5)).select("f", lift.alias("lift"), (F.log("bad") * lift).alias("s")).orderBy(F.desc("s"), "f").limit(most).toArrow()
    missing = (base * F.col("n") - F.col("bad")) / F.sqrt(base * (1 - base) * F.col("n") + 1e-9)
    clean = counts.where(missing >= 4).select("f", lift.alias("lift"), missing.alias("s")).orderBy(F.desc("s"), "f").limit(against).toArrow()
    return tuple(np.concatenate([best[c].to_numpy(), clean[c].to_numpy()]) for c in ("f", "lift"))


def lexicon_voters(features: list, chosen: np.ndarray, lift: np.ndarray, voters: int, base: float) -> list[int]:
    """Places in ``chosen`` of the lexicon voters: entries no chance explains, one of those that share most of their rows.

    Of a word and its stems one votes, so that the voters cover as many
    families of words as there are.  Where chance explains them all, the best
    few are taken.
    """
    strong = int((lift >= 0.5).sum())
    column = {int(f): k for k, f in enumerate(chosen[:strong])}
    rows: list[set[int]] = [set() for _ in range(strong)]
    for row, own in enumerate(features):
        for f in own:
            if int(f) in column:
                rows[column[int(f)]].add(row)
    taken: list[int] = []
    by_row: dict[int, list[int]] = {}
    bad = np.array([(len(r) + 2) * lift[k] - 1 for k, r in enumerate(rows)])
    evidence = surprise(bad, np.array([len(r) for r in rows]), base)
    for k in [k for k in range(strong) if evidence[k] >= SURPRISE] or list(range(min(strong, 8))):
        shared: dict[int, int] = {}
        for row in rows[k]:
            for t in by_row.get(row, ()):
                shared[t] = shared.get(t, 0) + 1
        if len(taken) < voters and all(n <= 0.8 * min(len(rows[k]), len(rows[t])) for t, n in shared.items()):
            taken.append(k)
            for row in rows[k]:
                by_row.setdefault(row, []).append(k)
    return taken


def surprise(bad: np.ndarray, n: np.ndarray, base: float) -> np.ndarray:
    """Decimal digits of the chance (Chernoff's bound) that ``bad`` of ``n`` rows are toxic at a share of ``base``."""
    share = np.clip(bad / np.maximum(1, n), 1e-9, 1 - 1e-9)
    return n * (share * np.log10(share / base) + (1 - share) * np.log10((1 - share) / (1 - base)))


def votes_of(features: list, lexicon: np.ndarray, patterns: list, chosen_patterns: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """0/1 votes per row, and whether a voter's 0 says anything: of lexicon entries, then of patterns.

    A text without an entry or a pattern says nothing, so all abstain at 0.
    """
    column, turn = {int(f): k for k, f in enumerate(lexicon)}, {k: i for i, k in enumerate(chosen_patterns)}
    votes = np.zeros((len(features), len(lexicon) + len(turn)))
    for row, (own, seen) in enumerate(zip(features, patterns)):
        votes[row, [column[int(f)] for f in own if int(f) in column] + [len(lexicon) + turn[k] for k in seen if k in turn]] = 1
    return votes, np.zeros(votes.shape[1], bool)


def pattern_voters(patterns: list, toxic: np.ndarray, base: float) -> list[int]:
    """The patterns whose share of toxic rows, high or low, no chance explains."""
    seen = np.array([[k in own for k in range(len(PATTERNS))] for own in patterns], float).reshape(-1, len(PATTERNS))
    return np.flatnonzero(surprise(toxic @ seen, seen.sum(axis=0), base) >= SURPRISE).tolist()


def weak_labels(votes: np.ndarray, speaks: np.ndarray, lift: np.ndarray, prior: float, labels: np.ndarray | None = None) -> tuple[LabelModel, np.ndarray]:
    """The label model of these votes, started from the lexicon's shares of toxic rows, and P(toxic) per row."""
    evidence = np.log(lift) - np.log1p(-lift) - np.log(prior) + np.log1p(-prior)
    start = votes[:, : len(lift)] @ np.clip(evidence, -4, 4) + np.log(prior) - np.log1p(-prior)
    return fit_label_model(votes, prior, 1 / (1 + np.exp(-np.clip(start, -6, 6))), speaks, labels=labels)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, voters: int = 128, features: int = 4096, against: int = 512) -> ToxicityModel:
    """Learn voters, label model and classifier from the training rows."""
    rows = training_rows(docs, labels, train_rows)
    chosen, lift = chosen_features(rows, features, against)
    kept = F.array_intersect("features", F.array(*[F.lit(int(f)) for f in chosen]).cast("array<int>"))
    table = rows.select("toxic", kept.alias("features"), "patterns").toArrow()  # train_rows at most
    toxic, own = table["toxic"].to_numpy().astype(float), table["features"].to_pylist()
    if not len(toxic) or not (lift >= 0.5).any():
        return ToxicityModel({}, EMPTY_BIAS, [], np.zeros(0))
    prior = float(np.clip(toxic.mean(), 1e-3, 1 - 1e-3))
    lexicon = lexicon_voters(own, chosen, lift, voters, prior)
    patterns = table["patterns"].to_pylist()
    votes, speaks = votes_of(own, chosen[lexicon], patterns, pattern_voters(patterns, toxic, prior))
    model, posterior = weak_labels(votes, speaks, lift[lexicon], prior, toxic)
    column = {int(f): k for k, f in enumerate(chosen)}
    hits = [[column[f] for f in x] for x in own]
    at = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    which = np.array([c for h in hits for c in h], dtype=np.int64)
    weights, bias = fit_logistic(at, which, posterior, len(chosen))
    scale, shift = calibrate(np.bincount(at, weights[which], len(hits)) + bias, toxic)
    return ToxicityModel({int(f): scale * float(w) for f, w in zip(chosen, weights)}, scale * bias + shift, [int(f) for f in chosen[lexicon]], model.accuracies(votes, posterior))


def _score(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        weights = model.weights
        usable = _Remembering(lambda w: tuple(f for f in features_of(w) if f in weights))
        for batch in batches:
            scores = []
            for text in batch.column("text"):
                found = {f for w in set(_WORD.findall((text.as_py() or "").lower())) for f in usable[w]}
                odds = model.bias + sum(weights[f] for f in sorted(found))
                scores.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Null and empty texts get the score of a text without any known feature;
    equal rows are scored one by one; a null doc_id is not held out; other
    columns are ignored.  Without training rows every score is that of
    EMPTY_BIAS; without documents there are no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_rows))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = slim.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
