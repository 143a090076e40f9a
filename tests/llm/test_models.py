"""Trained operators and searches: held-out accuracy, recall against brute force, awkward rows."""

import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm.decontamination import BITS, BLOCK, RADIUS, HammingIndex, contamination, fingerprint, signs
from loomwork.llm.label_model import fit_label_model, spanning_tree
from loomwork.llm.licenses import UNKNOWN, Scanner, corpus_paragraphs, license_scan, paragraphs, train
from loomwork.llm.toxicity import chosen_features, lexicon_voters, pattern_voters, toxicity, training_rows, votes_of, weak_labels

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_toxicity_on_held_out_rows(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    rank = got.score.rank()
    bad = got.toxic == 1
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc > 0.9
    assert ((got.predicted == 1) == (got.score >= 0.3)).all()


def test_toxicity_of_awkward_rows(spark):
    rows = spark.createDataFrame([(1, None, 0.5), (None, "", 0.1), (2, "x " * 20000, 0.2)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity(rows, none).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert toxicity(rows.limit(0), none).count() == 0


def test_label_model_recovers_planted_voters():
    """Votes alone, five of them copies: the posterior is near that of the true rates, which counts the copies once."""
    rng = np.random.default_rng(0)
    n, prior = 6000, 0.2
    y = rng.random(n) < prior
    rates = np.array([[0.1, 0.05, 0.1, 0.15, 0.08], [0.6, 0.7, 0.8, 0.5, 0.65]])
    voters = np.stack([np.where(y, rng.random(n) < hit, rng.random(n) < false) for false, hit in rates.T], axis=1).astype(float)
    copies = np.abs(voters[:, [0] * 5] - (rng.random((n, 5)) < 0.02))
    votes = np.concatenate([voters, copies], axis=1)
    start = np.where(votes.sum(axis=1) >= 3, 0.6, 0.1)  # a rough guess
    model, p = fit_label_model(votes, prior, start, np.ones(10, bool))
    naive = fit_label_model(votes, prior, start, np.ones(10, bool), tree=False)[1]
    odds = (np.log(rates[1] / rates[0]) * voters + np.log((1 - rates[1]) / (1 - rates[0])) * (1 - voters)).sum(axis=1) + np.log(prior / (1 - prior))
    exact = 1 / (1 + np.exp(-odds))
    assert {k for k in (0, 5, 6, 7, 8, 9) if model.parent[k] in (0, 5, 6, 7, 8, 9)} >= {5, 6, 7, 8, 9} or (np.isin(model.parent[[0, 5, 6, 7, 8, 9]], (0, 5, 6, 7, 8, 9)).sum() == 5)
    assert np.abs(p - exact).mean() < 0.03 < np.abs(naive - exact).mean()
    assert np.mean((p > 0.5) == y) > np.mean((naive > 0.5) == y)
    free = [k for k in (1, 2, 3, 4) if model.parent[k] < 0]
    assert all(abs(model.rates[1, 0, k] - rates[1, k]) < 0.06 and abs(model.rates[0, 0, k] - rates[0, k]) < 0.03 for k in free)


def test_spanning_tree():
    weight = np.array([[0, 5, 1, 0], [5, 0, 4, 0], [1, 4, 0, 0], [0, 0, 0, 0]], float)
    assert spanning_tree(weight, 0.5).tolist() == [-1, 0, 1, -1]


def test_weak_labels_on_rows_that_chose_no_voter(spark):
    """The label model's own accuracy: voters from one half of the training rows, posterior of the other half, votes alone."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = training_rows(docs, labels).withColumn("half", F.pmod(F.xxhash64(F.to_json("features")), F.lit(2)))
    chosen, lift = chosen_features(rows.where("half = 0").drop("half"), 4096, 0)
    other = rows.where("half = 1").toPandas()
    first = rows.where("half = 0").toPandas()
    voters = lexicon_voters(first.features.tolist(), chosen, lift, 128, first.toxic.mean())
    patterns = pattern_voters(first.patterns.tolist(), first.toxic.to_numpy(), first.toxic.mean())
    votes, speaks = votes_of(other.features.tolist(), chosen[voters], other.patterns.tolist(), patterns)
    prior, toxic = other.toxic.mean(), other.toxic.to_numpy()
    _, p = weak_labels(votes, speaks, lift[voters], prior)
    order = np.argsort(np.argsort(p)) + 1
    auc = (order[toxic == 1].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (1 - toxic).sum())
    assert auc > 0.85 and np.mean((p > 0.5) == (toxic == 1)) > max(1 - prior, prior) + 0.04


def brute_matches(docs, items, threshold=0.8):
    def shingles(words):
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    out = set()
    for i, text in docs:
        words = (text or "").encode().lower().split()
        own = shingles(words)
        for j, item in items:
            want = (item or "").encode().lower().split()
            target, n = shingles(want), len(want)
            if not own & target:
                continue
            for k in range(max(1, len(words) - n + 1)):
                window = shingles(words[k : k + n])
                if len(window & target) >= threshold * len(window | target) - 1e-9:
                    out.add((i, j))
                    break
    return out


def test_contamination_against_brute_force(spark, docs):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    rows = [(r.doc_id, r.text) for r in docs.limit(300).collect()]
    words = max((t.split() for _, t in items), key=len)
    rows += [(9001, "x y z " + " ".join(words) + " q"), (9002, " ".join([*words[:20], "zzz", *words[21:]])), (9003, " ".join(words[:-2])), (9004, None), (9005, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = contamination(table, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_matches(rows, items)
    assert contamination(table, benchmark.limit(0)).count() == 0 and contamination(table.limit(0), benchmark).count() == 0


def test_hamming_index_misses_none_and_prunes():
    rng = np.random.default_rng(1)
    stored = rng.integers(0, 1 << 16, (400, BITS // BLOCK), dtype=np.uint16)
    asked = stored[:100].copy()
    for k in range(100):
        for bit in rng.choice(BITS, rng.integers(0, 90), replace=False):
            asked[k, bit // BLOCK] ^= np.uint16(1 << bit % BLOCK)
    index = HammingIndex(stored, np.arange(400) % 2)
    distance = np.bitwise_count(asked[:, None] ^ stored[None]).sum(axis=2)
    same = (np.arange(100) % 2)[:, None] == (np.arange(400) % 2)[None]
    at, found = index.search(asked, np.arange(100) % 2)
    assert set(zip(at.tolist(), found.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(same & (distance <= RADIUS)))))
    others = index.candidates(rng.integers(0, 1 << 16, (500, BITS // BLOCK), dtype=np.uint16), np.arange(500) % 2)
    assert len(others[0]) < 0.05 * 500 * 200  # of the stored fingerprints of equal label


def test_recall_of_fingerprints():
    """Of windows at similarity 0.8 and little more, the share that lies within the radius."""
    rng, near, all_ = np.random.default_rng(2), 0, 0
    for n in (20, 40, 80, 160):
        for _ in range(150):
            own = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            changed = n // 10  # of n shingles on either side: similarity (n - c) / (n + c), just above 0.8
            other = np.concatenate([own[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64)])
            a, b = (fingerprint(signs(x).sum(axis=0, keepdims=True)) for x in (own, other))
            all_ += 1
            near += int(np.bitwise_count(a ^ b).sum() <= RADIUS)
    assert near / all_ >= 0.9


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
#: Wordings that neither train nor calibrate: the text, its family, whether a template confirms it.
UNSEEN = [
    ("Distributed under GPLv3.", "gpl-3.0", True), ("Apache 2.0", "apache-2.0", True), ("Released under Apache-2.0", "apache-2.0", True),
    ("Apache License, Version 1.1", "apache-1.1", True), ("CC BY-ND 4.0", "cc-by-nd", True), ("CC BY-NC-SA 4.0", "cc-by-nc-sa", True),
    ("Eclipse Public License 2.0", "epl-2.0", True), ("Code under the MIT license", "mit", True), ("this file is covered by the Mozilla Public License 2.0", "mpl-2.0", True),
    ("Licensed under the Apache License 2.0", "apache-2.0", True), ("code is GPL version 2 or later", "gpl-2.0", True), ("CC BY 3.0", "cc-by", True), (MIT, "mit", True),
    ("the fee for his driving license was high", None, False), ("a license to thrill was granted by permission of nobody", None, False), ("the general public went to the library", None, False),
    ("Boost Software License 1.0", None, False), ("Academic Free License 3.0", None, False),
]


@pytest.fixture(scope="module")
def licences(docs):
    return train(corpus_paragraphs(docs))


def test_licenses_of_unseen_wordings(licences):
    scanner, right, wrong, confirmed = Scanner(licences, 0.6, 0.6), 0, 0, 0
    for text, family, sure in UNSEEN:
        for wrapped in (text, "\n".join(f" * {line}" for line in textwrap.wrap(text, 40))):
            got = [r for r in scanner.scan(wrapped) if r[1] != UNKNOWN]
            right += {r[1] for r in got} == ({family} if family else set())
            wrong += any(r[4] and r[1] != family for r in got)
            confirmed += sure and any(r[4] for r in got)
    assert wrong == 0  # no wrong version or variant is confirmed
    assert right >= 0.9 * 2 * len(UNSEEN) and confirmed >= 0.9 * 2 * sum(s for *_, s in UNSEEN)


def test_licenses_of_other_versions_are_not_confirmed(licences):
    for text in ("Apache License, Version 1.0", "CC BY 5.0", "GNU Lesser General Public License, version 2.0", "Eclipse Public License 1.5", "GNU General Public License, version 4"):
        assert not any(r[4] for r in Scanner(licences, 0.6, 0.6).scan(text)), text


def test_license_scan(spark, licences):
    prose = [f"words of the {k}th line go on about rivers, hills and towns in the north" for k in range(12)]
    large = "\n".join([*prose[:6], *(f" * {line}" for line in textwrap.wrap(MIT, 40)), *prose[6:]])
    rows = [(1, f"some prose before\n\n{MIT}\n\nand after"), (2, large), (3, None), (4, ""), (5, "a license to thrill"), (None, "All rights\nreserved."), (6, "x " * 300_000 + "\nReleased under the MIT License."), (7, "SPDX-License-Identifier: MIT"), (7, "SPDX-License-Identifier: MIT")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, family string, line int")
    got = [r for r in license_scan(table).collect() if r.confirmed]
    assert sorted((str(r.doc_id), r.family) for r in got) == [("1", "mit"), ("2", "mit"), ("6", "mit"), ("7", "mit"), ("7", "mit"), ("None", "proprietary")]
    at = {r.doc_id: r.line for r in got}
    assert at[1] == 2 and 4 <= at[2] <= 10 and at[6] <= 1
    # The scan is the scanner over every paragraph.
    model = train(corpus_paragraphs(table.select("doc_id", "text")))
    want = [(i, first + line, family, p) for i, text, in rows for first, part in paragraphs(text or "") for line, family, p, *_ in Scanner(model, 0.6, 0.6).scan(part) if family != UNKNOWN]
    assert sorted(want, key=repr) == sorted(((r.doc_id, r.line, r.family, r.probability) for r in license_scan(table).collect()), key=repr)
    assert license_scan(table.limit(0)).count() == 0
