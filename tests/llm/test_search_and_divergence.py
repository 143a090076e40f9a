"""Ranked search and the divergence audit against plain Python, and their pruning."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import bisection, divergence, ranked_search
from loomwork.llm.queries import QUERIES
from loomwork.operators import best_first

SMALL = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_search(docs, items, k=20):
    counts = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        terms = TERM.findall((text or "").translate(LOWER))
        scored = []
        for i, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, math.inf if i is None else i, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.fixture()
def small_cells(monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", 8)
    monkeypatch.setattr(best_first, "GROWTH", 2)


def test_query_equals_brute_force(spark, small_cells):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    got = QUERIES["op12_ranked_search"](spark, SMALL)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(docs, items)


AWKWARD = [
    (1, None), (2, ""), (None, "alpha beta"), (3, "alpha beta"), (3, "alpha beta"), (4, "ALPHA  Beta!"), (5, "beta " * 60_000), (6, "été 42 alpha é"),
    (7, "rare42 alpha"), (8, "--- ... "), *[(100 + k, f"filler{k % 7} alpha word{k}") for k in range(60)],
]
ITEMS = [(1, "Alpha beta beta"), (1, "Alpha beta beta"), (1, "rare42"), (2, None), (3, ""), (None, "été"), (4, "nowhere at all"), (5, "filler3 word5 word6")]


def test_awkward_rows(spark, small_cells, monkeypatch):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in AWKWARD], "doc_id long, text string, rank string, row int").repartition(3)
    items = spark.createDataFrame([(i, t, 5) for i, t in ITEMS], "item_id long, text string, score int")
    for block in (1_000, 1):  # one block of queries, and several
        monkeypatch.setattr(ranked_search, "QUERY_BLOCK", block)
        got = sorted(map(tuple, ranked_search.ranked_search(docs, items, k=4).collect()), key=repr)
        assert got == brute_search(AWKWARD, ITEMS, 4)
    assert ranked_search.ranked_search(docs.limit(0), items).count() == 0
    assert ranked_search.ranked_search(docs, items.limit(0)).count() == 0


def test_unseen_shards_stay_closed(spark, monkeypatch):
    """Families of documents of their own words: a query of one family opens its shards, not all."""
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", 16)
    rng = random.Random(5)
    docs = [(k, " ".join(f"f{k % 20}w{rng.randrange(30)}" for _ in range(30)) + "".join(f" pool{rng.randrange(40)}" for _ in range(8))) for k in range(1200)]
    items = [(f, " ".join(f"f{f}w{w}" for w in range(12)) + " pool1 pool2 pool3") for f in range(20)]
    opened = []
    plain = ranked_search.best_first

    def spy(bounds, by, k, evaluate, ties, **more):
        def counted(chosen):
            opened.append(chosen.count())
            return evaluate(chosen)

        opened.append(bounds.count())
        return plain(bounds, by, k, counted, ties, first=2, **more)

    monkeypatch.setattr(ranked_search, "best_first", spy)
    got = ranked_search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(docs, items, 5)
    assert opened[0] > 1000 and sum(opened[1:]) < 0.3 * opened[0]


def test_bisection_parts_families():
    rng = np.random.default_rng(3)
    family = rng.permutation(np.arange(512) % 4)
    doc = np.repeat(np.arange(512), 20)
    slot = family[doc] * 100 + rng.integers(0, 60, len(doc))
    keys = np.unique(doc * bisection.SLOTS + slot)
    doc, slot = keys // bisection.SLOTS, keys % bisection.SLOTS
    tree = bisection.fit_bisection(doc, slot, 512)
    leaves = tree.leaves(doc, slot, 512) >> (tree.depth - 2)
    mixed = sum(collections.Counter(family[leaves == q]).most_common(1)[0][1] for q in range(4) if (leaves == q).any())
    assert tree.depth == 4 and mixed > 0.95 * 512
    assert bisection.fit_bisection(doc[:0], slot[:0], 0).leaves(doc[:0], slot[:0], 3).tolist() == [0, 0, 0]


def brute_divergence(rows, least_docs, k):
    df, count = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        words = LETTERS.findall((text or "").translate(LOWER))
        df[lang or ""].update(set(words))
        count[lang or "", source or ""].update(words)
    out = []
    for lang in df:
        kept = sorted(t for t, n in df[lang].items() if n >= least_docs)
        groups = {s: c for (g, s), c in count.items() if g == lang}
        total = {t: sum(c[t] for c in groups.values()) for t in kept}
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(total)
        for s in groups:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:k]
            out += [(lang, s, part, i.decode(), -v, r + 1) for part, found in (("pair", pairs), ("term", terms)) for r, (v, i) in enumerate(found)]
    return sorted(out)


def test_divergence_equals_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "d", None]), " ".join(rng.choice("abcdefghijk") * rng.randint(1, 2 + k % 3) for _ in range(rng.randrange(12)))) for k in range(400)]
    rows += [("en", "hot", "Zeta zeta ÉTÉ 42 été_x"), ("en", "hot", None), ("de", "only", "eins zwei"), ("de", "only", "eins zwei"), ("xx", "none", ""), ("xx", "two", "once"), ("en", "a", "a " * 50_000)]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "lang string, source string, text string, item string, value int").repartition(5)
    monkeypatch.setattr(best_first, "FIRST", 1)
    monkeypatch.setattr(divergence, "FLUSH", 40)  # partial counts of many flushes
    monkeypatch.setattr(divergence, "BLOCK", 8)
    monkeypatch.setattr(divergence, "HELD", 16)
    for least, k in ((2, 3), (5, 50), (10_000, 5)):
        got = divergence.divergence(docs, least, k)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == brute_divergence(rows, least, k)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_divergence_opens_few_buckets(spark):
    """Common terms decide: buckets of rare terms are bounded below the k-th value and stay closed."""
    rows = [("en", s, " ".join(["shared"] * 50 + [f"{s}top{c}" for c in 'vwxyz'] * 40 + [f"rare{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(k, k + 200)])) for s in "abc" for k in range(40)]
    opened = []
    monkey = pytest.MonkeyPatch()
    plain = divergence.best_first

    def spy(bounds, by, k, evaluate, ties, **more):
        opened.append(bounds.count())

        def counted(chosen):
            opened.append(chosen.count())
            return evaluate(chosen)

        return plain(bounds, by, k, counted, ties, first=1, **more)

    monkey.setattr(divergence, "best_first", spy)
    got = divergence.divergence(spark.createDataFrame(rows, "lang string, source string, text string"), 2, 5).where(F.col("part") == "term").collect()
    monkey.undo()
    assert sorted(tuple(r) for r in got) == [r for r in brute_divergence(rows, 2, 5) if r[2] == "term"]
    assert sum(opened[1:]) < opened[0] / 2
