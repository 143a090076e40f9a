"""Exact operators against brute force on small fixtures, with the awkward rows of each contract."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwork.llm import jaccard_join, queries, repeats
from loomwork.llm.jaccard_join import jaccard_components, one_of_each, shared_needed
from loomwork.llm.line_dedup import dedup_lines
from loomwork.llm.packing import pack
from loomwork.llm.packing_plan import make_plan
from loomwork.llm.quality_rules import quality_rules
from loomwork.llm.repeats import remove_repeats
from loomwork.llm.secrets import secret_spans
from loomwork.llm.token_counts import pretokens, token_counts, _special_pattern

SMALL = "/root/testdata/sf0.001"
BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
AWKWARD = [
    (1, None), (2, ""), (3, "a<|endoftext|>b  c\n\n d's ²³ \x1c x\x85y"), (None, "日本語 ①२ ñ́ "),
    (5, "  "), (5, "  "), (6, "word " * 5000), (7, "The The the, THE. Été; naïve"),
]
SCHEMA = "doc_id long, text string, n_tokens int, n_lines string, kept string, piece string"


def table(spark, rows):
    """Rows with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, 1, "x", "y", "z") for i, t in rows], SCHEMA)


def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")


@pytest.mark.parametrize("rows", ["awkward", "real"])
def test_token_counts(spark, rows):
    docs = table(spark, AWKWARD) if rows == "awkward" else small(spark)
    tok = Tokenizer.from_file(BYTES)
    want = collections.Counter((r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False))) for r in docs.collect())
    for head in (400_000, 5):  # almost all by broadcast, almost all by the join
        got = token_counts(docs, BYTES, 512, head).collect()
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts(docs.limit(0), BYTES).count() == 0


def test_pretokens_match_the_tokenizer():
    tok = Tokenizer.from_file(BYTES)
    rng, pattern = random.Random(1), _special_pattern(tok)
    letters = [chr(i) for i in range(0x2B0)] + ["'s", " ", "\n", "<|endoftext|>", "–", "€", " ", "é", "中"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 12)))
        found, specials = pretokens(text, tok, pattern)
        assert sum(len(tok.encode(p, add_special_tokens=False)) for p in found) + specials == len(tok.encode(text, add_special_tokens=False)), text


@pytest.mark.parametrize("rows", ["awkward", "real"])
def test_packing_round_trip(spark, rows):
    docs = table(spark, AWKWARD) if rows == "awkward" else small(spark)
    tok, want = Tokenizer.from_file(WORDS), collections.Counter()
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[r.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = pack(docs, WORDS).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    ends = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096
    assert len(ends) <= 1.01 * sum(ends.values()) / 4096 + 1
    assert pack(docs.limit(0), WORDS).count() == 0


def test_plan_places_every_document_once():
    rng = np.random.default_rng(2)
    for trial in range(6):
        counts = np.zeros(257, np.int64)
        np.add.at(counts, rng.integers(1, 257, 40), rng.integers(1, 400, 40))
        plan = make_plan(counts, 256)
        length = np.repeat(np.arange(257), counts)
        rank = np.concatenate([np.arange(n) for n in counts])
        sequence, offset = plan.place(length, rank)
        order = np.lexsort((offset, sequence))
        sequence, offset, length = sequence[order], offset[order], length[order]
        new = np.r_[True, sequence[1:] != sequence[:-1]]
        assert (offset[new] == 0).all()
        assert (offset[1:][~new[1:]] == (offset + length)[:-1][~new[1:]]).all()
        assert (offset + length).max() <= 256 and len(np.unique(sequence)) == plan.sequences
        assert plan.sequences >= -(-int(length.sum()) // 256)


def brute_components(rows):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[root(k)] = min(names.get(root(k), i), i)
    return collections.Counter((i, len(sets[k]), names.get(root(k), i)) for k, (i, _) in enumerate(rows))


def family(rng):
    """Near copies around the threshold, a passage in unrelated texts, and short and empty texts."""
    vocabulary = [f"w{i}" for i in range(400)]
    base, passage = [rng.choice(vocabulary) for _ in range(120)], [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for k in range(160):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6])):
            words[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((k, " ".join(words)))
    for k in range(160, 260):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([10, 30, 60]))]
        at = rng.randrange(len(words))
        rows.append((k, " ".join(words[:at] + passage + words[at:])))
    return [*rows, (600, None), (601, ""), (602, "a b"), (603, "A b"), (604, "a b c"), (605, " \t\n"), (None, "q r s t"), (None, "a b"), (606, "a b"), (606, "a b")]


def test_jaccard_join_keeps_every_link(spark):
    rows = family(random.Random(5))
    got = jaccard_components(table(spark, rows).repartition(6)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert jaccard_components(table(spark, rows).limit(0)).count() == 0


def test_matrix_finds_links_that_leaders_miss(spark, monkeypatch):
    found = []
    links = jaccard_join.group_links
    monkeypatch.setattr(jaccard_join, "group_links", lambda *a: found.append(links(*a).collect()) or links(*a))
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, words = [], [rng.choice(vocabulary) for _ in range(160)]
    for k in range(40):  # a chain: neighbours are alike, its ends are not
        rows.append((k, " ".join(words)))
        for at in (4 * k + 1, 4 * k + 3):
            words[at % 160] = rng.choice(vocabulary)
    got = jaccard_components(table(spark, rows).repartition(3)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert len({r.component_id for r in got}) < 40 and sum(map(len, found)) > 0


def test_least_shared_is_a_bound(spark):
    rows = [(n, low, high) for n in (1, 5, 17, 40, 99) for low in (1, 13, 38, 80) for high in (13, 40, 120) if low <= high]
    got = spark.createDataFrame(rows, "n long, low long, high long").withColumn("least", jaccard_join.least_shared(F.col("n"), F.col("low"), F.col("high"), 80)).collect()
    for r in got:
        every = [shared_needed(r.n, m, 80) for m in range(r.low, r.high + 1) if 100 * min(r.n, m) >= 80 * max(r.n, m)]
        assert (r.least is None) == (not every) and (not every or r.least <= max(1, min(every)))


def test_one_of_each(spark):
    rows = [(3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (4, ""), (5, None), (6, "z y x w v u")]
    got = one_of_each(table(spark, rows))
    assert got.columns == ["doc_id", "text", "n_tokens", "n_lines", "kept", "piece"]
    assert sorted(r.doc_id for r in got.collect()) == [2, 4, 5, 6]


def brute_repeats(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = collections.Counter(d[k : k + length] for _, d in texts for k in range(len(d) - length + 1))
    out = collections.Counter()
    for i, d in texts:
        covered = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if counts[d[k : k + length]] > 1:
                covered[k : k + length] = True
        spans = int((np.diff(np.r_[False, covered].astype(int)) == 1).sum())
        out[i, len(d), int(covered.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~covered].tobytes()).hexdigest()] += 1
    return out


def test_repeats(spark):
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(150, 450))) for _ in range(6)]
    rows = []
    for k in range(80):
        text = ""
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            text += p[a : a + rng.randint(100, 400)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 150)))
        rows.append((k, text))
    rows += [(300, None), (301, ""), (302, "a" * 700), (303, "ab" * 300), (304, "The " * 200), (305, "q" * 199), (306, "q" * 200), (307, "é" * 101), (None, "é" * 101)]
    got = remove_repeats(table(spark, rows).repartition(5)).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows)
    assert remove_repeats(table(spark, rows).limit(0)).count() == 0


def test_repeats_of_a_hot_phrase(spark, monkeypatch):
    rng = random.Random(13)
    own = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    phrase, shared = own(150), [own(90) for _ in range(3)]
    rows = [(k, own(rng.randint(100, 300)) + phrase + own(rng.randint(100, 300))) for k in range(60)]
    rows += [(100 + k, own(120) + shared[k % 3] + phrase + shared[(k + 1) % 3] + own(120)) for k in range(5)]
    rows += [rows[0], (200, rows[1][1])]
    monkeypatch.setattr(repeats, "BUCKET", 50)  # a splitter falls between equal suffixes
    got = remove_repeats(table(spark, rows).repartition(5)).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows)


def test_multikey_order():
    rng = np.random.default_rng(3)
    for n, width, values in ((0, 2, 3), (1, 3, 2), (500, 4, 3), (300, 1, 9), (400, 3, 1)):
        words = rng.integers(0, values, (n, width)).astype(np.uint64)
        order, equal = repeats.multikey_order(words)
        got = [tuple(words[k]) for k in order]
        assert sorted(order) == list(range(n)) and got == sorted(got)
        assert equal.tolist() == [k > 0 and got[k] == got[k - 1] for k in range(n)]


def test_repeats_across_segments(spark, monkeypatch):
    rng = random.Random(4)
    shared = "".join(rng.choice("abcdefgh") for _ in range(900))
    data = ["".join(rng.choice("abcdefgh") for _ in range(700)) + shared, shared + "tail", shared[100:600]]
    whole = [list(zip(*(c.tolist() for c in part))) for d in data for part in repeats.anchors(d.encode(), 200)]
    monkeypatch.setattr(repeats, "SEGMENT", 300)
    cut = [list(zip(*(c.tolist() for c in part))) for d in data for part in repeats.anchors(d.encode(), 200)]

    def windows(parts):
        return sorted((g, at - back) for part in parts for g, _, at, near, far in part for back in range(near, far + 1))

    assert windows(whole) == windows(cut)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [x for _, _, x in sorted(found)]


def test_secrets(spark):
    rng = random.Random(6)
    pool = ["password", "Token", "api_key", "APIKEY", "secret", ":", "=", "  ", '"', "'", "abcdefgh1", "é", "日", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "xyz", "\n", "https://a.b/c", "user_name", "aB3" * 8, "\U0001f600"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))) for i in range(800)] + [(5000, None), (5001, ""), (None, "AKIA" + "A" * 12)]
    texts = {i: t or "" for i, t in rows}
    got = secret_spans(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute_secrets(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(r.spans.split(","))
    assert secret_spans(table(spark, rows).limit(0)).count() == 0


def test_weak_parts_need_complements(spark):
    weak, far = "aB3" * 8, " x" * 400
    rows = [(1, weak), (2, f"login: bob99 and {weak}"), (3, f"login: bob99 {far} {weak}"), (4, f"ftp://host/x {weak} login=bobby"), (5, "ftp://host/x login=bobby")]
    rows += [(6, "see https://example.com/Docs/Page2/IntroductionGuide"), (7, "https://a.b/?login=bobby and " + weak), (8, f"client_id={weak}"), (9, f"{weak} " * 3000 + "login=bobby")]
    rows += [(10, f"login: bob99 and {weak}")] * 3
    got = {r.doc_id: r for r in secret_spans(table(spark, rows)).collect()}
    # A part is no complement of what it overlaps.
    assert [got[k].n_linked for k in range(1, 11)] == [0, 2, 0, 3, 0, 0, 1, 0, 17, 2]


def test_line_templates(spark):
    rows = [(k, f"User x{k} logged in from host alpha at night\nname bob{'qwertyuio'[k]} went far away today\nown{'abcdefghijkl'[k]} thing is here alone{k}") for k in range(9)]
    rows += [(20, None), (21, ""), (None, "a b c\n\nq")]
    got = {r.doc_id: r for r in dedup_lines(table(spark, rows), min_docs=5).collect()}
    assert got[0].n_dropped == 0 and got[0].text == rows[0][1]  # the first keeps its copy
    assert all("logged in" not in got[k].text for k in range(1, 9))
    assert got[20].text is None and got[20].n_lines == 0 and got[21].text == "" and got[None].text == "a b c\n\nq"
    assert dedup_lines(table(spark, rows).limit(0)).count() == 0


def test_quality_rules(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "a"), (3, " \n\n ", "a"), (None, "x " * 30, "b"), (5, "a b c d e a b c d e f", "b"), (6, "one two three four five six seven eight nine ten eleven", "c")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert (got[5].n_words, got[5].n_repeat_words, got[5].base_failed) == (11, 10, True)
    assert (got[None].n_words, got[None].n_repeat_words) == (30, 30)
    assert got[1].n_words == 0 and not got[1].kept and got[6].kept
    assert quality_rules(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, oracle, same, name):
    same(queries.QUERIES[name](spark, SMALL), oracle(queries.ORACLES[name]))
