"""Personal data: base spans against the stated patterns, the field against all segmentations, held-out accuracy."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from loomwork.llm import span_model
from loomwork.llm.personal_data import base_spans, luhn, personal_data, regions
from loomwork.llm.queries import QUERIES
from loomwork.llm.span_model import KINDS, Tokens, decode, examples, likelihood, pieces, trained

SMALL = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def stated(text):
    """The base spans by the patterns as they are stated."""
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(found)


def test_luhn():
    assert luhn("4111111111111111") and luhn("378282246310005") and not luhn("4111111111111112")


def test_base_spans_are_the_patterns_matches():
    rng = random.Random(3)
    for alphabet in ("ab@.-+ 123(0_%é\n", "12.", "1 -", "+1 ().-2", "a@.b"):
        for _ in range(6_000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            assert base_spans(text) == stated(text)
    for n in range(13, 21):
        for _ in range(30):
            card = span_model._luhn_number(rng, n)
            assert base_spans(f"a {card} b") == stated(f"a {card} b")


@pytest.mark.parametrize("text", ["9" * 500_000, "a" * 500_000 + "@", "1." * 250_000, "+1 " * 100_000, "x@y." * 100_000, "a@b.c " * 50_000, "at dot " * 30_000])
def test_long_texts_take_linear_time(text):
    base = base_spans(text)
    assert sum(len(p) for p, _, _ in regions(text, base)) <= len(text)


def segmentations(i, j, n):
    """All sets of disjoint segments of tokens, as lists of places in i and j."""
    def grow(at, chosen):
        if at >= n:
            yield chosen
            return
        yield from grow(at + 1, chosen)
        for k in np.flatnonzero(i == at):
            yield from grow(j[k], [*chosen, int(k)])

    return grow(0, [])


def test_field_equals_all_segmentations():
    weights = np.random.default_rng(1).normal(0, 0.4, trained().shape)
    for text in ("call 0170 1234567 4", "a at b dot com 555-123-4567", "12.34.56.78 90 12"):
        tokens = Tokens(list(pieces([(text, 0, ())])))
        i, j = tokens.candidates()
        score = tokens.features(i, j) @ weights
        total, best, mass = 0.0, (-1.0, None), np.zeros_like(score)
        for chosen in segmentations(i, j, len(tokens.starts)):
            for kinds in itertools.product(range(len(KINDS)), repeat=len(chosen)):
                value = sum(score[k, t] for k, t in zip(chosen, kinds))
                total += np.exp(value)
                for k, t in zip(chosen, kinds):
                    mass[k, t] += np.exp(value)
                best = max(best, (value, sorted((int(tokens.starts[i[k]]), t, int(tokens.stops[j[k] - 1])) for k, t in zip(chosen, kinds))), key=lambda b: b[0])
        log, p = likelihood(tokens, i, j, score)
        assert log == pytest.approx(np.log(total)) and np.allclose(p, mass / total)
        assert decode([(text, 0, ())], weights, margin=0.0)[0] == best[1]


def test_held_out_examples():
    """Entities of other examples of the stated formats: both rates are above 0.95."""
    given = examples(1_500, seed=99)
    found = decode([(text, 0, ()) for text, _ in given], trained())
    right = wrong = lost = 0
    for (_, gold), spans in zip(given, found):
        got = {(a, b, KINDS[k]) for a, k, b in spans}
        right, wrong, lost = right + len(got & set(gold)), wrong + len(got - set(gold)), lost + len(set(gold) - got)
    assert right / (right + wrong) > 0.95 and right / (right + lost) > 0.95


@pytest.mark.parametrize(("text", "kind", "entity"), [
    ("Please ring (212) 555-0188 tomorrow", "phone", "(212) 555-0188"), ("tel: 030 2345 6789, danke", "phone", "030 2345 6789"),
    ("mail jane.roe [at] example [dot] org now", "email", "jane.roe [at] example [dot] org"), ("write to jane at example dot com please", "email", "jane at example dot com"),
    ("host 203[.]0[.]113[.]77 is down", "ip", "203[.]0[.]113[.]77"), ("card 4111.1111.1111.1111 expired", "card", "4111.1111.1111.1111"),
])
def test_spelled_out_entities(text, kind, entity):
    base = base_spans(text)
    spans = [s for found in decode(regions(text, base), trained()) for s in found]
    at = text.index(entity)
    assert base == [] and spans == [(at, KINDS.index(kind), at + len(entity))]


@pytest.mark.parametrize("text", [
    "On 2024-01-15 10:30:45 the build 1.2.3 of 12,345,678 rows ended", "ISBN 978-3-16-148410-1 and order 20240115", "look at the dot in the middle. Com is short", "1990-1995, 2001-2004 and 48.8566, 2.3522",
    "card 4111 1111 1111 1112 fails", "the sum of 12 34 56 78 and 90",
])
def test_other_figures_are_left_alone(text):
    assert base_spans(text) == [] and [s for found in decode(regions(text, []), trained()) for s in found] == []


def test_windows_of_long_regions_change_nothing(monkeypatch):
    rng = random.Random(8)
    text = "\n".join(t for t, _ in examples(60, seed=5)) + " " + " ".join(str(rng.randrange(10_000)) for _ in range(400))
    base = base_spans(text)
    whole = decode(regions(text, base), trained())
    for window in (5, 64):
        monkeypatch.setattr(span_model, "WINDOW", window)
        assert decode(regions(text, base), trained()) == whole
    assert not any(a < y and x < b for found in whole for a, _, b in found for x, _, y in base)


def test_query_keeps_every_base_span(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in QUERIES["op11_personal_data"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        base, row = stated(text or ""), got[doc_id]
        listed = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert row.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        spans = row.spans.split(",") if row.spans else []
        assert set(listed) <= set(spans) and len(spans) == len(base) + row.n_added


def test_awkward_rows(spark):
    texts = [(1, None), (2, ""), (None, "a@b.cd"), (3, "tel 030 2345 6789"), (3, "tel 030 2345 6789"), (4, "é" * 5 + " a@b.cd 1.2.3.4"), (5, "1 " * 400_000)]
    docs = spark.createDataFrame([(i, t, "x", 2) for i, t in texts], "doc_id long, text string, spans string, n_added int")
    got = personal_data(docs)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    rows = [(r.doc_id, r.spans, r.n_added) for r in got.collect()]
    assert collections.Counter(rows) == {(1, "", 0): 1, (2, "", 0): 1, (None, "email:0:6", 0): 1, (3, "phone:4:17", 1): 2, (4, "email:6:12,ip:13:20", 0): 1, (5, "", 0): 1}
    assert personal_data(docs.limit(0)).count() == 0
