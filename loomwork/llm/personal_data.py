"""Personal data: stated patterns, and a semi-Markov random field that adds what they miss.

Base spans come from linear scans that find the leftmost matches of four
patterns.  Regions that may hold more (runs of figures, marks of addresses
that are spelled out) go to ``span_model``, which chooses boundaries and kinds
jointly; nothing it adds may overlap a base span.  Texts are scanned whole,
each in its own row, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.span_model import DIGITS, KINDS, decode, trained

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_RUN = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_FIGURE = re.compile("[0-9]")
_APART = str.maketrans("", "", " ().+-")
_NUMBER = re.compile(r"[0-9(+][0-9()+.\[\]{}<>/:,_ -]*")
_AT = re.compile(r"@|(?<![^\W_])at(?![^\W_])", re.I)
_DOT = re.compile(r"(?<![^\W_])dot(?![^\W_])|[\[({]\s?\.\s?[\])}]", re.I)
#: Characters around a mark of an address, and before a number, that the model reads.
BEFORE, AFTER, CONTEXT = 64, 96, 32
#: Regions that a task decodes at once.
BLOCK = 2_000


def luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else 2 * int(d) - 9 * (d > "4") for k, d in enumerate(reversed(digits))) % 10 == 0


def _small(number: str) -> bool:
    """Whether a number with leading zeros, of any length, is at most 255."""
    number = number.lstrip("0")
    return len(number) <= 3 and int(number or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of the base patterns' matches, leftmost and non-overlapping per kind, in time linear in the text."""
    found = []
    at, floor = text.find("@"), 0
    while at >= 0:
        domain, following = _DOMAIN.match(text, at + 1), at + 1
        if domain:
            start = at
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                floor = following = domain.end()
                found.append((start, 0, floor))
        at = text.find("@", following)
    if _FIGURE.search(text):
        for chain in _CHAIN.finditer(text):
            parts, start = chain[0].split("."), chain.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                stop = start + sum(map(len, four)) + 3
                if all(map(_small, four)):
                    found.append((start, 1, stop))
                start = stop + 1
        for run in _RUN.finditer(text):
            digits = run[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((run.start(), 2, run.end()))
        for phone in _PHONE.finditer(text):
            if 10 <= len(phone[0].translate(_APART)) <= 15:
                found.append((phone.start(), 3, phone.end()))
    return sorted(found)


def _widened(text: str, start: int, stop: int, before: int, after: int) -> tuple[int, int]:
    """Up to so many characters more, then to the ends of words (at most 64 characters further)."""
    start, stop = max(0, start - before), min(len(text), stop + after)
    for _ in range(64):
        if start and text[start].isalnum() and text[start - 1].isalnum():
            start -= 1
        if stop < len(text) and text[stop].isalnum() and text[stop - 1].isalnum():
            stop += 1
    return start, stop


def _joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order that cover the same places; spans that touch are one."""
    joined: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1]:
            joined[-1] = joined[-1][0], max(joined[-1][1], b)
        else:
            joined.append((a, b))
    return joined


def regions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, int, list[tuple[int, int]]]]:
    """What the model reads of a text: (piece, place, what base spans cover of it); pieces do not overlap."""
    covered, around = _joined((a, b) for a, _, b in base), []
    starts = [a for a, _ in covered]
    # The first covered stretch that ends after a place.
    after = lambda at: (k := max(0, bisect_right(starts, at) - 1)) + (k < len(covered) and covered[k][1] <= at)
    if _FIGURE.search(text):
        for run in _NUMBER.finditer(text):
            if run.end() - run.start() < DIGITS[0]:
                continue
            free, at, k = 0, run.start(), after(run.start())
            while k < len(covered) and covered[k][0] < run.end():
                free += len(_FIGURE.findall(text, at, max(at, covered[k][0])))
                at, k = covered[k][1], k + 1
            if free + len(_FIGURE.findall(text, at, run.end())) >= DIGITS[0]:
                around.append(_widened(text, run.start(), run.end(), CONTEXT, 4))
    spelled = any(word in text for word in ("dot", "DOT", "Dot", "[.", "(.", "{."))
    if spelled or "@" in text or "(at" in text or "[at" in text or "{at" in text:
        for mark in _AT.finditer(text):
            near = text[mark.end() : mark.end() + AFTER]
            wrapped = mark[0] == "@" or text[max(0, mark.start() - 1) : mark.start()] in ("(", "[", "{", "<")
            k = after(mark.start())
            if (k == len(covered) or covered[k][0] > mark.start()) and ((wrapped and "." in near) or (spelled and _DOT.search(near))):
                around.append(_widened(text, mark.start(), mark.end(), BEFORE, AFTER))
    out = []
    for a, b in _joined(around):
        k = after(a)
        stop = bisect_left(starts, b)
        out.append((text[a:b], a, covered[k:stop]))
    return out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _scan(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added, pieces, owner = [], [], [], []

            def settle():
                for row, spans in zip(owner, decode(pieces, weights)):
                    added[row] += spans
                pieces.clear(), owner.clear()

            for text in batch.column(1):
                text = text.as_py() or ""
                spans = base_spans(text)
                base.append(spans), added.append([])
                for piece in regions(text, spans):
                    pieces.append(piece), owner.append(len(base) - 1)
                if len(pieces) >= BLOCK:
                    settle()
            settle()
            counts = [pa.array([sum(k == kind for _, k, _ in spans) for spans in base], pa.int64()) for kind in range(len(KINDS))]
            digest = [hashlib.sha256(_listed(spans).encode()).hexdigest() for spans in base]
            listed = [_listed(spans + more) for spans, more in zip(base, added)]
            arrays = [batch.column(0), *counts, pa.array(digest, pa.string()), pa.array(listed, pa.string()), pa.array([len(more) for more in added], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*(["doc_id"] + [f"n_{k}" for k in KINDS]), "base_sha256", "spans", "n_added"])

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of every row of ``docs`` (doc_id, text), in code points, ends exclusive.

    Columns: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 (of the
    base spans alone), spans (all as kind:start:end by start, then kind),
    n_added (by the model).  Null and empty texts have none; equal rows have
    equal results each; a null doc_id is kept; other columns are ignored; no
    rows give none.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return slim.mapInArrow(_scan(trained()), schema)
