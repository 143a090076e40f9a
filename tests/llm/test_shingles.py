"""Word and shingle hashes against words and shingles themselves."""

import random

import numpy as np

from loomwork.llm import shingles


def words_of(text):
    return text.encode("utf-8", "surrogatepass").lower().split()


def test_word_hashes(monkeypatch):
    rng = random.Random(2)
    letters = ["a", "B", "é", "É", "中", " ", "\t", "\n", "\x0b", "\x1c", " ", "z", "Z"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["", " ", "x" * 3000 + " y"]
    for segment in (1 << 20, 7):
        monkeypatch.setattr(shingles, "SEGMENT", segment)
        known, seen = {}, {}
        for text in texts:
            words, hashes = words_of(text), shingles.word_hashes(text).tolist()
            assert len(words) == len(hashes)
            for w, h in zip(words, hashes):
                assert known.setdefault(w, h) == h and seen.setdefault(h, w) == w


def test_shingles_tell_sizes_apart():
    sets = {}
    for text in ("a b c d e", "a b c d", "a b c d e f", "b c d e f", "a", "A"):
        own = shingles.shingle_hashes(shingles.word_hashes(text))
        assert len(own) == max(1, len(text.split()) - 4)
        sets[text] = set(own.tolist())
    assert sets["a b c d e"] < sets["a b c d e f"] and sets["b c d e f"] < sets["a b c d e f"]
    assert sets["a"] == sets["A"] and not sets["a b c d"] & sets["a b c d e"]


def test_distinct():
    values = np.array([3, 1, 3, 2, 1], np.uint64)
    assert shingles.distinct(values).tolist() == [1, 2, 3] and len(shingles.distinct(values[:0])) == 0
