"""Hashed five-word shingles of texts, in numpy, for use inside tasks.

Words are maximal runs of bytes other than space, tab, newline, vertical tab,
form feed and return, with A-Z lower-cased.  A shingle is a 64-bit hash of
five consecutive words; a text with fewer words is one shingle of all of them,
a text without words has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: Bytes that are hashed with one table of powers; a longer word has a part of its own.
SEGMENT = 1 << 20
_FACTORS = [np.uint64(xxhash.xxh3_64_intdigest(b"factor %d" % k) | 1) for k in range(WORDS)]
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # splitmix64's published multipliers
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_POWERS: dict[str, np.ndarray] = {}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2^64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            step = np.full(max(n, 1 << 16), np.uint64(base))
            step[0] = 1
            _POWERS[name] = np.cumprod(step, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word, in text order, from prefix sums over the bytes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_BLANK[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        last = max(k + 1, int(np.searchsorted(stops, starts[k] + SEGMENT, "right")))
        first, end = int(starts[k]), int(stops[last - 1])
        up, down = powers(end - first + 1)
        sums = np.zeros(end - first + 1, np.uint64)
        np.cumsum((_LOWER[data[first:end]].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        a, b = starts[k:last] - first, stops[k:last] - first
        out[k:last] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        k = last
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose high and low bits all depend on every bit."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """The hash of the shingle at each word, in text order, repeats included."""
    n = len(words)
    if n == 0:
        return words
    size = min(n, size)
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total += words[k : n - size + 1 + k] * _FACTORS[k]
    # A short text's shingle is not the start of a longer one's.
    return mix(total + np.uint64(size))
