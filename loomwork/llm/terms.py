"""Terms of texts as bytes: runs of letters (and digits) and of characters beyond ASCII, only A-Z lowered."""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash

#: Terms whose hashes a task remembers, and how long they may be.
REMEMBERED, REMEMBERED_BYTES = 300_000, 64


def _table(digits: bool) -> bytes:
    kept = lambda b: 97 <= b <= 122 or b >= 128 or (digits and 48 <= b <= 57)
    return bytes(b + 32 if 65 <= b <= 90 else b if kept(b) else 32 for b in range(256))


#: Bytes that part terms become blanks, A-Z become a-z.
LETTERS, LETTERS_AND_DIGITS = _table(False), _table(True)


def terms_of(text: bytes, table: bytes) -> list[bytes]:
    return text.translate(table).split()


class TermHashes(dict):
    """Signed 64-bit hashes of terms; None for those whose place in ``bitmap`` (2^bits places) is not set."""

    def __init__(self, bitmap: np.ndarray | None = None, bits: int = 0):
        super().__init__()
        self.bitmap, self.mask = bitmap, (1 << bits) - 1

    def __missing__(self, term: bytes) -> int | None:
        number = xxhash.xxh3_64_intdigest(term)
        place = number & self.mask
        if self.bitmap is not None and not int(self.bitmap[place >> 5]) >> (place & 31) & 1:
            found = None
        else:
            found = number - (1 << 64) if number >> 63 else number
        if len(term) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[term] = found
        return found

    def counted(self, text: bytes, table: bytes) -> tuple[int, list[int], list[int]]:
        """Terms with repeats, and the hashes and counts of those wanted."""
        words = terms_of(text, table)
        pairs = [(self[t], n) for t, n in Counter(words).items()]
        kept = [p for p in pairs if p[0] is not None]
        return len(words), [h for h, _ in kept], [n for _, n in kept]
