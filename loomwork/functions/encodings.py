"""Which encoding a file's bytes are in, by the likelihood of its first bytes under each.

For every encoding the bytes are cut into its characters and each class of
characters has a probability per character; the encoding of the greatest sum
of logarithms is taken.  Classes follow the layout of the public code tables,
which keep frequent characters apart from rare ones.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that are looked at.
HEAD = 10_000
#: Log-probability of a byte that is no part of a character.
WRONG = -25.0

_ASCII = (rb"[\t\n\r\x20-\x7e]", -4.2)
_CONTROL = (rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", -14.0)

#: A pair alone between other bytes, or beside a letter, as letters with accents look.
_MIXED = (rb"(?<=[a-z])[\x81-\xfe][\x80-\xfe]|(?<![\x80-\xff])[\x81-\xfe](?:[\x40-\x7e](?![\x80-\xff])|[\x80-\xfe](?![\x80-\xff]))|[\x81-\xfe][\x40-\x7e\x80-\xfe](?=[A-Za-z])", -19.0)

#: Fixed values, the layout of the code tables: classes of characters as bytes, each with a log-probability per character.
LAYOUT: dict[str, list[tuple[bytes, float]]] = {
    "utf-8": [_ASCII, (rb"[\xc2-\xdf][\x80-\xbf]", -7.5), (rb"[\xe3-\xe9][\x80-\xbf]{2}", -8.5), (rb"[\xe0-\xef][\x80-\xbf]{2}", -10.0), (rb"[\xf0-\xf4][\x80-\xbf]{3}", -12.0), _CONTROL],
    "cp950": [_ASCII, _MIXED, (rb"[\xa4-\xc6][\x40-\x7e\xa1-\xfe]", -8.7), (rb"[\xa1-\xa3][\x40-\x7e\xa1-\xfe]", -8.5), (rb"[\xc9-\xf9][\x40-\x7e\xa1-\xfe]", -12.5), _CONTROL],
    "gbk": [_ASCII, _MIXED, (rb"[\xb0-\xd7][\xa1-\xfe]", -8.3), (rb"[\xa1\xa3][\xa1-\xfe]", -7.5), (rb"[\xa2\xa4-\xa9][\xa1-\xfe]", -11.0), (rb"[\xd8-\xf7][\xa1-\xfe]", -12.0), (rb"[\x81-\xfe][\x40-\x7e\x80-\xfe]", -15.0), _CONTROL],
    "shift_jis": [_ASCII, _MIXED, (rb"\x82[\x9f-\xf1]", -5.2), (rb"\x83[\x40-\x96]", -6.2), (rb"\x81[\x40-\x7e\x80-\xfc]", -6.5), (rb"[\x88-\x97][\x40-\x7e\x80-\xfc]", -9.0), (rb"[\x82\x84\x98-\x9f\xe0-\xea][\x40-\x7e\x80-\xfc]", -12.5), (rb"(?<![\x80-\xff])[\xa1-\xdf](?![\x80-\xff])", -15.0), (rb"[\xa1-\xdf]", -9.0), _CONTROL],
    "latin-1": [_ASCII, (rb"[\xc0-\xd6\xd8-\xf6\xf8-\xff](?![\xa1-\xff])", -7.0), (rb"[\xc0-\xd6\xd8-\xf6\xf8-\xff]", -6.5), (rb"[\xa0-\xbf\xd7\xf7]", -9.5), (rb"[\x80-\x9f]", -15.0), _CONTROL],
    "utf-16-le": [(rb"[\t\n\r\x20-\x7e]\x00", -4.3), (rb"[\xa0-\xff]\x00", -7.6), (rb"[\x00-\xff][\x4e-\x9f]", -10.5), (rb"[\x00-\xff][\x30\xff]", -8.0), (rb"[\x00-\xff]{2}", -19.0)],
    "utf-16-be": [(rb"\x00[\t\n\r\x20-\x7e]", -4.3), (rb"\x00[\xa0-\xff]", -7.6), (rb"[\x4e-\x9f][\x00-\xff]", -10.5), (rb"[\x30\xff][\x00-\xff]", -8.0), (rb"[\x00-\xff]{2}", -19.0)],
}
#: Encodings of two bytes a character; in the others a zero byte is a control character and no byte costs less than LIGHTEST.
WIDE, LIGHTEST, ZERO = ("utf-16-le", "utf-16-be"), -2.6, -14.0
#: Marks that say the encoding outright.
MARKS = {b"\xef\xbb\xbf": "utf-8", b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}

#: The first class is read in runs; the others one character at a time, as an earlier class may take the next one.
_READERS = {name: re.compile(b"|".join(b"((?:" + pattern + (b")+)" if k == 0 else b"))") for k, (pattern, _) in enumerate(classes)) + rb"|(.)", re.S) for name, classes in LAYOUT.items()}
_WEIGHTS = {name: [w for _, w in classes] + [WRONG] for name, classes in LAYOUT.items()}


def likelihood(data: bytes, name: str) -> float:
    """The log-probability of bytes under an encoding; a character cut off at the end costs nothing."""
    counts, width = Counter(), 2 if name in WIDE else 1
    for m in _READERS[name].finditer(data):
        counts[m.lastindex] += (m.end() - m.start()) // width if m.lastindex == 1 else 1
    total = sum(_WEIGHTS[name][group - 1] * n for group, n in counts.items())
    cut = next((k for k in (1, 2, 3) if _is_cut(data[-k:], name)), 0)
    return total - WRONG * cut


def _is_cut(tail: bytes, name: str) -> bool:
    """Whether these last bytes begin a character that needs more."""
    if not tail or tail[0] < 0x80:
        return False
    if name == "utf-8":
        need = 2 if 0xC2 <= tail[0] <= 0xDF else 3 if 0xE0 <= tail[0] <= 0xEF else 4 if 0xF0 <= tail[0] <= 0xF4 else 0
        return len(tail) < need and all(0x80 <= b <= 0xBF for b in tail[1:])
    return False


def detect(data: bytes) -> str:
    """The likeliest encoding of the first HEAD bytes; utf-8 for none and for plain ASCII."""
    for mark, name in MARKS.items():
        if data.startswith(mark):
            return name
    head = data[:HEAD]
    if head.isascii() and 0 not in head:
        return "utf-8"
    zeros = head.count(0)
    found = {name: likelihood(head, name) for name in WIDE} if zeros else {}
    if not found or max(found.values()) <= ZERO * zeros + LIGHTEST * (len(head) - zeros) - 3 * WRONG:
        found = {name: likelihood(head, name) for name in LAYOUT}
    return max((name for name in LAYOUT if name in found), key=found.get)


def encoding(content: Column) -> Column:
    """The name of a binary column's encoding; null for null."""

    @F.pandas_udf("string")
    def found(contents: pd.Series) -> pd.Series:
        return contents.map(lambda data: None if data is None else detect(bytes(data)))

    return found(content)


def text_of(content: Column) -> Column:
    """A binary column as text by its encoding, marks left out; bytes that are none of its characters become U+FFFD."""

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        return contents.map(lambda data: None if data is None else bytes(data).decode(detect(bytes(data)), "replace").removeprefix("﻿"))

    return read(content)
