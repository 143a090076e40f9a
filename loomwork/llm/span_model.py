"""A semi-Markov conditional random field over candidate spans of personal data.

A region of a text is a row of tokens.  A segment of up to MAX_TOKENS tokens
may be an entity of one of KINDS; its score is the sum of the weights of
features of the whole segment (digits, groups, separators, checksum, marks,
cues before it, what it touches).  Tokens outside entities score nothing.
Segments that break the limits of ``Region`` candidates have no weight at
all, so decoding regions alone is decoding the text.

The weights maximise the likelihood of labelled examples that ``examples``
writes from stated formats; forward and backward sums run over all segments.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 32
#: Tokens of a region that are scored at once.
WINDOW = 8_192
DIGITS = (7, 20)
#: Log-odds that an entity must have above none.
MARGIN = 1.0

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
#: Words before a number that say what it is, in the corpora's languages.
CUES = {
    "mail": "email mail contact correo courriel kontakt",
    "ip": "ip host server node",
    "card": "card visa mastercard amex karte tarjeta carte",
    "phone": "tel phone call mobile cell fax telefon telefono teléfono téléphone handy whatsapp",
    "other": "order invoice isbn version id no nr ref date item serial page total sum",
}
_CUE = {word: k for k, words in enumerate(CUES.values(), 1) for word in words.split()}
#: Usual last labels of host names.
_ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")
#: Letter tokens across which a cue still counts.
CUE_REACH = 3
_MARKS = "+().-/:,[]{}<>"


@dataclass
class Piece:
    """A stretch of a region's tokens: (word, start, stop) each, the place of the first token that is its own, how many
    are, disjoint spans in order that no entity may touch, and the last cue before it with the words since."""

    region: int
    words: list[tuple[str, int, int]]
    own: int
    size: int
    blocked: Sequence[tuple[int, int]]
    cue: tuple[int, int] = (0, 99)


def pieces(regions: Sequence[tuple[str, int, Sequence[tuple[int, int]]]]) -> Iterator[Piece]:
    """Regions (text, place of its first character, blocked spans) in stretches of WINDOW tokens.

    A stretch also has the tokens around it that its segments may reach or
    touch, so a long region's segments are those of the whole.
    """
    for r, (text, shift, blocked) in enumerate(regions):
        tokens, cue, done = _TOKEN.finditer(text), (0, 99), False
        held: list[tuple[str, int, int]] = []
        own = 0
        while not done:
            for m in tokens:
                held.append((m[0], m.start() + shift, m.end() + shift))
                if len(held) == own + WINDOW + MAX_TOKENS + 2:
                    break
            else:
                done = True
            size = len(held) - own if done else WINDOW
            first, last = bisect_right(blocked, held[0][1], key=lambda x: x[1]), bisect_left(blocked, held[-1][2], key=lambda x: x[0])
            yield Piece(r, held, own, size, blocked[first:last], cue)
            kept = max(0, own + size - 2)
            for word, _, _ in held[:kept]:
                cue = _after(word, cue)
            held, own = held[kept:], own + size - kept


def _after(word: str, cue: tuple[int, int]) -> tuple[int, int]:
    """The last cue, and the words since, after a token."""
    if not word[0].isalpha():
        return cue
    low = word.lower()
    return (_CUE[low], 0) if low in _CUE else (cue[0], cue[1] + 1)


class Tokens:
    """Flat arrays of the tokens of several pieces, and prefix sums over them."""

    def __init__(self, parts: Sequence[Piece]):
        starts, stops, region, cues, own, words, blocks = [], [], [], [], [], [], [np.zeros((0, len(_FLAGS)), np.int8)]
        rows: list[tuple] = []
        for r, part in enumerate(parts):
            cue, closed, blocked = part.cue, 0, part.blocked
            for k, (word, a, b) in enumerate(part.words):
                starts.append(a), stops.append(b), region.append(r), cues.append(cue[0] if cue[1] <= CUE_REACH else 0)
                own.append(part.own <= k < part.own + part.size), words.append(word)
                while closed < len(blocked) and blocked[closed][1] <= a:
                    closed += 1
                low = word.lower()
                letters, digits = word[0].isalpha(), word[0] in "0123456789"
                cue = _after(word, cue)
                rows.append((
                    letters, digits, word.isspace() and "\n" not in word, "\n" in word, min(len(word), 99) if digits else 0,
                    *[digits and min(len(word), 8) == k for k in range(1, 9)], digits and (len(word) > 3 or int(word) > 255),
                    *[word == c for c in _MARKS], word == "@", low == "at", low == "dot", word == "_", word.isspace() and len(word) > 1,
                    not (letters or digits or word.isspace() or word in _MARKS or word in "@_"), closed < len(blocked) and blocked[closed][0] < b,
                    digits and word[0] == "0", digits and word.startswith("00"), letters and 2 <= len(word) <= 6, low in _ENDS,
                ))
                if len(rows) == 4_096:
                    blocks.append(np.array(rows, np.int8))
                    rows.clear()
        if rows:
            blocks.append(np.array(rows, np.int8))
        self.starts, self.stops, self.region, self.cue = (np.array(x, np.int64) for x in (starts, stops, region, cues))
        self.own, self.words = np.array(own, bool), words
        flags = np.concatenate(blocks)
        sums = np.vstack([np.zeros((1, len(_FLAGS)), np.int32), np.cumsum(flags, axis=0, dtype=np.int32)])
        self.flags = {name: flags[:, k].astype(np.int64) for k, name in enumerate(_FLAGS)}
        self.sums = {name: sums[:, k] for k, name in enumerate(_FLAGS)}
        self._luhn()

    def _luhn(self) -> None:
        """Prefix sums of digits, plain and doubled, by the parity of their place among digits."""
        plain, doubled = np.zeros((2, len(self.starts) + 1), np.int64), np.zeros((2, len(self.starts) + 1), np.int64)
        seen = 0
        for k in np.flatnonzero(self.flags["digits"]):
            # A run of more digits than an entity may have is in none.
            for c in self.words[k] if len(self.words[k]) < 99 else "":
                d = int(c)
                plain[seen & 1, k + 1] += d
                doubled[seen & 1, k + 1] += 2 * d - 9 * (d > 4)
                seen += 1
            seen += 99 * (len(self.words[k]) >= 99)
        self.plain, self.doubled = np.cumsum(plain, axis=1), np.cumsum(doubled, axis=1)

    def count(self, name: str, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.sums[name][j] - self.sums[name][i]

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and ends of the segments that may be entities."""
        f, n = self.flags, len(self.starts)
        begins = (f["digits"] | f["letters"] | f["+"] | f["("]) & (1 - f["blocked"]) & self.own
        ends = f["digits"] | f["letters"]
        found = [(np.zeros(0, np.int64),) * 2]
        for size in range(1, min(MAX_TOKENS, n) + 1):
            i = np.flatnonzero(begins[: n - size + 1] & ends[size - 1 :])
            j = i + size
            i, j = i[self.region[i] == self.region[j - 1]], j[self.region[i] == self.region[j - 1]]
            clean = (self.count("blocked", i, j) == 0) & (self.count("newline", i, j) == 0) & (self.count("other", i, j) == 0)
            i, j = i[clean], j[clean]
            size_of = self.count("size", i, j)
            at, letters = self.count("@", i, j) + self.count("at", i, j), self.count("letters", i, j)
            number = (letters == 0) & (at == 0) & (size_of >= DIGITS[0]) & (size_of <= DIGITS[1]) & (f["digits"][j - 1] == 1)
            dots = self.count(".", i, j) + self.count("dot", i, j)
            address = (at == 1) & (dots >= 1) & (f["suffix"][j - 1] == 1) & (f["+"][i] + f["("][i] + f["at"][i] + f["dot"][i] == 0)
            address &= f["letters"][j - 2] + f["digits"][j - 2] == 0
            ok = number | address
            found.append((i[ok], j[ok]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def features(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """One row of FEATURES indicators per segment."""
        f, c = self.flags, lambda name: self.count(name, i, j)
        size, groups, last = c("size"), c("digits"), j - 1
        parity = (self.sums["size"][j] + 1) & 1  # of the last digit, which is not doubled
        luhn = sum(np.where(parity == p, self.plain[p][j] - self.plain[p][i], self.doubled[p][j] - self.doubled[p][i]) for p in (0, 1)) % 10 == 0
        lengths = np.stack([c(f"g{k}") for k in range(1, 9)], axis=1) > 0
        longest, shortest = 8 - np.argmax(lengths[:, ::-1], axis=1), 1 + np.argmax(lengths, axis=1)
        none = ~lengths.any(axis=1)
        longest[none] = shortest[none] = 0
        # A bracketed mark counts once, as a mark.
        wrapped = c("[") + c("{") + c("<")
        space, dash, dot, slash, colon, comma, paren = c("space"), c("-"), c("."), c("/"), c(":"), c(","), c("(")
        kinds = (space > 0) * 1 + (dash > 0) + (dot > 0) + (slash > 0) + (colon > 0) + (comma > 0) + (paren > 0)
        at, word_at, word_dot = c("@"), c("at"), c("dot")
        before, after = np.maximum(i - 1, 0), np.minimum(j, len(self.starts) - 1)
        has_before, has_after = (i > 0) & (self.region[before] == self.region[i]), (j < len(self.starts)) & (self.region[after] == self.region[last])
        after2 = np.minimum(j + 1, len(self.starts) - 1)
        before2 = np.maximum(i - 2, 0)
        more_after = has_after & (self.region[after2] == self.region[last]) & (f["digits"][after2] == 1) & (f["letters"][after] == 0) & (f["digits"][after] == 0)
        more_before = has_before & (i > 1) & (self.region[before2] == self.region[i]) & (f["digits"][before2] == 1) & (f["letters"][before] == 0) & (f["digits"][before] == 0)
        first = np.where(f["digits"][i] == 1, f["size"][i], f["size"][np.minimum(i + 1, len(self.starts) - 1)])
        mail = at + word_at > 0
        octets = (groups == 4) & (c("big") == 0) & (dot == 3) & ~mail
        columns = [
            np.ones(len(i), bool), *[(size == d) & ~mail for d in range(DIGITS[0], DIGITS[1] + 1)], *[(np.minimum(groups, 7) == g) & ~mail for g in range(1, 8)],
            f["+"][i] == 1, (f["("][i] == 1) & (f["size"][np.minimum(i + 1, last)] == 3), f["("][i] == 1, f["zero"][i] == 1, f["double_zero"][i] == 1,
            luhn & (size >= 14) & (size <= 19), ~luhn & (size >= 14), *[(longest == k) & ~mail for k in range(1, 9)], *[(shortest == k) & ~mail for k in range(1, 9)],
            *[(np.minimum(first, 8) == k) & ~mail for k in range(1, 9)], *[(np.minimum(f["size"][last], 8) == k) & ~mail for k in range(1, 9)],
            *[(kinds == k) & ~mail for k in range(4)], kinds > 3, (space > 0) & (kinds == 1) & ~mail, (dash > 0) & (kinds == 1) & ~mail, (dot > 0) & (kinds == 1) & ~mail,
            slash > 0, colon > 0, comma > 0, c("wide") > 0, paren > 1, (wrapped > 0) & ~mail, octets, octets & (wrapped + paren > 0), (dot == 3) & ~octets & ~mail,
            c("+") > (f["+"][i] == 1), c(")") != paren, c("]") != c("["), c("_") > 0,
            *[self.cue[i] == k for k in range(1, len(CUES) + 1)], (self.cue[i] == 0),
            has_before & (f["letters"][before] == 1), has_after & (f["letters"][after] == 1), more_after, more_before, has_after & (f["digits"][after] == 1), has_before & (f["digits"][before] == 1),
            has_before & (f["."][before] + f["-"][before] + f["/"][before] + f[":"][before] + f[","][before] + f["+"][before] + f["("][before] + f["@"][before] + f["_"][before] > 0),
            at > 0, mail & (word_at > 0), (word_at > 0) & (wrapped + paren > 0), (word_at > 0) & (wrapped + paren == 0), (word_at > 0) & (word_dot > 0), (word_at > 0) & (word_dot == 0),
            mail & (word_dot > 0), mail & (dot > 0), mail & (space > 0) & (at > 0), *[mail & (np.minimum(c("letters") + groups - word_at - word_dot, 8) == k) for k in range(2, 9)],
            mail & (comma + colon + slash > 0), mail & (self._spaced(i, j) > 0), mail & (self._stops(i, j) > 0), mail & (f["ending"][last] == 1), mail & (f["ending"][last] == 1) & (word_dot > 0),
        ]
        return np.stack(columns, axis=1).astype(np.float32)

    def _spaced(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Blanks between two letter or digit tokens neither of which is a mark: words in a row."""
        word = (self.flags["letters"] | self.flags["digits"]) & ~(self.flags["at"] | self.flags["dot"]) & 1
        between = np.zeros(len(self.starts) + 1, np.int64)
        if len(word) > 2:
            between[2:-1] = np.cumsum(word[:-2] & self.flags["space"][1:-1] & word[2:])
        between[-1] = between[-2] if len(word) else 0
        return np.maximum(between[np.maximum(j - 1, 0)] - between[np.minimum(i + 1, len(self.starts))], 0)

    def _stops(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Full stops: a dot right after a word and with a blank behind it."""
        ended = np.zeros(len(self.starts) + 1, np.int64)
        if len(self.starts) > 1:
            blank = self.flags["space"] | self.flags["newline"]
            after_blank = np.r_[0, blank[:-1]]
            ended[1:-1] = np.cumsum(self.flags["."][:-1] & blank[1:] & (1 - after_blank[:-1]))
        ended[-1] = ended[-2]
        return ended[j - 1] - ended[i]


_FLAGS = (
    "letters", "digits", "space", "newline", "size", *[f"g{k}" for k in range(1, 9)], "big", *_MARKS, "@", "at", "dot", "_", "wide", "other", "blocked", "zero", "double_zero", "suffix", "ending",
)


def _luhn_number(rng: random.Random, n: int, valid: bool = True) -> str:
    digits = [rng.randrange(10) for _ in range(n - 1)]
    digits[0] = rng.randrange(3, 7)
    total = sum(d if k % 2 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
    check = -total % 10
    return "".join(map(str, digits)) + str(check if valid else (check + rng.randrange(1, 10)) % 10)


def _filled(rng: random.Random, form: str) -> str:
    """``9`` is any digit, ``8`` one of 2 to 9."""
    return "".join(str(rng.randrange(10)) if c == "9" else str(rng.randrange(2, 10)) if c == "8" else c for c in form)


#: Telephone formats; 9 stands for a digit, 8 for one of 2 to 9.
PHONES = (
    "+1 (899) 899-9999", "+44 20 8999 9999", "+49 89 99999999", "+33 8 99 99 99 99", "+34 899 999 999", "(899) 899-9999", "(899)899-9999", "899-899-9999", "899.899.9999", "1-899-899-9999",
    "1 (899) 899-9999", "0899 999 9999", "089 8999 9999", "0899/8999999", "0899/89 99 99", "0049 89 8999999", "001 899 899 9999", "08 99 99 99 99", "08.99.99.99.99", "089-89999999", "0899 899999",
    "(089) 8999 9999", "+1.899.899.9999", "+49/899/8999999", "+ 49 89 899 9999",
)
#: Digits that are not personal data.
NUMBERS = (
    "2099-09-19", "19/09/2099", "2099-09-19 09:19:59", "19.09.2099", "2099/09/19", "19:59:59", "9.9.9", "99.9.9.9999", "89.99.999.8999", "978-9-99-999999-9", "9,999,999.99", "8,999,999", "1899-2099",
    "99 89 99 89 99", "89, 99, 89, 99", "89.9999, 9.9999", "89999-9999", "89:99:99:99", "8999999", "89999999", "899999999", "8999999999", "89999999999999", "899 899 899", "8 9 9 9 9 9 9 9", "99-99-99-99",
    "99.99.99", "8.999.999", "8999/9999/9999", "(8999) 8999", "89 (999) 89", "2099-19-99T09:19:59", "899999-899999", "89/99/99/99", "1899-1999, 2099", "99999 99999", "899.99 + 899.99", "[89] [99] [999]", "8999 8999",
    "89_99_9999", "2099.09.19 89:99", "8.99e-09 899", "1.899.999.999", "89 999 999 999", "8'999'999", "0.8999999", "0.99 0.89 0.99", "899-8999", "8899-999-99",
)
_AT = ("@", " @ ", " at ", " (at) ", " [at] ", "(at)", "[at]", " AT ", "{at}", " <at> ")
_DOT = (".", " dot ", " (dot) ", " [dot] ", "[.]", "(dot)", " DOT ", "{dot}", "[dot]")


def _word(rng: random.Random, least: int = 3, most: int = 9) -> str:
    return "".join(rng.choice("aeiourstlnmdh") for _ in range(rng.randint(least, most)))


def _email(rng: random.Random) -> str:
    at = rng.choice(_AT)
    dot = "." if at in ("@", " @ ") and rng.random() < 0.7 else rng.choice([d for d in _DOT if d != "." or at.strip() not in ("at", "AT")])
    local = _word(rng) + rng.choice(("", "", f".{_word(rng)}", f"_{_word(rng, 1, 4)}", str(rng.randrange(100)), f".{rng.randrange(100)}"))
    return local + at + _word(rng) + rng.choice(("", "", f"-{_word(rng)}")) + rng.choice(("", "", f"{dot}{_word(rng)}")) + dot + rng.choice(_ENDS)


def _card(rng: random.Random, valid: bool) -> str:
    number = _luhn_number(rng, rng.choice((15, 16, 16, 16)), valid)
    mark = rng.choice(("", " ", "-", ".", "  ", " - ", "/", "."))
    return mark.join(number[k : k + 4] for k in range(0, len(number), 4)) if len(number) == 16 else mark.join((number[:4], number[4:10], number[10:]))


def examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with the entities in them, written from the formats above."""
    rng, out = random.Random(seed), []
    cues = [w.split() for w in CUES.values()]
    for _ in range(n):
        text, gold = " ".join(_word(rng, 2, 8) for _ in range(rng.randint(0, 4))), []
        for _ in range(rng.choice((1, 1, 1, 2))):
            kind = rng.choice((*KINDS, "phone", None, None, None))
            if kind == "email":
                piece, cue = _email(rng), 0
            elif kind == "ip":
                piece, cue = rng.choice((".", "[.]", "[.]", "(.)")).join(str(rng.randrange(10, 256)) for _ in range(4)), 1
            elif kind == "card":
                piece, cue = _card(rng, True), 2
            elif kind == "phone":
                piece, cue = _filled(rng, rng.choice(PHONES)), 3
            else:
                piece, cue = _filled(rng, rng.choice(NUMBERS)), 4
                wrong = rng.random()
                if wrong < 0.15:
                    piece = _card(rng, False)
                elif wrong < 0.3:
                    piece = rng.choice(("{} at the {}. {} {}", "{} {} at {}. {}", "look at {} . {} dot {} {}", "at {} dot the {} {} {}", "{} dot {} at {} {}", "{} @ {} {} {}", "{} at {} the dot of {} {}", "{} at {} {} {}.")).format(*(_word(rng, 2, 7) for _ in range(4)))
                elif wrong < 0.4:
                    piece = _word(rng, 1, 3) + piece if wrong < 0.35 else piece + _word(rng, 1, 3)
            text += rng.choice(("", " ")) if not text else " "
            if rng.random() < 0.4:
                text += rng.choice(cues[cue] if rng.random() < 0.9 else cues[rng.randrange(5)]) + rng.choice((" ", ": ", ". ", " is "))
            if kind:
                gold.append((len(text), len(text) + len(piece), kind))
            text += piece + rng.choice(("", "", ".", ",", ")", ";"))
            text += "".join(" " + _word(rng, 2, 8) for _ in range(rng.randint(0, 3)))
        out.append((text, gold))
    return out


def _sums(order: np.ndarray, i: np.ndarray, j: np.ndarray, score: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Log sums of all segmentations up to each token; ``order`` goes by the segments' ends."""
    alpha = np.zeros(n + 1)
    at = 0
    ends = j[order]
    for t in range(1, n + 1):
        total = alpha[t - 1] if not first[t - 1] else 0.0
        while at < len(order) and ends[at] == t:
            k = order[at]
            start = 0.0 if first[i[k]] else alpha[i[k]]
            total = np.logaddexp(total, start + score[k])
            at += 1
        alpha[t] = total
    return alpha


def likelihood(tokens: Tokens, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> tuple[float, np.ndarray]:
    """The log of the summed weight of all segmentations, and each segment's probability for each kind.

    ``score`` has a row per segment and a column per kind.
    """
    n = len(tokens.starts)
    top = np.logaddexp.reduce(score, axis=1)
    first = np.r_[True, tokens.region[1:] != tokens.region[:-1]]
    last = np.r_[first[1:], True]
    forward = _sums(np.argsort(j, kind="stable"), i, j, top, first, n)
    backward = _sums(np.argsort(n - i, kind="stable"), n - j, n - i, top, last[::-1], n)[::-1]
    total = forward[1:][last]
    of = tokens.region[i]
    before = np.where(first[i], 0.0, forward[i])
    after = np.where(last[j - 1], 0.0, backward[j])
    return float(total.sum()), np.exp(before[:, None] + score + after[:, None] - total[of][:, None])


def fit(n: int = 1200, seed: int = 7, rounds: int = 60, penalty: float = 0.02) -> np.ndarray:
    """Weights (features by kinds) of greatest penalised likelihood of ``n`` examples, by Adam."""
    given = examples(n, seed)
    tokens = Tokens(list(pieces([(text, 0, ()) for text, _ in given])))
    i, j = tokens.candidates()
    phi = tokens.features(i, j)
    gold = np.zeros((len(i), len(KINDS)))
    wanted = {(r, a, b): KINDS.index(kind) for r, (_, spans) in enumerate(given) for a, b, kind in spans}
    for k, key in enumerate(zip(tokens.region[i].tolist(), tokens.starts[i].tolist(), tokens.stops[j - 1].tolist())):
        if key in wanted:
            gold[k, wanted[key]] = 1
    weights, m, v = np.zeros((phi.shape[1], len(KINDS))), 0.0, 0.0
    for step in range(1, rounds + 1):
        _, p = likelihood(tokens, i, j, phi @ weights)
        slope = phi.T @ (gold - p) - penalty * weights
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        weights = weights + 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return weights.astype(np.float32)


@lru_cache(maxsize=1)
def trained() -> np.ndarray:
    return fit()


def decode(regions: Sequence[tuple[str, int, Sequence[tuple[int, int]]]], weights: np.ndarray, margin: float = MARGIN) -> list[list[tuple[int, int, int]]]:
    """Per region (text, place, blocked spans) the (start, kind, stop) of the best segmentation."""
    good: list[list[tuple]] = [[] for _ in regions]
    held: list[Piece] = []

    def score() -> None:
        tokens = Tokens(held)
        i, j = tokens.candidates()
        for k in range(0, len(i), 50_000):
            a, b = i[k : k + 50_000], j[k : k + 50_000]
            scored = tokens.features(a, b) @ weights - margin
            kind, best = np.argmax(scored, axis=1), scored.max(axis=1)
            # A segment that scores nothing never betters leaving its tokens outside.
            for n in np.flatnonzero(best > 0):
                good[held[tokens.region[a[n]]].region].append((int(tokens.stops[b[n] - 1]), int(tokens.starts[a[n]]), int(kind[n]), float(best[n])))
        held.clear()

    size = 0
    for piece in pieces(regions):
        held.append(piece)
        size += len(piece.words)
        if size > 4 * WINDOW:
            score()
            size = 0
    if held:
        score()
    return [_best_segmentation(sorted(segments)) for segments in good]


def _best_segmentation(segments: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Of (stop, start, kind, score > 0) by stop, the disjoint ones of greatest sum, as (start, kind, stop)."""
    ends, value, taken = [-1], [0.0], [(None, 0)]  # the best sum of segments that end at or before a place
    for k, (stop, start, _, score) in enumerate(segments):
        before = bisect_right(ends, start) - 1
        total = value[before] + score
        if total > value[-1]:
            if ends[-1] == stop:
                ends.pop(), value.pop(), taken.pop()
            ends.append(stop), value.append(total), taken.append((k, before))
    at, found = len(ends) - 1, []
    while at > 0:
        k, at = taken[at]
        stop, start, kind, _ = segments[k]
        found.append((start, kind, stop))
    return found[::-1]
