"""License scans: a trained paragraph classifier, confirmed against templates.

1. Every paragraph becomes sparse word 1- to 3-grams for a multinomial logistic
   regression over licence families and an unknown class.  It is trained from
   the notices below (whole, cut, with words lost, amid other words) against
   shuffled notices, notices of other licences and paragraphs of a bounded
   sample of the corpus as unknown.  A temperature, fitted on other notices and
   other paragraphs, calibrates the probabilities; a prediction below
   ``least_probability`` is unknown.
   N-grams of words that are common in that sample are no features.
2. A paragraph of any length is scored as a whole and by windows of several
   lengths, from prefix sums over its words' weights, so a notice is found in a
   text without empty lines as well.
3. A prediction is confirmed if enough of the n-grams of a template of its
   family stand in the paragraph, and the versions and variants named there
   (2.0, NC, Lesser, ...) are those of the template.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
_GNU = {
    "gpl-2.0": ("GNU General Public License", "GPL", "2"), "gpl-3.0": ("GNU General Public License", "GPL", "3"),
    "lgpl-2.1": ("GNU Lesser General Public License", "LGPL", "2.1"), "lgpl-3.0": ("GNU Lesser General Public License", "LGPL", "3"),
    "agpl-3.0": ("GNU Affero General Public License", "AGPL", "3"),
}
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"



def _worded(*names: str) -> list[str]:
    """Short mentions of a licence by its names."""
    return [w.format(n) for n in names for w in ("{}", "Released under {}", "Licensed under the {}", "Distributed under the terms of the {}")]


#: Customary notices of each family, to train from and to compare with.
NOTICES: dict[str, list[str]] = {
    **{f"apache-{v}": [
        f"Licensed under the Apache License, Version {v}.",
        f"Licensed under the Apache License, Version {v} (the \"License\"); you may not use this file except in compliance with the License.",
        f"SPDX-License-Identifier: Apache-{v}",
        *_worded(f"Apache {v}", f"Apache License {v}", f"Apache License Version {v}"),
    ] for v in ("1.1", "2.0")},
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        _WARRANTY,
        "Distributed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        f"{_CONDITIONS}.",
        f"{_CONDITIONS}: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
        "Released under the zlib License.",
        "SPDX-License-Identifier: Zlib",
    ],
    **{family: [
        f"This work is licensed under the {name}, version {v}.",
        f"Licensed under the {name} version {v}.",
        *_worded(f"{short} v{v}", f"{short} version {v}", f"{name} version {v}"),
        f"you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {v} of the License, or any later version.",
        f"you can redistribute it under the terms of the {name} as published by the Free Software Foundation, version {v}.",
        f"SPDX-License-Identifier: {family.upper()}",
        f"SPDX-License-Identifier: {family.upper()}-or-later",
        f"SPDX-License-Identifier: {family.upper()}-only",
    ] for family, (name, short, v) in _GNU.items()},
    **{f"mpl-{v}": [
        f"This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}.",
        f"Licensed under the Mozilla Public License, version {v}.",
        *_worded(f"MPL {v}", f"Mozilla Public License {v}"),
        f"SPDX-License-Identifier: MPL-{v}",
    ] for v in ("1.1", "2.0")},
    **{f"epl-{v}": [
        f"Licensed under the Eclipse Public License, version {v}.",
        *_worded(f"EPL {v}", f"Eclipse Public License {v}"),
        f"SPDX-License-Identifier: EPL-{v}",
    ] for v in ("1.0", "2.0")},
    **{f"cc-{code}": [text for v in ("2.0", "2.5", "3.0", "4.0") for text in (
        *_worded(f"CC {code.upper()} {v}"),
        f"This work is licensed under a Creative Commons {name} {v} International License.",
        f"Creative Commons {name} {v}",
        f"SPDX-License-Identifier: CC-{code.upper()}-{v}",
    )] for code, name in _CC.items()},
    "public-domain": [
        "This work has been released into the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright, all rights reserved. No part of this work may be reproduced without prior written permission.",
        "This document is confidential and proprietary; unauthorised copying is prohibited.",
    ],
}
#: Other wordings, for the temperature alone.
CALIBRATION: dict[str, list[str]] = {
    "apache-2.0": ["Released under the Apache License 2.0", "Apache 2.0 license applies to this code"],
    "apache-1.1": ["Covered by the Apache Software License, Version 1.1"],
    "mit": ["MIT licensed", "This project is available under the MIT license, see the file for details"],
    "bsd": ["BSD licensed, see the 3-clause BSD license", "Redistribution and use of this package in source and binary forms are permitted"],
    "isc": ["ISC license", "permission to use, copy and distribute this software for any purpose is granted"],
    "zlib": ["under the zlib license", "this software is provided as-is without any express or implied warranty"],
    "gpl-2.0": ["GPLv2", "released under version 2 of the GNU General Public License"],
    "gpl-3.0": ["GPLv3", "released under version 3 of the GNU General Public License"],
    "lgpl-2.1": ["LGPLv2.1", "the GNU Lesser General Public License, version 2.1, applies"],
    "lgpl-3.0": ["LGPLv3", "the GNU Lesser General Public License, version 3, applies"],
    "agpl-3.0": ["AGPLv3", "the GNU Affero General Public License, version 3, applies"],
    "mpl-2.0": ["under the MPL 2.0", "subject to the Mozilla Public License 2.0"],
    "epl-2.0": ["made available under the terms of the Eclipse Public License 2.0"],
    "cc-by": ["available under CC BY 4.0"], "cc-by-sa": ["available under CC BY-SA 3.0"], "cc-by-nc": ["available under CC BY-NC 4.0"],
    "cc-by-nd": ["available under CC BY-ND 4.0"], "cc-by-nc-sa": ["available under CC BY-NC-SA 4.0"], "cc-by-nc-nd": ["available under CC BY-NC-ND 4.0"],
    "public-domain": ["dedicated to the public domain under CC0", "placed in the public domain by its author"],
    "proprietary": ["Copyright 2021, all rights reserved", "strictly confidential, do not copy"],
}
#: Licences of no family here: they are unknown.
OTHERS = [
    "Licensed under the Artistic License 2.0.", "Distributed under the Boost Software License, Version 1.0.", "under the Common Development and Distribution License 1.1",
    "European Union Public Licence v. 1.2", "Zope Public License version 2.1", "Open Software License version 3.0", "Python Software Foundation License version 2",
    "the license fee is due at the end of the year", "a driving license is needed to rent a car", "permission to enter was granted by the guard", "free software is good for people",
    "the public library holds a licence to sell wine", "the general public was not admitted", "his version of the story is free of charge",
]
UNKNOWN = "unknown"
#: Documents and characters of the sample from which unknown paragraphs are learnt.
SAMPLE_DOCS, SAMPLE_CHARS = 1_000, 500_000
#: Words of the windows in which a longer paragraph is scored besides as a whole.
WINDOWS = (12, 40, 120)
#: Words that a worker remembers; share of the sample's paragraphs that has a common word.
REMEMBERED, COMMON = 300_000, 0.02
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_GLUED = re.compile(r"(a?l?gpl|mpl|epl|apache|bsd|cc)v?([0-9.]+)|v([0-9.]+)")
#: Words whose presence tells variants of one licence apart.
VARIANTS = frozenset("lesser library affero nc noncommercial sa sharealike nd noderivatives noderivs agpl lgpl gpl eclipse mozilla".split())
_SAME = {"noderivs": "nd", "noderivatives": "nd", "noncommercial": "nc", "sharealike": "sa", "library": "lesser"}
_BEFORE_VERSION = frozenset("version license licence gpl lgpl agpl apache mpl epl by sa nc nd attribution sharealike noncommercial noderivatives noderivs v".split())


def parts_of(word: str) -> tuple[str, ...]:
    """A word as the model sees it: names and numbers apart, no needless zeros in versions."""
    glued = _GLUED.fullmatch(word)
    words = (word,) if not glued else (glued[1], glued[2]) if glued[1] else (glued[3],)
    return tuple(w.removesuffix(".0") if w[0].isdigit() else w for w in words)


def tokens(text: str) -> list[str]:
    return [p for w in _WORD.findall(text.lower()) for p in parts_of(w)]


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def paragraphs(text: str) -> Iterator[tuple[int, str]]:
    """(number of the first line, text) of blocks between empty lines."""
    block: list[str] = []
    first = 0
    for k, line in enumerate(text.split("\n")):
        if line.strip():
            if not block:
                first = k
            block.append(line)
        elif block:
            yield first, "\n".join(block)
            block = []
    if block:
        yield first, "\n".join(block)


def _named(words: list[str]) -> tuple[frozenset, frozenset]:
    """The versions and variants that a stretch of words names."""
    versions = {w for before, w in zip(words, words[1:]) if w[0].isdigit() and before in _BEFORE_VERSION}
    return frozenset(versions), frozenset(_SAME.get(w, w) for w in words if w in VARIANTS)


@dataclass
class LicenseModel:
    families: list[str]
    words: dict[str, int]  # number of each known word
    keys: np.ndarray  # sorted numbers of the known grams, and their columns
    columns: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    common: frozenset  # words of the corpus at large: n-grams of these alone are no features
    templates: list[tuple[str, set[str], frozenset, frozenset]]

    def columns_of(self, ids: np.ndarray) -> list[np.ndarray]:
        """The columns of the 1-, 2- and 3-grams that end at each word; -1 where one is not known."""
        base, out = len(self.words) + 1, []
        key, known = np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
        for n in range(3):
            before = np.r_[np.full(n, -1), ids[: len(ids) - n]] if n else ids
            known = known & (before >= 0)
            key = key + (before + 1) * base**n
            found = np.full(len(ids), -1)
            asked = np.flatnonzero(known)
            place = np.minimum(np.searchsorted(self.keys, key[asked]), len(self.keys) - 1)
            hit = self.keys[place] == key[asked]
            found[asked[hit]] = self.columns[place[hit]]
            out.append(found)
        return out

    def telling(self) -> np.ndarray:
        """Which columns speak for some family more than for unknown; a part without any cannot be of a family."""
        own = (self.weights[:, :-1] - self.weights[:, -1:]).max(axis=1) > 0
        return own | bool((self.bias[:-1] - self.bias[-1]).max() > 0)

    def logits(self, columns: list[np.ndarray], ranges: np.ndarray) -> np.ndarray:
        """Of the word ranges [a, b), from prefix sums: the mean weight of the known grams times the root of their number."""
        total, count = np.zeros((len(ranges), len(self.families))), np.zeros(len(ranges))
        for n, found in enumerate(columns):
            own = np.where((found >= 0)[:, None], self.weights[found], 0)
            sums = np.concatenate([np.zeros((1, own.shape[1])), np.cumsum(own, axis=0)])
            counts = np.r_[0, np.cumsum(found >= 0)]
            a, b = np.minimum(ranges[:, 0] + n, ranges[:, 1]), ranges[:, 1]
            total += sums[b] - sums[a]
            count += counts[b] - counts[a]
        return self.bias + total / np.sqrt(np.maximum(count, 1))[:, None]

    def classify(self, columns: list[np.ndarray], ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most likely family of each word range, as a number, and its calibrated probability."""
        z = self.logits(columns, ranges) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        k = p.argmax(axis=1)
        return k, p[np.arange(len(k)), k]

    def nearest(self, words: list[str], family: str) -> tuple[float, bool, int]:
        """The greatest share of a template's grams in the words, whether its versions and variants are theirs, and its grams."""
        found = grams(words)
        near = [(len(found & own) / len(own), own, versions, variants) for name, own, versions, variants in self.templates if name == family]
        most = max((x[0] for x in near), default=0.0)
        for share, own, versions, variants in near:
            if share == most > 0:
                at = [i for i in range(len(words) - 1) if f"{words[i]} {words[i + 1]}" in own]
                own_versions, own_variants = _named(words[max(0, at[0] - 3) : at[-1] + 6] if at else words)
                if own_variants == variants and (not versions or own_versions == versions):
                    return most, True, len(own)
        return most, False, 0


class Scanner:
    """Reads paragraphs with a model; remembers the numbers of words."""

    def __init__(self, model: LicenseModel, least_probability: float, least_similarity: float):
        self.model, self.least_probability, self.least_similarity = model, least_probability, least_similarity
        self.seen: dict[str, tuple[int, ...]] = {}
        self.marking: set[str] = set()  # words seen that some feature can contain
        self.telling = np.append(model.telling(), False)  # column -1 is no column

    def read(self, low: str) -> list[str] | None:
        """The words of a lower-cased text; None if no feature can be in it, so that every class has its bias."""
        found = _WORD.findall(low)
        own = set(found)
        if len(self.seen) > REMEMBERED:
            self.seen.clear(), self.marking.clear()
        words, common = self.model.words, self.model.common
        for w in [w for w in own if w not in self.seen]:
            parts = parts_of(w)
            self.seen[w] = tuple(words.get(p, -1) for p in parts)
            if any(p in words and p not in common for p in parts):
                self.marking.add(w)
        return None if self.marking.isdisjoint(own) else found

    def ids(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the parts of words that were read, and the word of each."""
        each = [self.seen[w] for w in found]
        return np.array([i for x in each for i in x], np.int64), np.repeat(np.arange(len(each)), [len(x) for x in each])

    def scan(self, text: str) -> Iterator[tuple]:
        """(line, family, probability, similarity, confirmed, words) of the parts of a paragraph that speak of a licence."""
        low = text.lower()
        found = self.read(low)
        if found is None:
            return
        ids, owner = self.ids(found)
        n = len(ids)
        columns = self.model.columns_of(ids)
        if not any(self.telling[c].any() for c in columns):
            return
        ranges = [np.array([[0, n]])]
        for size in WINDOWS:
            if n > size:
                starts = np.append(np.arange(0, n - size, max(1, size // 4)), n - size)
                ranges.append(np.stack([starts, starts + size], axis=1))
        ranges = np.concatenate(ranges)
        family, p = self.model.classify(columns, ranges)
        unknown = len(self.model.families) - 1
        asked = np.flatnonzero(family != unknown)
        if not len(asked):
            return
        places = [m.span() for m in _WORD.finditer(low)]
        found, filled = [], False  # whether a template makes up most of the paragraph
        for k in asked.tolist():
            a, b = ranges[k]
            name, sure = self.model.families[family[k]], bool(p[k] >= self.least_probability)
            similarity, same, size = self.model.nearest(tokens(low[places[owner[a]][0] : places[owner[b - 1]][1]]), name) if sure else (0.0, False, 0)
            filled = filled or (k == 0 and 2 * n <= size)
            found.append((sure and same and similarity >= self.least_similarity, sure, round(similarity, 9), -int(b - a), float(p[k]), int(a), int(b), name))
        whole = [x for x in found if x[5] == 0 and x[6] == n]
        if whole and whole[0][0] and filled and not any(x[0] and x[7] != whole[0][7] for x in found):
            found = whole  # one notice and no other
        taken = np.zeros(n, bool)
        kept = []
        for confirmed, sure, similarity, _, probability, a, b, name in sorted(found, reverse=True):
            # Windows that no template confirms count only where nothing else was found.
            if not taken[a:b].any():
                taken[a:b] = True
                kept.append((a, b, name if sure else UNKNOWN, probability, similarity, confirmed))
        for a, b, name, probability, similarity, confirmed in sorted(kept):
            first, last = places[owner[a]][0], places[owner[b - 1]][1]
            yield text.count("\n", 0, first), name, probability, similarity, confirmed, text[first:last]


def _examples(rng: random.Random, notices: dict[str, list[str]], others: list[str], each: int) -> tuple[list[list[str]], list[str]]:
    texts, names = [], []
    every = [tokens(n) for own in notices.values() for n in own]
    filler = [w for t in others for w in tokens(t)] or ["text"]
    amid = lambda words: (filler[(a := rng.randrange(len(filler))) : a + rng.randrange(60)]) + words + filler[(b := rng.randrange(len(filler))) : b + rng.randrange(60)]  # noqa: E731, F841
    for family, own in notices.items():
        for k in range(each):
            words = tokens(own[k % len(own)])
            if rng.random() < 0.4 and len(words) > 12:
                a = rng.randrange(len(words) // 2)
                words = words[a : a + max(10, int(len(words) * rng.uniform(0.5, 1)))]
            words = [w for w in words if len(words) < 12 or rng.random() > 0.05]
            texts.append(amid(words) if rng.random() < 0.5 else words), names.append(family)
    for k in range(16 * each):
        kind = rng.random()
        words = rng.choice(every) + rng.choice(every)
        rng.shuffle(words)
        if kind < 0.1:
            words = words[: rng.randrange(3, 15)]
        elif kind < 0.75 and others:
            own = tokens(rng.choice(others))
            a, size = rng.randrange(max(1, len(own))), rng.choice((4, 12, 40, 120))
            words = own[a : a + size] + words[: rng.randrange(2)]
        elif kind < 0.95:
            words = amid(tokens(OTHERS[k % len(OTHERS)]))
        texts.append(words), names.append(UNKNOWN)
    return texts, names


def train(others: list[str], seed: int = 11, each: int = 72, rounds: int = 200) -> LicenseModel:
    """Fit the classifier; ``others`` are paragraphs that are not licences: two thirds to learn from, the rest to calibrate."""
    rng = random.Random(seed)
    families = [*NOTICES, UNKNOWN]
    own = [tokens(n) for every in (*NOTICES.values(), OTHERS) for n in every]
    words = {w: k for k, w in enumerate(sorted({w for t in own for w in t}))}
    spread = Counter(w for t in others for w in set(tokens(t)))
    common = frozenset(w for w, n in spread.items() if n >= max(3, COMMON * len(others)))
    names = sorted({g for t in own for g in grams(t) if not common.issuperset(g.split(" "))}, key=lambda g: (g.count(" "), g))
    base = len(words) + 1
    keys = np.array([sum((words[w] + 1) * base**k for k, w in enumerate(reversed(g.split(" ")))) for g in names], np.int64)
    order = np.argsort(keys)
    templates = [(family, grams(t), *_named(t)) for family, every in NOTICES.items() for t in map(tokens, every)]
    model = LicenseModel(families, words, keys[order], order.astype(np.int64), np.zeros((len(names), len(families))), np.zeros(len(families)), 1.0, common, templates)

    def matrix(texts, labels):
        x = np.zeros((len(texts), len(names)), np.float32)
        for row, text in zip(x, texts):
            found = np.concatenate(model.columns_of(np.array([words.get(w, -1) for w in text], np.int64))) if text else np.zeros(0, np.int64)
            np.add.at(row, found[found >= 0], 1 / np.sqrt(max(1, (found >= 0).sum())))
        return x, np.eye(len(families), dtype=np.float32)[[families.index(n) for n in labels]]

    x, y = matrix(*_examples(rng, NOTICES, others[: len(others) * 2 // 3], each))
    w, b = np.zeros((len(names), len(families)), np.float32), np.zeros(len(families), np.float32)
    m1, m2 = np.zeros((len(names) + 1, len(families)), np.float32), np.zeros((len(names) + 1, len(families)), np.float32)
    for k in range(1, rounds + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - y) / len(x)
        g = np.vstack([x.T @ error + 1e-5 * w, error.sum(axis=0)])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = 0.3 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    model.weights, model.bias = w.astype(float), b.astype(float)
    held, label = matrix(*_examples(rng, CALIBRATION, others[len(others) * 2 // 3 :] or others, each // 2))
    z = held @ model.weights + model.bias

    def loss(t):
        q = z / t - (z / t).max(axis=1, keepdims=True)
        return -((q - np.log(np.exp(q).sum(axis=1, keepdims=True))) * label).sum()

    model.temperature = float(min(np.linspace(0.5, 5, 46), key=loss))
    return model


#: Of the sample alone: paragraphs that may speak of licences are not taken for unknown ones.
_DOUBTFUL = r"\bMIT\b|(?i:licen[cs]|copyright|rights|permi|redistrib|domain|commons|confidential|warrant|spdx|gnu|bsd|gpl|apache|mozilla|waive)"


def corpus_paragraphs(docs: DataFrame, sample: int = SAMPLE_DOCS) -> list[str]:
    """Distinct paragraphs of at most ``sample`` distinct texts of the least hashes, SAMPLE_CHARS characters in all at most."""
    n = docs.count()
    share = int(min(1.0, 2 * sample / max(1, n)) * 1_000_000)
    order = F.xxhash64(F.lit("licence"), "text")
    chosen = docs.where(F.pmod(order, F.lit(1_000_000)) <= share).select(order.alias("h"), "text").dropDuplicates(["h"]).orderBy("h").limit(sample)
    parts = chosen.select("h", F.explode(F.split("text", "\n[ \t\r]*\n")).alias("p")).where((F.length("p") < 1_000) & ~F.col("p").rlike(_DOUBTFUL))
    rows = parts.groupBy("p").agg(F.min("h").alias("h")).orderBy("h", "p").limit(SAMPLE_CHARS // 1_000).collect()
    return [r["p"] for r in rows]


def _scan(known, least_probability: float, least_similarity: float, unknown: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known.value, least_probability, least_similarity)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string())
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if scanner.read(text.lower()) is None:
                    continue
                for first, part in paragraphs(text):
                    for line, family, *found in scanner.scan(part):
                        if unknown or family != UNKNOWN:
                            rows.append((doc_id, first + line, family, *found))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "line", "family", "probability", "similarity", "confirmed", "paragraph"])

    return run


def license_scan(docs: DataFrame, least_probability: float = 0.6, least_similarity: float = 0.6, unknown: bool = False, sample: int = SAMPLE_DOCS) -> DataFrame:
    """One row per part of a paragraph of ``docs`` (doc_id, text) that speaks of a licence.

    doc_id, line (from 0), family, probability, similarity (the share of the
    family's nearest template that the part has), confirmed, paragraph.  With
    ``unknown``, also the parts nearest to a family whose probability is too
    low: their family is unknown and their similarity 0.  Null and empty texts
    have none; equal rows are reported one by one; a null doc_id is kept; other
    columns are ignored; no rows give none.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(corpus_paragraphs(slim, sample)))
    schema = "doc_id long, line long, family string, probability double, similarity double, confirmed boolean, paragraph string"
    return slim.mapInArrow(_scan(model, least_probability, least_similarity, unknown), schema)
