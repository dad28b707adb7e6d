"""Licence scan: a trained paragraph classifier whose positives are confirmed against templates.

A text is cut into blocks at blank lines, and these into units: lines, and sentences in them. Every unit is scored.
Neighbouring units of a block that look like a licence (by the model, or because three-word sequences of templates cover
most of them) make a paragraph: so a notice is seen whole whether it is wrapped over lines or stands amid other text.

The features of units and paragraphs are the word n-grams (1 to 3) of licence templates, and the number of words that
occur in none. A multinomial logistic regression tells licence families from each other and from ``unknown``; it learns
from templates whole, in part and distorted, from units of the corpus that share few n-grams with any template, and from
sentences that speak of licences without being one. A temperature, fitted on examples held back from training,
calibrates its probabilities.

A paragraph that has two words in order as in a template, and is no more likely unknown than a licence, is reported with its likeliest family, that family's
probability, and the share of a template's or of the paragraph's own 3-grams they have in common. The template confirms
the family if enough is shared, no other family shares as much and as many, and nothing contradicts: no word that tells another family
(such as lesser, affero, sharealike), and no version that the family's templates don't have.

Defined results: null, empty and blank texts have no paragraphs; copies of a notice in one text are one row each, told
apart by their place, as are rows that repeat a doc_id, or have none; a text of any length is scored whole, AT_ONCE words
at a time; a paragraph no call is made for gives no row, and so does an empty table; other columns are left alone. With
equal probabilities the family that comes first in TEMPLATES is named.

Fitting uses about NEGATIVE_TEXTS texts, and of their units of at most LONGEST words about NEGATIVES, both chosen by a
hash over all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiloom.llm.common import map_arrow, materialize, release

UNKNOWN = "unknown"
#: What a call, a family and a confirmation need, and how much of a unit templates must cover to join its neighbours.
LEAST_LICENCE, LEAST_PROBABILITY, LEAST_SHARED, LEAST_COVERED = 0.5, 0.5, 0.6, 0.6
#: Words scored in one go, in whole texts.
AT_ONCE = 200_000
#: Bounds of the sample that the unknown class is learned from.
NEGATIVE_TEXTS, NEGATIVES, LONGEST = 400, 2000, 200

# Names of licences, and texts of their notices as their stewards publish them.
NAMES: dict[str, list[str]] = {
    "Apache-2.0": ["the Apache License, Version 2.0", "Apache License 2.0"],
    "MIT": ["the MIT License", "MIT"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the New BSD License"],
    "ISC": ["the ISC License"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "GPLv2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "GPLv3"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1", "LGPLv2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0", "LGPLv3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0", "AGPLv3"],
    "MPL-2.0": ["the Mozilla Public License, Version 2.0", "the Mozilla Public License, v. 2.0"],
    "EPL-2.0": ["the Eclipse Public License, Version 2.0", "the Eclipse Public License 2.0"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "BSL-1.0": ["the Boost Software License, Version 1.0"],
    "Zlib": ["the zlib License"],
    "Unlicense": ["the Unlicense"],
}
NOTICES: dict[str, list[str]] = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "BSD": [
        "Copyright (c) the copyright holder. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0.",
    ],
    "BSL-1.0": [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so',
        "Distributed under the Boost Software License, Version 1.0. See accompanying file or copy at https://www.boost.org/LICENSE_1_0.txt",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright, all rights reserved.",
        "All rights reserved. No part of this work may be reproduced without permission.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
#: How a licence is named in a line of its own.
LINES = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "Distributed under the terms of {}."]
#: GNU licences: (family, title, version).
GNU = [
    ("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3"),
]
GNU_NOTICE = "you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
#: Sentences about licences that are none.
NEAR_MISSES = [
    "He lost his driving licence after the accident.", "The committee granted permission to use the hall for a concert.", "Copyright law has changed twice since then.",
    "All rights come with duties.", "She works on the legal side of free software.", "The public domain is what nobody owns.", "A licence to kill, they said, and gave permission to nobody in particular.",
    "The software is provided with a manual.", "The license fee must be paid each year.", "Which version of the license did they choose?", "The terms of the contract are confidential.",
    "We discuss the history of the General Public License and its critics.", "MIT is a university in Cambridge.", "The Apache helicopter was built for the army.", "Creative Commons was founded in 2001.",
    "Mozilla released version 2.0 of its browser.", "Permission is granted by the head of the school.", "No part of the building may be entered without a helmet.", "The Boost was a car of the nineties.",
    "Redistribution of wealth is a matter of debate.", "In no event may a player leave the field.", "The above list is not complete.", "Licensed under the laws of the state as a surveyor.", "Released under the name of his brother.",
]


def templates() -> dict[str, list[str]]:
    """All templates by family."""
    out: dict[str, list[str]] = {f: [line.format(name) for name in names for line in LINES] + [f"SPDX-License-Identifier: {f}"] for f, names in NAMES.items()}
    for f, texts in NOTICES.items():
        out.setdefault(f, []).extend(texts)
    for f, title, version in GNU:
        out[f] += [f"SPDX-License-Identifier: {f}-only", f"SPDX-License-Identifier: {f}-or-later", f"{f}-or-later"]
        body = GNU_NOTICE.format(title, version)
        out[f] += [f"This program is free software: {body}", f"This library is free software; {body}"]
        out[f].append(f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {title} for more details.")
    return out


TEMPLATES = templates()
_WORD, _SENTENCE_END = re.compile(r"[^\W_]+"), re.compile(r"[.!?;:](?=[ \t])")
Gram = tuple[str, ...]


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def units_of(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether a block begins) of each unit with a word: lines, cut where a sentence ends."""
    fresh, at = True, 0
    for line in text.split("\n"):
        if not line.strip():
            fresh = True
        else:
            start = at
            for m in _SENTENCE_END.finditer(line):
                if _WORD.search(text, start, at + m.end()):
                    yield start, at + m.end(), fresh
                    fresh, start = False, at + m.end()
            if _WORD.search(text, start, at + len(line)):
                yield start, at + len(line), fresh
                fresh = False
        at += len(line) + 1


def _grams(ws: list[str], n: int) -> list[Gram]:
    return list(zip(*(ws[k:] for k in range(n))))


def _versions(ws: list[str]) -> set[Gram]:
    """Pairs of words that name a version."""
    return {g for g in _grams(ws, 2) if g[1].isdigit() and (g[0].isdigit() or g[0] in ("version", "v"))} | {(w,) for w in ws if re.fullmatch(r"v\d+", w)}


@dataclass
class Family:
    """What confirms or contradicts a family: its templates' 3-grams, words and versions, and other families' words."""

    grams: list[frozenset] = field(default_factory=list)
    words: set[str] = field(default_factory=set)
    versions: set[Gram] = field(default_factory=set)
    foreign: set[str] = field(default_factory=set)


def families_of(texts: dict[str, list[str]]) -> dict[str, Family]:
    out: dict[str, Family] = {}
    for f, ts in texts.items():
        own = out[f] = Family()
        for t in ts:
            ws = words_of(t)
            own.grams.append(frozenset(_grams(ws, min(3, len(ws)))))
            own.words |= set(ws)
            own.versions |= _versions(ws)
    # words of few families' names tell these from the others
    names = {f: {w for t in (*NAMES.get(f, ()), f.replace("-", " ")) for w in words_of(t) if not w.isdigit()} for f in texts}
    for f, own in out.items():
        own.foreign = {w for g, ws in names.items() if g != f for w in ws if sum(w in x for x in names.values()) <= 6} - own.words - {"the", "a", "v"}
    return out


@dataclass
class Classifier:
    families: list[str]
    features: dict[Gram, int]  # 0 is the number of words in no template, 1 always there
    weights: np.ndarray
    temperature: float
    known: dict[str, Family]
    calibration: float = 0.0  # mean gap between probability and truth on examples held back

    def vector(self, ws: list[str]) -> tuple[list[int], list[float]]:
        found: dict[int, float] = {}
        out = 0
        for n in (1, 2, 3):
            for g in _grams(ws, n):
                k = self.features.get(g)
                if k is not None:
                    found[k] = 1.0
                elif n == 1:
                    out += 1
        found[0], found[1] = float(np.log1p(out)), 1.0
        return list(found), list(found.values())

    def probabilities(self, ws: list[str]) -> np.ndarray:
        at, x = self.vector(ws)
        z = (np.array(x) @ self.weights[at]) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def covered(self, ws: list[str]) -> float:
        """The share of the words that lie in 3-grams of templates."""
        hit = {k + j for k, g in enumerate(_grams(ws, 3)) if g in self.features for j in range(3)}
        return len(hit) / len(ws)

    def worded(self, ws: list[str]) -> bool:
        """Whether two words follow each other as in a template: single words say nothing."""
        return any(g in self.features for g in _grams(ws, 2))

    def looks_like(self, ws: list[str]) -> bool:
        return self.worded(ws) and (1 - self.probabilities(ws)[self.families.index(UNKNOWN)] >= LEAST_LICENCE or self.covered(ws) >= LEAST_COVERED)

    def shared(self, ws: list[str], family: str) -> tuple[float, int]:
        """The largest share of a template's or of the words' own 3-grams that they have in common, and how many are."""
        own = frozenset(_grams(ws, min(3, len(ws)))) if ws else frozenset()
        best, most = 0.0, 0
        for grams in self.known[family].grams:
            both = len(own & grams)
            best, most = max(best, both / len(grams), both / len(own) if len(own) >= 4 else 0.0), max(most, both)
        return best, most

    def call(self, paragraph: str) -> tuple[str, float, float, bool] | None:
        """(family, probability, share in common with a template, confirmed), if the paragraph is a licence's."""
        ws = words_of(paragraph)
        if not self.worded(ws):
            return None
        p = self.probabilities(ws)
        unknown = self.families.index(UNKNOWN)
        if 1 - p[unknown] < LEAST_LICENCE:
            return None
        k = int(np.where(np.arange(len(p)) == unknown, -1.0, p).argmax())
        name, own = self.families[k], self.known[self.families[k]]
        shared, common = self.shared(ws, name)
        sure = p[k] >= LEAST_PROBABILITY and shared >= LEAST_SHARED and not own.foreign & set(ws) and _versions(ws) <= own.versions
        sure = sure and not any(f != name and (other := self.shared(ws, f))[0] >= shared and other[1] >= common for f in self.known)
        return name, float(p[k]), shared, bool(sure)

    def paragraphs(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of each paragraph: neighbouring units of a block that look like a licence."""
        yield from joined((start, end, fresh, self.looks_like(words_of(text[start:end]))) for start, end, fresh in units_of(text))


def joined(units: Iterator[tuple[int, int, bool, bool]]) -> Iterator[tuple[int, int]]:
    """Runs of units (start, end, whether a block begins, whether it looks like a licence)."""
    run: tuple[int, int] | None = None
    for start, end, fresh, like in units:
        if run and (fresh or not like):
            yield run
            run = None
        if like:
            run = (run[0], end) if run else (start, end)
    if run:
        yield run


class Many:
    """Classifier.looks_like() for many units at once: the same sums, from tables of n-grams by word numbers."""

    def __init__(self, model: Classifier):
        self.model = model
        grams = [g for g in model.features if g not in ((), ("",))]
        # 0 is a word of no template, and a place in which no n-gram of a template begins
        self.words = {w: k for k, w in enumerate(sorted({w for g in grams for w in g}), 1)}
        n = len(self.words) + 1
        self.one, self.two = np.zeros(n, np.int32), np.zeros((n, n), np.int32)
        three = {}
        for g in grams:
            ids = [self.words[w] for w in g]
            if len(g) == 1:
                self.one[ids[0]] = model.features[g]
            elif len(g) == 2:
                self.two[ids[0], ids[1]] = model.features[g]
        for g in grams:
            if len(g) == 3:
                three[int(self.two[self.words[g[0]], self.words[g[1]]]) * n + self.words[g[2]]] = model.features[g]
        self.keys = np.array(sorted(three), np.int64)
        self.three = np.array([three[k] for k in self.keys.tolist()], np.int64)

    def alike(self, ids: list[int], sizes: list[int]) -> np.ndarray:
        """Which units, of ``sizes`` words numbered ``ids``, look like a licence."""
        size = np.array(sizes, np.int64)
        unit, w = np.repeat(np.arange(len(size)), size), np.array(ids, np.int64)
        own = self.one[w].astype(np.int64)
        pair = np.where(unit[1:] == unit[:-1], self.two[w[:-1], w[1:]], 0).astype(np.int64)
        triple = np.zeros(max(0, len(w) - 2), np.int64)
        maybe = np.flatnonzero((pair[:-1] > 0) & (unit[2:] == unit[:-2]))
        if maybe.size and self.keys.size:
            key = pair[maybe] * len(self.one) + w[maybe + 2]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            triple[maybe] = np.where(self.keys[at] == key, self.three[at], 0)
        n = len(self.model.features)
        at = np.unique(np.concatenate([k[k > 0] + unit[: len(k)][k > 0] * n for k in (own, pair, triple)]))
        weights = self.model.weights
        out = np.log1p(np.bincount(unit[own == 0], minlength=len(size)))
        z = weights[1] + out[:, None] * weights[0]
        if at.size:
            of = at // n
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            z[of[first]] += np.add.reduceat(weights[at % n], first, axis=0)
        z /= self.model.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        unknown = p[:, self.model.families.index(UNKNOWN)] / p.sum(axis=1)
        hit = np.zeros(len(w) + 2, bool)
        for k in range(3):
            hit[k : k + len(triple)] |= triple > 0
        covered = np.bincount(unit[hit[: len(w)]], minlength=len(size)) / np.maximum(size, 1)
        worded = np.bincount(unit[: len(pair)][pair > 0], minlength=len(size)) > 0
        return worded & ((1 - unknown >= LEAST_LICENCE) | (covered >= LEAST_COVERED))


def _examples(negatives: list[str], rng: np.random.Generator, texts: dict[str, list[str]], known: dict[str, Family]) -> list[tuple[list[str], int]]:
    """(words, family) to learn from; the last family is the unknown one."""
    unknown = len(texts)
    grams = [g for own in known.values() for g in own.grams]
    cleaned = [ws for p in negatives if (ws := words_of(p)) and all(len(frozenset(_grams(ws, 3)) & g) < 0.3 * max(1, len(g)) for g in grams)]
    filler = [w for ws in cleaned for w in ws] or ["lorem", "ipsum", "dolor", "sit", "amet"]
    some = lambda low, high: [filler[i] for i in rng.integers(0, len(filler), rng.integers(low, high))]
    out: list[tuple[list[str], int]] = []
    for k, ts in enumerate(texts.values()):
        for t in ts:
            ws = words_of(t)
            out.append((ws, k))
            for _ in range(12 if len(ws) < 20 else 30):
                own = [w for w in ws if rng.random() > 0.06] or ws
                if len(ws) >= 20 and rng.random() < 0.4:  # a line of a wrapped notice
                    at = int(rng.integers(0, len(own) - 8))
                    own = own[at : at + int(rng.integers(8, 30))]
                if rng.random() < 0.3:
                    own = some(1, 6) + own if rng.random() < 0.5 else own + some(1, 6)
                out.append((own, k))
    plain = sorted({w for ts in texts.values() for t in ts for w in words_of(t)})
    out += [([w], unknown) for w in plain] + [([w, plain[int(rng.integers(0, len(plain)))]], unknown) for w in plain]
    for k in range(600):  # words of templates in no order, and filler
        out.append(([plain[i] for i in rng.integers(0, len(plain), rng.integers(1, 12))] if k % 2 else some(3, 30), unknown))
    near = [words_of(t) for t in NEAR_MISSES]
    for k in range(15 * len(near)):
        out.append(([w for w in near[k % len(near)] if rng.random() > 0.1] or near[k % len(near)], unknown))
    return out + [(ws, unknown) for ws in cleaned]


def train(negatives: list[str], rounds: int = 120, seed: int = 11) -> Classifier:
    """Learn from examples; every fifth only fits the temperature and measures the calibration."""
    known = families_of(TEMPLATES)
    features: dict[Gram, int] = {(): 0, ("",): 1}
    for ts in TEMPLATES.values():
        for t in ts:
            for n in (1, 2, 3):
                for g in _grams(words_of(t), n):
                    features.setdefault(g, len(features))
    model = Classifier([*TEMPLATES, UNKNOWN], features, np.zeros((len(features), len(TEMPLATES) + 1), np.float32), 1.0, known)
    examples = _examples(negatives, np.random.default_rng(seed), TEMPLATES, known)
    of, at, value, y = [], [], [], np.array([k for _, k in examples])
    for i, (ws, _) in enumerate(examples):
        a, v = model.vector(ws)
        of += [i] * len(a)
        at += a
        value += v
    row, col, x = np.array(of), np.array(at), np.array(value, np.float32)

    def scores(some: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The sums of the weights of each of ``some`` examples: all have a feature, so that no stretch is empty."""
        keep = some[row]
        starts = np.flatnonzero(np.concatenate(([True], np.diff(row[keep]) > 0)))
        return np.add.reduceat(x[keep, None] * w[col[keep]], starts, axis=0)

    fitting = np.arange(len(examples)) % 5 > 0
    truth = np.eye(len(model.families), dtype=np.float32)[y]
    keep = fitting[row]
    order = np.argsort(col[keep], kind="stable")
    by_col, place = col[keep][order], (np.cumsum(fitting) - 1)[row[keep][order]]
    starts = np.flatnonzero(np.concatenate(([True], np.diff(by_col) > 0)))
    w, speed = model.weights, np.full(model.weights.shape, 1e-6, np.float32)
    for _ in range(rounds):
        z = scores(fitting, w)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = p / p.sum(axis=1, keepdims=True) - truth[fitting]
        g = 1e-5 * w
        g[by_col[starts]] += np.add.reduceat(x[keep][order][:, None] * p[place], starts, axis=0) / len(p)
        speed += g * g
        w = w - 0.2 * g / np.sqrt(speed)
    model.weights = w.astype(float)
    z, held = scores(~fitting, w), y[~fitting]

    def log_p(t: float) -> np.ndarray:
        q = z / t - (z / t).max(axis=1, keepdims=True)
        return q - np.log(np.exp(q).sum(axis=1, keepdims=True))

    model.temperature = float(min(np.geomspace(0.3, 4, 40), key=lambda t: -log_p(t)[np.arange(len(held)), held].sum()))
    p = np.exp(log_p(model.temperature))
    top, right = p.max(axis=1), p.argmax(axis=1) == held
    bins = np.minimum((top * 10).astype(int), 9)
    model.calibration = float(sum(abs(top[bins == b].mean() - right[bins == b].mean()) * (bins == b).mean() for b in range(10) if (bins == b).any()))
    return model


def fit(docs: DataFrame) -> Classifier:
    """Train with units of a sample of the texts. Units are cut and chosen where the texts lie: the driver gets only
    those that are used."""
    n = max(1, docs.count())
    place = lambda *c: F.pmod(F.xxhash64(F.lit("licence"), *c), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = docs.where((place("doc_id") < NEGATIVE_TEXTS / n) & F.col("text").isNotNull()).select("text")

    def cut(batches):
        for b in batches:
            texts = (t.as_py() for t in b.column(0))
            found = [t[s:e] for t in texts for s, e, _ in units_of(t) if len(words_of(t[s:e])) <= LONGEST]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["unit"])

    units = materialize(map_arrow(chosen, cut, "unit string").distinct(), "units")
    few = units.where(place("unit") < NEGATIVES / max(1, units.count())).collect()
    release(units)
    return train(sorted(r["unit"] for r in few))


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, start, end (characters), family, probability, shared, confirmed of each licence paragraph."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the templates
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("shared", pa.float64()), ("confirmed", pa.bool_())])

    def run(batches):
        own = shared.value
        many = Many(own)
        number = many.words.get
        for b in batches:
            out: list[tuple] = []
            held: list[tuple] = []
            ids: list[int] = []
            sizes: list[int] = []

            def flush():
                alike = many.alike(ids, sizes).tolist() if ids else []
                at = 0
                for doc, text, units in held:
                    like = alike[at : at + len(units)]
                    at += len(units)
                    if any(like):
                        for start, end in joined((*u, x) for u, x in zip(units, like)):
                            if (found := own.call(text[start:end])) is not None:
                                out.append((doc, start, end, *found))
                held.clear(), ids.clear(), sizes.clear()

            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                units = list(units_of(text))
                for start, end, _ in units:
                    ws = words_of(text[start:end])
                    ids.extend([number(w, 0) for w in ws])
                    sizes.append(len(ws))
                held.append((doc, text, units))
                if len(ids) >= AT_ONCE:
                    flush()
            flush()
            columns = list(zip(*out)) if out else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    kinds = "doc_id long, start long, end long, family string, probability double, shared double, confirmed boolean"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, kinds)
