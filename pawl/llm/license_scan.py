"""Licence notices in texts, by Dice coefficients over word bigrams."""

from __future__ import annotations

import bisect
import re
from collections.abc import Sequence
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pawl.llm.common import map_texts

#: Short notices (licence, text).
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License)"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def gnu(kind: str, license: str, version: str) -> list[str]:
    """The header that a GNU licence asks for: its first paragraph, and all of it."""
    grant = f"This {kind} is free software: you can redistribute it and/or modify it under the terms of the GNU {license} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    hope = f"This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {license} for more details."
    copy = f"You should have received a copy of the GNU {license} along with this {kind}."
    return [grant, f"{grant} {hope} {copy}"]


#: Standard headers (licence, text).
HEADERS = [
    *(("GPL-2.0", text) for text in gnu("program", "General Public License", "2")),
    *(("GPL-3.0", text) for text in gnu("program", "General Public License", "3")),
    *(("LGPL-2.0", text) for text in gnu("library", "Library General Public License", "2")),
    *(("LGPL-2.1", text) for text in gnu("library", "Lesser General Public License", "2.1")),
    *(("LGPL-3.0", text) for text in gnu("library", "Lesser General Public License", "3")),
    *(("AGPL-3.0", text) for text in gnu("program", "Affero General Public License", "3")),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MPL-1.1",
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'https://www.mozilla.org/MPL/ Software distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. '
        "See the License for the specific language governing rights and limitations under the License.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
]


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the files beside this module, and what they grant without the disclaimer if that is short."""
    out = []
    for file in sorted(resources.files("pawl.llm.licenses").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            name, text = file.name.removesuffix(".txt"), file.read_text(encoding="utf-8")
            out.append((name, text))
            if name in GRANTS:
                out.append((name, text[: text.index("THE SOFTWARE IS PROVIDED" if "THE SOFTWARE IS PROVIDED" in text else "THIS SOFTWARE IS PROVIDED")]))
    return out


#: Licences whose first part alone names them; their disclaimers are shared with others.
GRANTS = ("BSD-2-Clause", "BSD-3-Clause", "MIT")


def all_templates() -> list[tuple[str, str]]:
    """Notices, standard headers and full texts."""
    return NOTICES + HEADERS + full_texts()


WORDS = re.compile(r"[^\W_]+")
PARAGRAPHS = re.compile(r"\n\s*\n")


def bigrams(text: str) -> set[tuple[str, str]]:
    """Distinct pairs of neighbouring words, lower-cased; a single word pairs with nothing."""
    words = WORDS.findall(text.lower())
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else {(w, "") for w in words}


class Templates:
    """Templates by number of bigrams, and by bigram."""

    def __init__(self, templates: Sequence[tuple[str, str]], percent: int):
        kept = sorted({(frozenset(bigrams(text)), name) for name, text in templates if name and text}, key=lambda t: (len(t[0]), t[1], sorted(t[0])))
        kept = [t for t in kept if t[0]]
        self.percent = percent
        self.grams = [grams for grams, _ in kept]
        self.sizes = [len(grams) for grams, _ in kept]
        self.names = [name for _, name in kept]
        self.by_gram: dict[tuple[str, str], list[int]] = {}
        for k, (grams, _) in enumerate(kept):
            for gram in grams:
                self.by_gram.setdefault(gram, []).append(k)
        #: sizes of a unit within which its Dice with some template can reach the limit
        reach = (200 - percent) / percent
        self.least = self.sizes[0] / reach if kept else 1.0
        self.most = self.sizes[-1] * reach if kept else 0.0
        #: a unit of one word has a pair that no longer text has
        self.single = any(gram[1] == "" for gram in self.by_gram)

    def possible(self, pairs: set[tuple[str, str]]) -> list[int]:
        """Templates of which a text with these pairs holds enough for some window or unit to match."""
        common: dict[int, int] = {}
        for gram in pairs:
            for k in self.by_gram.get(gram, ()):
                common[k] = common.get(k, 0) + 1
        # Dice counts common + size of the unit, which is common at least
        return sorted(k for k, n in common.items() if (200 - self.percent) * n >= self.percent * self.sizes[k])

    def windows(self, pairs: list[tuple[str, str]], possible: Sequence[int], taken: Sequence[tuple[int, int, int]] = ()) -> list[tuple[int, int, str, int, int]]:
        """(2 * common, sum of sizes, licence, begin, end) of runs of pairs that match a template.

        Each possible template gives, for each pair of its own, the best of all runs that end there.
        Of these the highest Dice counts first, and takes the template's pairs in its run; another
        counts if the pairs that are not taken still reach the limit. taken holds (template, begin,
        end) of runs that are known.
        """
        number: dict[tuple[str, str], int] = {}
        ids = np.fromiter((number.setdefault(g, len(number)) for g in pairs), "i8", len(pairs))
        before = np.full(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        same = ids[order[1:]] == ids[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        own = {}
        for k in {*possible, *(k for k, _, _ in taken)}:
            inside = np.zeros(len(number), bool)
            inside[[number[g] for g in self.grams[k] if g in number]] = True
            own[k] = inside[ids]
        claimed = np.zeros(len(ids), bool)
        for k, begin, end in taken:
            claimed[begin:end] |= own[k][begin:end]
        found = []
        for k in possible:
            for begin, end in self.regions(np.flatnonzero(own[k]), ids, self.sizes[k]):
                found += [(n, size, self.names[k], a + begin, b + begin, k) for n, size, a, b in self.runs(own[k][begin:end], before[begin:end] - begin, self.sizes[k])]
        found.sort(key=lambda x: (-x[0] / x[1], -x[0], x[2], x[3], x[4]))
        out = []
        for n, size, name, begin, end, k in found:
            left = own[k][begin:end] & ~claimed[begin:end]
            if 200 * int(left.sum()) >= self.percent * size and 200 * len(np.unique(ids[begin:end][left])) >= self.percent * size:
                claimed[begin:end] |= own[k][begin:end]
                out.append((n, size, name, begin, end))
        return out

    def regions(self, hits: np.ndarray, ids: np.ndarray, size: int):
        """Bounds of stretches that no matching run leaves: a run has fewer foreign pairs than between them."""
        foreign = size * (200 - self.percent) / self.percent - size
        cuts = [k for k in np.flatnonzero(np.diff(hits) - 1 > foreign).tolist() if len(np.unique(ids[hits[k] + 1 : hits[k + 1]])) > foreign]
        bounds = [0, *(k + 1 for k in cuts), len(hits)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if (200 - self.percent) * (b - a) >= self.percent * size:
                yield int(hits[a]), int(hits[b - 1]) + 1

    def runs(self, own: np.ndarray, before: np.ndarray, size: int):
        """(2 * common, sum of sizes, begin, end) of the best run that ends at each pair of the template, if it matches.

        common and number hold the distinct pairs of the runs from each place to the current one; a
        pair adds to those that begin after its last occurrence.
        """
        common, number = np.zeros(len(own), "i8"), np.zeros(len(own), "i8")
        most, low = size * (200 - self.percent) // self.percent, 0
        for at, (mine, last) in enumerate(zip(own.tolist(), before.tolist(), strict=True)):
            since = max(last + 1, low)
            number[since : at + 1] += 1
            while number[low] > most:
                low += 1
            if mine:
                common[since : at + 1] += 1
                dice = common[low : at + 1] / (size + number[low : at + 1])
                # of equal ones the shortest
                k = at - int(dice[::-1].argmax())
                n, total = int(common[k]), size + int(number[k])
                if 200 * n >= self.percent * total:
                    yield 2 * n, total, k, at + 1

    def best(self, unit: str) -> tuple[int, int, str, int] | None:
        """(2 * common, sum of sizes, licence, template) of the highest Dice that reaches the limit.

        Dice is 2 * common / (a + b) and common is min(a, b) at most, so only templates of sizes
        between a * p / (200 - p) and a * (200 - p) / p are counted.
        """
        grams = bigrams(unit)
        size = len(grams)
        if not self.least <= size <= self.most:
            return None
        low = bisect.bisect_left(self.sizes, size * self.percent / (200 - self.percent))
        high = bisect.bisect_right(self.sizes, size * (200 - self.percent) / self.percent)
        if low >= high:
            return None
        common: dict[int, int] = {}
        for gram in grams:
            for k in self.by_gram.get(gram, ()):
                if low <= k < high:
                    common[k] = common.get(k, 0) + 1
        found = None
        for k, n in sorted(common.items()):
            if 200 * n >= self.percent * (size + self.sizes[k]):
                entry = (2 * n, size + self.sizes[k], self.names[k], k)
                if found is None or entry[0] * found[1] > found[0] * entry[1] or (entry[0] * found[1] == found[0] * entry[1] and entry[2] < found[2]):
                    found = entry
        return found


def places(text: str):
    """The whole text, its paragraphs and its lines, each once, with the number of words before it."""
    yield 0, text
    lines = text.split("\n")
    if len(lines) > 1:
        for parts, sign in ((PARAGRAPHS.split(text), "\n"), (lines, "")):
            at = 0
            for part in parts if len(parts) > 1 else ():
                if sign in part:
                    yield at, part
                at += len(WORDS.findall(part))


def notices(text: str, own: Templates, windows: bool) -> list[tuple[int, int, str]]:
    """(2 * common, sum of sizes, licence) of all units that match and, if asked, of further runs of words."""
    text = text.lower()
    words = WORDS.findall(text)
    pairs = list(zip(words, words[1:], strict=False))
    possible = own.possible(set(pairs))
    if not possible and not own.single:
        return []
    found, taken = [], []
    for at, unit in places(text):
        hit = own.best(unit)
        if hit is not None:
            found.append(hit[:3])
            taken.append((hit[3], at, at + max(1, len(WORDS.findall(unit)) - 1)))
    if windows and possible:
        found += [x[:3] for x in own.windows(pairs, possible, [t for t in taken if t[1] < len(pairs)])]
    return found


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = NOTICES, percent: int = 80, text_col: str = "text", carry: Sequence[str] | None = None, windows: bool = False) -> DataFrame:
    """Append licenses (sorted), n_notices, best_license and best_dice for each whole text.

    The whole text, its paragraphs and its lines are compared with every template whose size allows
    a Dice coefficient of percent / 100 over distinct word bigrams, words being runs of letters and
    digits in lower case. With windows, so is every run of words, wherever it begins and ends: a notice
    within a longer line or over several lines counts, unless a better match explains its words.
    n_notices counts the lines, paragraphs and whole texts that match, and further windows; ties of
    the best go to the first name. A null or empty text matches nothing; repeated rows each get a
    row; an empty table gives none; input columns of these names give way. Templates are few and
    held by every task: they are a list of the caller's, not a table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Templates(list(templates), percent))

    def make():
        own = sent.value
        def work(texts: list[str | None]):
            names, counts, best_names, best_values = [], [], [], []
            for text in texts:
                found, number, best = set(), 0, None
                for hit in notices(text, own, windows) if text else ():
                    found.add(hit[2])
                    number += 1
                    if best is None or hit[0] * best[1] > best[0] * hit[1] or (hit[0] * best[1] == best[0] * hit[1] and hit[2] < best[2]):
                        best = hit
                names.append(sorted(found))
                counts.append(number)
                best_names.append(best[2] if best else None)
                best_values.append(best[0] / best[1] if best else None)
            return names, counts, best_names, best_values

        return work

    outputs = [
        ("licenses", T.ArrayType(T.StringType()), pa.list_(pa.string())),
        ("n_notices", T.LongType(), pa.int64()),
        ("best_license", T.StringType(), pa.string()),
        ("best_dice", T.DoubleType(), pa.float64()),
    ]
    return map_texts(docs, text_col, outputs, make, carry)


def flat(found: DataFrame) -> DataFrame:
    """scan()'s list of licences as one comma-joined string."""
    return found.withColumn("licenses", F.array_join("licenses", ","))
