"""License scans: text units compared with licence templates by the Dice coefficient over word bigrams.

Units are a text's lines, its blocks between blank lines, and the text as a whole. Where no unit reaches a template,
windows of the template's length in words are compared, so notices inside a line or over several lines are met. Dice
>= t needs t/(2-t) of the template's bigrams, in the unit and so in the text, so most texts are dropped at once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .license_texts import TEXTS, creative_commons
from .shingles import WORD

# Notices and licence texts, as their publishers word them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "proprietary-notice": "All rights reserved.",
}


#: What the scan looks for: the list above and the rest of the usual licence family.
ALL_TEMPLATES = creative_commons() | TEXTS | TEMPLATES


def words_in(text: str) -> list[str]:
    """Runs of [a-z0-9], A-Z lower-cased."""
    if not text.isascii():
        return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return text.lower().translate(_BLANK).split()


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    """Distinct pairs of consecutive words."""
    words = words_in(text)
    return frozenset(zip(words, words[1:]))


_BLANK = {c: " " for c in range(128) if not chr(c).isalnum()}


def units(text: str) -> list[str]:
    """A text's distinct lines, blocks and whole."""
    lines = text.split("\n")
    blocks, block = [], []
    for line in [*lines, ""]:
        if WORD.search(line):
            block.append(line)
        elif block:
            blocks.append("\n".join(block))
            block = []
    return list(dict.fromkeys([*lines, *blocks, text]))


def windows(pairs: list[tuple[str, str]], starts: list[int], grams: frozenset, span: int, threshold: float) -> list[tuple[int, int, float]]:
    """Disjoint (start, end, Dice) with Dice >= threshold of windows of `span` word pairs (fewer at the end) that begin at starts.

    Of windows that overlap, a better one takes the place of the one before. One pass: a pair enters and leaves once.
    """
    held: Counter = Counter()
    common = lo = hi = 0
    places: list[tuple[int, int, float]] = []
    for s in starts:
        if s >= hi:
            held.clear()
            common, lo, hi = 0, s, s
        for g in pairs[lo:s]:
            held[g] -= 1
            if not held[g]:
                del held[g]
                common -= g in grams
        end = min(s + span, len(pairs))
        for g in pairs[hi:end]:
            if not held[g]:
                common += g in grams
            held[g] += 1
        lo, hi = s, end
        dice = 2 * common / (len(held) + len(grams))
        if dice >= threshold:
            if not places or s >= places[-1][1]:
                places.append((s, end, dice))
            elif dice > places[-1][2]:
                places[-1] = (s, end, dice)
    return places


def unrivalled(places: dict[str, list], name: str) -> list:
    """The places of name of which no other template fits half or more better."""
    kept = []
    for start, end, dice in places[name]:
        rivals = ((s, e, d) for k, found in places.items() if k != name for s, e, d in _from(found, start, end))
        if not any(d > dice and 2 * (min(end, e) - max(start, s)) >= end - start for s, e, d in rivals):
            kept.append((start, end, dice))
    return kept


def _from(found: list, start: int, end: int) -> Iterator:
    """Those of sorted, disjoint places that overlap [start, end)."""
    for i in range(bisect_right(found, start, key=lambda p: p[1]), len(found)):
        if found[i][0] >= end:
            return
        yield found[i]


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """(doc_id, license, dice, n_units): the templates that a document reaches, with the best Dice of each.

    One row per row of docs and template with Dice >= threshold; n_units counts the distinct units that reach it or,
    where none does, the disjoint windows. Licences are alike (versions, variants): those beyond TEMPLATES count only
    where no other fits better. Templates are a dict given by the caller and so of bounded size. Whole texts are read; null or empty
    ones match nothing, nor do units or templates under two words. Repeated rows give repeated rows; an empty table
    gives none; extra columns are ignored.
    """
    known, spans, index = {}, {}, defaultdict(list)
    for name, t in sorted((ALL_TEMPLATES if templates is None else templates).items()):
        if b := bigrams(t):
            known[name], spans[name] = b, len(words_in(t)) - 1
            for g in b:
                index[g].append(name)
    index = dict(index)
    rivals = set() if templates is not None else set(known) - set(TEMPLATES)
    share = threshold / (2 - threshold) - 1e-9

    def reached(grams: frozenset, names: set[str]) -> list[tuple[str, float]]:
        """(name, Dice) of those of names that a unit's bigrams reach."""
        hits = Counter(name for g in grams if g in index for name in index[g])
        found = [(name, 2 * k / (len(grams) + len(known[name]))) for name, k in hits.items() if name in names]
        most = max((dice for _, dice in found), default=0.0)
        return [(name, dice) for name, dice in found if dice >= threshold and (dice == most or name not in rivals)]

    def scan(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
                words = words_in(text)
                pairs = list(zip(words, words[1:]))
                at = defaultdict(list)
                for i, g in enumerate(pairs):
                    if g in index:
                        at[g].append(i)
                hits = Counter(name for g in at for name in index[g])
                names = {name for name, k in hits.items() if k >= share * len(known[name])}
                if not names:
                    continue
                best: dict[str, list] = {}
                least = min(share * len(known[name]) for name in names)
                for unit in units(text):
                    # a word and its blank take two characters at least, so longer units than this may still fit
                    if len(unit) < 2 * least:
                        continue
                    for name, dice in reached(bigrams(unit), names):
                        mine = best.setdefault(name, [0.0, 0])
                        mine[0], mine[1] = max(mine[0], dice), mine[1] + 1
                places = {}
                for name in sorted(names):
                    starts = sorted(i for g in known[name] if g in at for i in at[g])
                    places[name] = windows(pairs, starts, known[name], spans[name], threshold)
                for name in sorted(names - set(best)):
                    if kept := unrivalled(places, name) if name in rivals else places[name]:
                        best[name] = [max(p[2] for p in kept), len(kept)]
                rows += [(doc_id, name, d, n) for name, (d, n) in best.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "dice", "n_units"]).astype({"doc_id": "Int64"})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return texts.mapInPandas(scan, "doc_id long, license string, dice double, n_units long")
