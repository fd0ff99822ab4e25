"""License scan by patience alignment.

Text and template are lists of lower-case words. Words unique in both are anchors; the longest increasing subsequence of
their places is kept, and the gaps between anchors, where more words are unique, are aligned in the same way. The share
of a template's words that are aligned is its coverage.

A text is first aligned whole. Where a notice is repeated, no word of it is unique; then the surroundings of each place
of the template's rarest word are aligned on their own and the best is taken. Licenses differ in single words, so those
that tell one from another (its name, a clause, its version) must be among the aligned ones, and a template of fewer than
``SHORT`` words must be there in full, word after word. Of templates found in overlapping places the one with the most
aligned words is told. Rows are independent: there is no shuffle. A text is left out early only if it lacks so many
template words that no coverage over the bound is possible.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgraph.llm.common import table

# Opening words of common licenses and usual short notices. Callers may pass their own.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mit-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
}
# Words of a template that tell its license from others. Short templates are there in full anyway.
TELLING = {
    "apache-2.0-header": "apache license version 2 0",
    "gpl-header": "gnu general public license version 3",
    "lgpl-header": "gnu lesser general public license version 3",
    "bsd-3-clause": "neither name endorse promote",
    "isc": "fee granted",
    "mit-text": "free charge",
    "mit-full": "free charge noninfringement",
    "mpl-2.0-header": "mozilla public license 2 0",
}
# Other ways in which notices and identifiers name a license, as words side by side.
FORMS = {
    "mit": ["MIT License", "MIT licence", "MIT licensed", "License: MIT", "License-Identifier: MIT"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache licence, version 2.0", "Apache 2.0 license", "Apache 2.0 licensed", "Apache-2.0"],
    "gpl-3.0": ["GPLv3", "GPL v3", "GPL-3.0", "GPL version 3", "GNU General Public License, version 3", "GNU General Public License v3", "GNU General Public Licence, version 3"],
    "gpl-2.0": ["GPLv2", "GPL v2", "GPL-2.0", "GPL version 2", "GNU General Public License, version 2", "GNU General Public License v2", "GNU General Public Licence, version 2"],
    "lgpl-3.0": ["LGPLv3", "LGPL v3", "LGPL-3.0", "GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3"],
    "mpl-2.0": ["MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0"],
    "bsd-2-clause": ["BSD 2-Clause", "2-clause BSD", "two-clause BSD"],
    "bsd-3-clause": ["BSD 3-Clause", "3-clause BSD", "three-clause BSD", "new BSD license"],
    "isc": ["ISC License", "License-Identifier: ISC"],
    "cc-by-4.0": ["CC BY 4.0", "CC-BY v4.0", "Creative Commons Attribution 4.0"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0", "Creative Commons Attribution Share Alike 4.0"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution Non Commercial 4.0"],
}
# Words that, up to four words before a short notice, turn it into its opposite.
DENIALS = {"not", "never", "no", "without", "nor", "neither"}
SHORT = 16
WORD = re.compile(r"[^\W_]+", re.UNICODE)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    piles: list[int] = []
    tops: list[int] = []
    back = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        back[i] = piles[k - 1] if k else -1
        tops[k : k + 1] = [p]
        piles[k : k + 1] = [i]
    out = []
    i = piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned places (text, template), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        wanted = set(template[c:d])
        seen: dict[str, int] = {}
        for i in range(a, b):
            if text[i] in wanted:
                seen[text[i]] = -1 if text[i] in seen else i
        counts = Counter(template[c:d])
        anchors = [(seen[w], j) for j, w in enumerate(template[c:d], c) if counts[w] == 1 and seen.get(w, -1) >= 0]
        kept = [anchors[k] for k in increasing([i for i, _ in anchors])]
        out += kept
        if kept:
            edges = [(a - 1, c - 1), *kept, (b, d)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


def compact(pairs: list[tuple[int, int]], slack: int) -> list[tuple[int, int]]:
    """The run of aligned places with the most members in which the text skips at most ``slack`` words at once."""
    best: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []
    for p in pairs:
        if run and p[0] - run[-1][0] - 1 > slack:
            run = []
        run.append(p)
        if len(run) > len(best):
            best = list(run)
    return best


def covered(text: list[str], template: list[str], least: float, slack: int = 12) -> list[tuple[int, int]]:
    """The best run of aligned places: of the whole text, or around a place of the template's rarest word."""
    found = compact(align(text, template), slack)
    if len(found) < least * len(template):
        counts = Counter(w for w in text if w in set(template))
        rare = min((w for w in set(template) if counts[w]), key=lambda w: (counts[w], w), default=None)
        for i in [i for i, w in enumerate(text) if w == rare]:
            for j in [j for j, w in enumerate(template) if w == rare]:
                a = max(0, i - j - slack)
                here = compact(align(text[a : i - j + len(template) + slack], template), slack)
                if len(here) > len(found):
                    found = [(x + a, y) for x, y in here]
            if len(found) == len(template):
                break
    return found


class Template:
    """The words of a notice, the share of them that must align, and places of which each word needs one aligned."""

    def __init__(self, text: str, least: float, telling: str = ""):
        self.words = words(text)
        self.short = len(self.words) < SHORT
        self.least = 1.0 if self.short else least
        self.telling = [{j for j, w in enumerate(self.words) if w == t} for t in words(telling)]

    def find(self, text: list[str]) -> tuple[int, int, int] | None:
        """Aligned words, first and end word in the text; a short notice that is denied is passed over."""
        if self.short:
            begin = 0
            while found := covered(text[begin:], self.words, self.least, 0):
                if len(found) < len(self.words):
                    return None
                first, end = begin + found[0][0], begin + found[-1][0] + 1
                if not DENIALS & set(text[max(0, first - 4) : first]):
                    return len(found), first, end
                begin = end
            return None
        found = covered(text, self.words, self.least, 12)
        there = {j for _, j in found}
        if not found or len(found) < self.least * len(self.words) or not all(t & there for t in self.telling):
            return None
        return len(found), found[0][0], found[-1][0] + 1


def told(text: list[str], templates: dict[str, Template]) -> list[tuple[str, float, int, int]]:
    """(name, coverage, first word, end word) of the templates found, by place."""
    have = set(text)
    found = []
    for name, t in templates.items():
        if sum(w in have for w in t.words) >= t.least * len(t.words) and (got := t.find(text)):
            found.append((-got[0], name.split("#")[0], got[1], got[2], got[0] / len(t.words)))
    kept: list[tuple[str, float, int, int]] = []
    for _, name, a, b, share in sorted(found):
        # another form of a license that is told already adds nothing
        if all(b <= c or d <= a for _, _, c, d in kept) and all(name != k for k, *_ in kept):
            kept.append((name, share, a, b))
    return sorted(kept, key=lambda k: k[2])


def _scan(batches, templates: dict[str, Template]):
    for batch in batches:
        out = [(i, *x) for i, text in enumerate(batch.column("text").to_pylist()) for x in told(words(text), templates)]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["doc_id", "license", "coverage", "first_word", "end_word"])


def known(least: float = 0.8) -> dict[str, Template]:
    """The templates of this module, with their other forms as name#number."""
    forms = {f"{k}#{i}": Template(t, least) for k, ts in FORMS.items() for i, t in enumerate(ts)}
    return {k: Template(t, least, TELLING.get(k, "")) for k, t in TEMPLATES.items()} | forms


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, telling: dict[str, str] | None = None) -> DataFrame:
    """``(doc_id, license, coverage, first_word, end_word)`` for each template covered by ``least`` or more.

    Words are runs of letters and digits in lower case, and places count words. A template's words in ``telling`` must be
    among the aligned ones; one of fewer than ``SHORT`` words is covered in full, without words between. Of overlapping
    finds the one with the most aligned words stays, then the first by name; of several places of one template the best,
    then the first. Short notices behind a denial are passed over; a license is told once, by the form with the most
    words. Null and empty texts, and templates without words, give no row; repeated rows and rows of a null id
    are told each; other columns are ignored.
    """
    parts = known(least) if templates is None else {k: Template(t, least, (telling or {}).get(k, "")) for k, t in templates.items()}
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(partial(_scan, templates={k: t for k, t in parts.items() if t.words}), f"doc_id {dict(docs.dtypes)['doc_id']}, license string, coverage double, first_word long, end_word long")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op5_licenses": op5_licenses}
SQL: dict = {}
