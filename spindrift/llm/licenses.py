"""License scans by patience alignment.

Words of a text and of a template (letters and digits, lower case, punctuation aside) are aligned:
the common beginning and end first, then words that are unique to both as anchors, of which the
longest increasing subsequence stays, then the same in every gap between anchors.  Coverage is the
part of the template's words that are matched.

A template can only be covered where enough of its words stand close together, so a vectorised count
of hits picks the windows of each whole text that are worth aligning; nothing else is skipped.  Windows
are half as long again as the template and begin a quarter of its length apart; each is aligned once, so
work grows with the text, however many notices it holds.
Every number in a template has to be matched: another version is another license; and templates of
fewer than SHORT words have to be matched in full, as the one word that is missing may be the name.
All matches of all windows and templates are put in order once: of those that overlap the one with the
most matched words stays, then the one with more coverage, then the shorter.

Defined results: a null or empty text has no match; repeated rows are scanned each; a notice that
stands twice is found twice; ties go to the earlier place, then to the template's name; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.wordscan import LOWER, Texts, slices, texts_of

MIN_COVERAGE = 0.8
SHORT = 10

#: Notices as licensors print them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-permission": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions""",
    "BSD-conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MIT-warranty": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES""",
    "BSD-3-endorsement": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software")
to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software""",
    "LGPL-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation""",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-GPL-3.0": "SPDX-License-Identifier: GPL-3.0",
    "all-rights-reserved": "All rights reserved.",
    "copyright-all-rights-reserved": "Copyright. All rights reserved.",
}

#: Bytes of words here: letters, digits and whatever isn't ASCII.
IS_PLAIN = np.zeros(256, dtype=bool)
IS_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

SCHEMA = "doc_id long, license string, first_word long, n_words long, first_byte long, end_byte long, matched int, coverage double"


def _longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back[i] = at[k - 1] if k else -1
        tails[k : k + 1] = [v]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched places (in the text, in the template), rising in both."""
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
        once = {w for w, n in Counter(text[a:b]).items() if n == 1} & {w for w, n in Counter(template[c:d]).items() if n == 1}
        if not once:
            continue
        place = {w: i for i, w in enumerate(template[c:d], c) if w in once}
        anchors = [(i, place[w]) for i, w in enumerate(text[a:b], a) if w in once]
        anchors = [anchors[i] for i in _longest_increasing([p[1] for p in anchors])]
        out.extend(anchors)
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo.extend((p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(edges, edges[1:], strict=False))
    return sorted(out)


def window(size: int) -> int:
    """Words of a text that are aligned with a template of that size."""
    return size + size // 2 + 2


class Scanner:
    def __init__(self, templates: dict[str, str], min_coverage: float):
        self.min_coverage = min_coverage
        self.templates, vocabularies = [], []
        for name in sorted(templates):
            t = texts_of(pa.array([templates[name]])).lowered().words(IS_PLAIN)
            words = t.word_hashes()
            numbers = [i for i, (s, e) in enumerate(zip(t.starts, t.ends, strict=True)) if bytes(t.data[s:e]).isdigit()]
            if len(words):
                vocabularies.append(np.unique(words))
                self.templates.append((name, words.tolist(), len(words) if len(words) < SHORT else max(1, -int(-min_coverage * len(words) // 1)), set(numbers)))

        # all words that any template has, and for each template which of them are its own
        self.vocabulary = np.unique(np.concatenate(vocabularies)) if vocabularies else np.zeros(0, dtype=np.uint64)
        self.mine = [np.isin(self.vocabulary, v) for v in vocabularies]

    def _matches(self, words: list[int], template: list[int], need: int, numbers: set[int], starts: list[int]) -> set[tuple[int, int, int]]:
        """(matched, first, end) of the windows of words that begin at starts and cover the template."""
        span = window(len(template))
        out = set()

        def put(at: int) -> list[tuple[int, int]]:
            pairs = align(words[at : at + span], template)
            if len(pairs) < need or (numbers and not numbers <= {j for _, j in pairs}):
                return []
            out.add((len(pairs), at + pairs[0][0], at + pairs[-1][0] + 1))
            return pairs

        for at in starts:
            if pairs := put(at):
                # and once more from where most of the words say that the notice begins
                begin = at + Counter(i - j for i, j in pairs).most_common(1)[0][0]
                if begin != at and begin >= 0:
                    put(begin)
        return out

    def scan(self, t: Texts, step: int | None = None) -> list[tuple[int, str, int, int, int, int, int, float]]:
        """(text, license, first word, words, first byte, end byte, matched, coverage) of all matches."""
        t.words(IS_PLAIN)
        h = t.word_hashes()
        first = np.searchsorted(t.doc, np.arange(t.n + 1))
        found: dict[int, list[tuple[int, int, int, str, int]]] = {}
        if not len(self.vocabulary):
            return []
        slot = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        place = np.flatnonzero(self.vocabulary[slot] == h)  # words that any template has
        slot = slot[place]
        for (name, template, need, numbers), mine in zip(self.templates, self.mine, strict=True):
            size = len(template)
            hits = place[mine[slot]]
            if len(hits) < need:
                continue
            # texts that have enough hits close together
            last = hits[need - 1 :]
            close = (last - hits[: len(last)] < window(size)) & (t.doc[last] == t.doc[hits[: len(last)]])
            for d in np.unique(t.doc[last[close]]).tolist():
                lo, hi = int(first[d]), int(first[d + 1])
                # windows begin a step apart and have to hold enough hits
                at = np.arange(lo, hi, step or max(1, size // 4))
                held = np.searchsorted(hits, np.minimum(at + window(size), hi)) - np.searchsorted(hits, at)
                got = self._matches(h[lo:hi].tolist(), template, need, numbers, (at[held >= need] - lo).tolist())
                found.setdefault(d, []).extend((-m, lo + s, lo + e, name, size) for m, s, e in got)
        out = []
        for d in sorted(found):
            begins: list[int] = []
            ends: list[int] = []
            for m, s, e, name, size in sorted(found[d], key=lambda f: (f[0], f[4], f[2] - f[1], *f[1:4])):
                # those taken don't overlap, so the neighbours tell
                i = bisect_left(begins, s)
                if (i and ends[i - 1] > s) or (i < len(begins) and begins[i] < e):
                    continue
                begins.insert(i, s)
                ends.insert(i, e)
                base, zero = int(first[d]), int(t.offsets[d])
                out.append((d, name, s - base, e - s, int(t.starts[s]) - zero, int(t.ends[e - 1]) - zero, -m, -m / size))
        return out


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """SCHEMA rows, one for each license notice in documents(doc_id, text); bytes are places in the UTF-8 text."""
    templates = TEMPLATES if templates is None else templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_coverage)
        for batch in batches:
            for part in slices(batch, "text"):
                t = texts_of(part.column("text"))
                rows = scanner.scan(Texts(LOWER[t.data], t.offsets))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, SCHEMA)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
