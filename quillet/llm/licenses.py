"""License scans: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment confirms them.

Words are runs of ASCII letters and digits or of characters beyond ASCII, A-Z as a-z. A template's fingerprints are, of each `window`
consecutive hashes of `gram` words, the least (the last of equals), so any stretch of window + gram - 1 words shared with a text holds one. Both are at most GRAM and WINDOW and small
enough that a text which has `coverage` of the template's words, others in place of the rest, shares a fingerprint: n words of which e differ have e + 1 equal
stretches, the longest of (n - e) / (e + 1) words or more. Texts look up all their hashes. Hits of a template on nearby diagonals make a candidate,
which is aligned word by word in a band of BAND (a quarter of the template at most) around its diagonals (matches count one, gaps and mismatches nothing; ties prefer the
start of the text), unless the words that both have, counted, are too few for any alignment. Where a template's candidates are too small alone, neighbours that are no further apart than the template is long are
aligned as one, so a notice with a sentence put in is found whole. A match reports matched words, coverage (matched words of the template's words) and the byte span from
the first to the last matched word. Of matches that overlap, those with more matched words stay, then the earlier, then by template name.

Null and empty texts give no rows. Rows that repeat give their matches again, null ids too. Texts of any length are taken whole; other columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.bytesview import IS_ALNUM, U, slices, windows, words

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 12, 0.8
BITS = 20

# The wording of public license notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "bsd-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def tokens(text: str) -> tuple[list[bytes], np.ndarray]:
    for t in slices(pa.array([text], pa.string())):
        starts, ends, hashes, _ = words(t, IS_ALNUM)
        low = t.buf.tobytes().lower()
        return [low[a:b] for a, b in zip(starts, ends, strict=True)], hashes
    return [], np.zeros(0, U)


def fingerprints(hashes: np.ndarray, gram: int, window: int, coverage: float = COVERAGE) -> tuple[int, list[tuple[int, int]]]:
    """Words of a gram, and (hash, place) of the winnowed grams."""
    count = len(hashes)
    differ = int(count * (1 - coverage) + 1e-9)
    stretch = -(-(count - differ) // (differ + 1))  # equal words that follow each other, at least
    size = max(1, min(gram, stretch))
    h = windows(hashes, size)[: count - size + 1].tolist()
    width = max(1, min(window, stretch - size + 1))
    places = {max(range(k, k + width), key=lambda i: (-h[i], i)) for k in range(len(h) - width + 1)}
    return size, sorted((h[i], i) for i in places)


class Index:
    """The inverted index of all templates. Templates are a parameter; they and their index are small and go to every task."""

    def __init__(self, templates: dict[str, str], gram: int, window: int, coverage: float = COVERAGE):
        self.names = sorted(templates)
        self.words, self.counts, self.lists = [], [], defaultdict(list)
        for number, name in enumerate(self.names):
            own, hashes = tokens(templates[name])
            self.words.append(own)
            self.counts.append(Counter(own))
            if own:
                size, marks = fingerprints(hashes, gram, window, coverage)
                for h, place in marks:
                    self.lists[size, h].append((number, place))
        self.sizes = sorted({size for size, _ in self.lists})
        self.sieve = {size: np.zeros(1 << BITS, bool) for size in self.sizes}
        for size, h in self.lists:
            self.sieve[size][h >> (64 - BITS)] = True


def align(template: list[bytes], text: list[bytes], low: int, high: int) -> tuple[int, int, int]:
    """Most matched words with text place minus template place within low..high; and the text places of the first and last match."""
    width = high - low + 1
    # cell: (matches, -first place, -last place), so that among equals the earlier start and end win
    above = [(0, 0, 0)] * (width + 1)
    for i, word in enumerate(template):
        row: list[tuple[int, int, int]] = []
        left = (0, 0, 0)
        for k in range(width):
            j = i + low + k
            cell = max(above[k + 1], left)  # the template's word, or the text's, is passed over
            if 0 <= j < len(text) and text[j] == word:
                n, first, _ = above[k]
                cell = max(cell, (n + 1, first if n else -j, -j))
            row.append(cell)
            left = cell
        above = [*row, (0, 0, 0)]
    n, first, last = max(above)
    return n, -first, -last


def candidates(hits: list[tuple[int, int]], band: int) -> Iterator[list[tuple[int, int]]]:
    """hits: (text place, template place). Groups those whose template starts are within the band of their neighbours'."""
    hits = sorted(hits, key=lambda x: x[0] - x[1])
    group: list[tuple[int, int]] = []
    for hit in hits:
        if group and (hit[0] - hit[1]) - (group[-1][0] - group[-1][1]) > band:
            yield group
            group = []
        group.append(hit)
    if group:
        yield group


def scan(index: Index, hits: dict[int, list[tuple[int, int]]], text: list[bytes], coverage: float, band: int) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, last word) of the accepted matches of one text."""
    found = []

    def accept(number: int, least: int, most: int, near: int) -> bool:
        """Align a template along the diagonals least..most."""
        template = index.words[number]
        lo = max(0, least - near)
        piece = text[lo : most + len(template) + near]
        if (Counter(piece) & index.counts[number]).total() < coverage * len(template):
            return False
        n, first, last = align(template, piece, least - lo - near, most - lo + near)
        if n >= coverage * len(template):
            found.append((number, n, lo + first, lo + last))
            return True
        return False

    for number, own in hits.items():
        size = len(index.words[number])
        near = min(band, size // 4)  # so that a short notice said twice in a row is two
        step = max(1, 2 * near)
        alone: list[tuple[int, int]] = []
        for group in candidates(own, near):
            starts = [a - b for a, b in group]
            good = False
            # a chain of diagonals longer than the band is cut: each part is aligned with its own band
            for low in range(min(starts), max(starts) + 1, step):
                part = [s for s in starts if low <= s < low + step]
                if part:
                    good |= accept(number, min(part), max(part), near)
            if not good:
                alone.append((min(starts), max(starts)))
        for (a, b), (c, d) in zip(alone, alone[1:], strict=False):
            if d - a <= size:
                accept(number, a, d, near)
    found.sort(key=lambda x: (-x[1], x[2], index.names[x[0]]))
    out: list[tuple[int, int, int, int]] = []
    for x in found:
        if not any(x[2] <= y[3] and y[2] <= x[3] for y in out):
            out.append(x)
    return sorted(out, key=lambda x: x[2])


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text: str = "text", coverage: float = COVERAGE, gram: int = GRAM, window: int = WINDOW, band: int = BAND) -> DataFrame:
    """id_col, template, matched_words, template_words, coverage, begin and end (UTF-8 bytes): a row for each match."""
    opened: list[Index] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not opened:
            opened.append(Index(templates, gram, window, coverage))
        index = opened[0]
        for batch in batches:
            rows = []
            for t in slices(batch.column(1)):
                starts, ends, hashes, doc = words(t, IS_ALNUM)
                hits: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
                for size in index.sizes:
                    if len(hashes) < size:
                        continue
                    h = windows(hashes, size)[: len(hashes) - size + 1]
                    fit = index.sieve[size][h >> U(64 - BITS)] & (doc[: len(h)] == doc[size - 1 :])
                    for k in np.flatnonzero(fit).tolist():
                        for number, place in index.lists.get((size, int(h[k])), ()):
                            hits[int(doc[k])][number].append((k, place))
                if not hits:
                    continue
                low = t.buf.tobytes().lower()
                for i in sorted(hits):
                    a, b = np.searchsorted(doc, [i, i + 1])
                    own = [low[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                    local = {n: [(k - int(a), p) for k, p in v] for n, v in hits[i].items()}
                    for number, n, first, last in scan(index, local, own, coverage, band):
                        size = len(index.words[number])
                        rows.append((t.lo + i, index.names[number], n, size, n / size, int(starts[a + first] - t.offs[i]), int(ends[a + last] - t.offs[i])))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))], names=["id", "template", "matched_words", "template_words", "coverage", "begin", "end"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), text).mapInArrow(run, f"id {kind}, template string, matched_words bigint, template_words bigint, coverage double, begin bigint, end bigint")
    return found.withColumnRenamed("id", id_col)
