"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as K
from .common import shipped

# Public notices and headers, as (license, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("proprietary", "All rights reserved."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. You should have received a copy of the CC0 Public Domain Dedication along with this work."),
)
MATCH, MISS, GAP = 2, -1, -1


def winnow(prints: np.ndarray, window: int) -> np.ndarray:
    """Places of the least fingerprint (the last of equals) of each window of `window` fingerprints."""
    if len(prints) <= window:
        return np.array([int(np.flatnonzero(prints == prints.min())[-1])]) if len(prints) else np.zeros(0, int)
    v = np.lib.stride_tricks.sliding_window_view(prints, window)[:, ::-1]
    return np.unique(np.arange(len(v)) + window - 1 - v.argmin(1))


def align(a: np.ndarray, windows: np.ndarray, band: int) -> list[tuple[int, int, int]]:
    """The best local alignment of template a with each row of windows: (words matched, first and past-the-last place).

    A row has len(a) + 2 * band words of a text (0 beyond its ends), of which those at i to i + 2 * band may stand
    against a[i]. All rows are filled at once, a word of the template at a time."""
    n, width = len(windows), 2 * band + 1
    score = np.zeros((n, width + 2), np.int32)
    moves = np.zeros((len(a) + 1, n, width + 2), np.int8)
    best, at = np.zeros(n, np.int32), np.zeros((n, 2), np.int64)
    step = np.arange(width, dtype=np.int32) * GAP
    for i in range(1, len(a) + 1):
        diagonal = score[:, 1:-1] + np.where(windows[:, i - 1 : i - 1 + width] == a[i - 1], MATCH, MISS)
        down = score[:, 2:] + GAP
        # A gap in the template goes on from any place before it in the row.
        row = np.maximum.accumulate(np.maximum(np.maximum(diagonal, down), 0) - step, axis=1) + step
        moves[i, :, 1:-1] = np.where(row <= 0, 0, np.where(row == diagonal, 1, np.where(row == down, 2, 3)))
        score = np.zeros((n, width + 2), np.int32)
        score[:, 1:-1] = row
        top = row.argmax(1)
        better = row[np.arange(n), top] > best
        best[better] = row[better, top[better]]
        at[better] = np.stack([np.full(better.sum(), i), top[better] + 1], 1)
    out = []
    for k, (i, w) in enumerate(at.tolist()):
        end, matched = i + w - 1, 0
        start = end
        while move := moves[i, k, w]:
            j = i + w - 2
            if move == 1:
                matched += int(a[i - 1] == windows[k, j])
                start, i = j, i - 1
            elif move == 2:
                i, w = i - 1, w + 1
            else:
                start, w = j, w - 1
        out.append((matched, start, end))
    return out


class Index:
    """Template words and the inverted index from fingerprints to (template, place)."""

    def __init__(self, templates=TEMPLATES, gram: int = 3, window: int = 4):
        self.licenses, self.gram, self.words = [t[0] for t in templates], gram, []
        prints, owner, place = [], [], []
        for i, (_, text) in enumerate(templates):
            g = next(K.groups(pa.array([text])))
            h, _, _ = scan_words(g)
            self.words.append(h)
            p, at = K.shingles(h, np.zeros(len(h), np.int64), min(gram, len(h)))
            keep = winnow(p, window)
            prints.append(p[keep])
            owner.append(np.full(len(keep), i))
            place.append(at[keep])
        self.prints, self.owner, self.place = np.concatenate(prints), np.concatenate(owner), np.concatenate(place)
        order = np.argsort(self.prints, kind="stable")
        self.prints, self.owner, self.place = self.prints[order], self.owner[order], self.place[order]

    def hits(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint's index, template, place) of the fingerprints that are in the index."""
        lo, hi = np.searchsorted(self.prints, prints), np.searchsorted(self.prints, prints, "right")
        n = hi - lo
        at = np.repeat(np.arange(len(prints)), n)
        entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return at, self.owner[entry], self.place[entry]


def scan_words(g: K.Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of the runs of letters and digits, A-Z folded."""
    s, e = g.words(K.PUNCT)
    return K.span(K.prefix(K.FOLD[g.data]), s, e), s, e


def scan(docs: DataFrame, *, templates=TEMPLATES, gram: int = 3, window: int = 4, band: int = 6, coverage: float = 0.7) -> DataFrame:
    """One row for each occurrence of a template: doc_id, license, template (its number), matched_words,
    template_words, coverage, start, end (characters of the text).

    Words are runs of letters and digits, A-Z folded. A text's word n-grams are looked up in the index of
    winnowed template fingerprints; hits on neighbouring diagonals are one candidate, which is aligned
    within `band` words of them, and again without what was found as long as hits are left over. Alignments that
    match at least `coverage` of the template's words count; of those that overlap in a text the one with most
    matched words stays, then the one that covers more of its template, the first in the text, the first template.
    Texts of any length are read whole. Null and empty texts have none. Repeated rows each give their rows; null
    ids stay null; doc_id may be of any type. Other columns are not read; an empty table gives an empty result.
    """
    index = Index(templates, gram, window)

    def candidates(h, doc, begin):
        """(document, template, its hits as (word in the document, diagonal)) of the stretches of hits within a band."""
        p, first = K.shingles(h, doc, gram)
        at, owner, place = index.hits(p)
        pos = first[at]
        order = np.lexsort((pos, pos - place, owner, doc[pos]))
        pos, place, owner = pos[order], place[order], owner[order]
        d, out = doc[pos], []
        pos, diagonal = pos - begin[d], pos - place - begin[d]
        lead = 0
        for c in range(1, len(pos) + 1):  # a run of drifting diagonals (a repeated phrase) is aligned a stretch at a time
            if c == len(pos) or d[c] != d[lead] or owner[c] != owner[lead] or diagonal[c] - diagonal[lead] > band:
                out.append((int(d[lead]), int(owner[lead]), pos[lead:c], diagonal[lead:c]))
                lead = c
        return out

    def found(h, doc, n, begin):
        """(document, words matched, template, first and past-the-last word) of the alignments that count."""
        todo, out = [(k, t, p, q, ()) for k, t, p, q in candidates(h, doc, begin)], []
        while todo:
            again = []
            for t in sorted({c[1] for c in todo}):
                mine, x = [c for c in todo if c[1] == t], index.words[t]
                for part in (mine[i : i + 256] for i in range(0, len(mine), 256)):
                    windows = np.zeros((len(part), len(x) + 2 * band), np.uint64)
                    for row, (k, _, _, q, taken) in zip(windows, part, strict=True):
                        lo = int(q[0]) - band
                        u, v = max(lo, 0), min(lo + len(row), int(n[k]))
                        row[u - lo : v - lo] = h[begin[k] + u : begin[k] + v]
                        for y, z in taken:
                            row[max(y - lo, 0) : max(z - lo, 0)] = 0
                    for (k, _, p, q, taken), (m, u, v) in zip(part, align(x, windows, band), strict=True):
                        if m >= coverage * len(x):
                            u, v = u + int(q[0]) - band, v + int(q[0]) - band
                            out.append((k, m, t, u, v))
                            left = (p >= v) | (p + gram <= u)
                            if left.any():  # what was found cannot match again, so this ends
                                again.append((k, t, p[left], q[left], (*taken, (u, v))))
            todo = again
        return out

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for g in K.groups(batch.column(1)):
                h, s, e = scan_words(g)
                doc = g.doc_of(s)
                n = np.bincount(doc, minlength=g.n)
                begin = np.cumsum(n) - n
                lead = np.concatenate([[0], np.cumsum((g.data & 0xC0) != 0x80)])
                got: dict[int, list] = {}
                for k, m, t, u, v in found(h, doc, n, begin):
                    got.setdefault(k, []).append((m, t, u, v))
                for k, of in got.items():
                    kept: list[tuple] = []
                    for m, t, u, v in sorted(of, key=lambda r: (-r[0], len(index.words[r[1]]), r[2], r[1])):
                        if all(v <= y or u >= z for _, _, y, z in kept):
                            kept.append((m, t, u, v))
                    for m, t, u, v in sorted(kept, key=lambda r: r[2]):
                        o, size = lead[g.bounds[k]], len(index.words[t])
                        rows.append((g.first + k, index.licenses[t], t, m, size, m / size, int(lead[s[begin[k] + u]] - o), int(lead[e[begin[k] + v - 1]] - o)))
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True))], names)

    names = ["doc_id", "license", "template", "matched_words", "template_words", "coverage", "start", "end"]
    kinds = ("string", "int", "long", "long", "double", "long", "long")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(", ".join(f"`{c}` {k}" for c, k in zip(names[1:], kinds, strict=True))).fields])
    return shipped(docs).select("doc_id", "text").mapInArrow(run, schema)
