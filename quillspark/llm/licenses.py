"""License scan: MinHash over overlapping text windows retrieves templates, exact containment verifies.

Words are maximal runs of letters, digits and non-ASCII bytes, lower-cased; shingles have five words.
For each template every window of as many shingles (stride 1) is hashed by HASHES functions, with bands
of one row. A window whose similarity with the template is s misses it with odds (1 - s) ** HASHES: at
LEAST_SIMILARITY, 0.5, that is 6e-8. A retrieved window is widened by SLACK of its length on both
sides, for insertions spread a template out, and is a match when it then holds at least ``share`` of
the template's distinct shingles. A text that holds that share in one piece has a window at similarity
2/3 (at 0.8), one whose shingles are spread over SLACK more words has one above 0.5. Of overlapping
matches of one template the best stays, the first of equals.

Only windows around a shingle that is some template's minimum are looked at; no other window can have
an equal minimum, so nothing is lost and a text without license words costs its shingles alone.

Null and empty texts have no match, and neither have texts of fewer words than the shortest template.
Texts of any length are scanned whole: slices carry over as many words as the longest window has,
whatever stands between them. Repeated rows get equal results, rows with a null id keep it; every row
gets a result and empty tables give none. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .shared import lean

WORDS, HASHES, SLACK, LEAST_SIMILARITY = 5, 24, 0.25, 0.5
#: Public license texts and notices.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
TEMPLATES = {
    "MIT": _MIT,
    "BSD-2-Clause": _BSD_TWO + _BSD_END,
    "BSD-3-Clause": _BSD_TWO + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
    "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MIT-notice": "Released under the MIT License",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
}
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_C = np.uint64(0xD6E8FEB86659FD93)
_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 63, HASHES, np.uint64) | np.uint64(1)


def words(raw: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a slice whose documents start at docs."""
    b = _LOWER[raw]
    w = _WORD[b]
    first = np.zeros(len(b) + 1, bool)
    first[docs] = True
    at = np.flatnonzero(w & (~np.concatenate([[False], w[:-1]]) | first[:-1]))
    end = np.flatnonzero(w & (~np.concatenate([w[1:], [False]]) | first[1:])) + 1
    return at, end, bpe.hashes(b, at, end) if len(at) else np.zeros(0, np.uint64)


def shingled(h: np.ndarray) -> np.ndarray:
    n = max(0, len(h) - WORDS + 1)
    with np.errstate(over="ignore"):
        s = np.full(n, WORDS, np.uint64)
        for j in range(WORDS):
            s = s * _C + h[j : j + n]
    return bpe.mix(s)


class Templates:
    """Distinct shingles of each template, and by each hash function the one that is its minimum."""

    def __init__(self, texts: dict[str, str]):
        self.rows, marks = [], []
        for name, text in texts.items():
            raw = np.frombuffer(text.encode(), np.uint8)
            s = shingled(words(raw, np.zeros(1, np.int64))[2])
            if not len(s):
                raise ValueError(f"a template needs {WORDS} words: {name}")
            with np.errstate(over="ignore"):
                least = np.array([s[bpe.mix(s * k).argmin()] for k in _SEEDS])
            self.rows.append((name, len(s), np.unique(s), least))
            marks.append(least)
        self.marks = np.unique(np.concatenate(marks))
        #: Words that a slice carries over: those of the longest widened window.
        self.carry = int(max(n for _, n, _, _ in self.rows) * (1 + 2 * SLACK)) + WORDS + 1

    def matches(self, s: np.ndarray, doc: np.ndarray, share: float) -> list[tuple[float, int, int, int]]:
        """(containment, template, first shingle, last shingle) of windows over shingles s of documents doc."""
        spots = np.flatnonzero(np.isin(s, self.marks, kind="sort"))
        if not len(spots):
            return []
        out: list[tuple[float, int, int, int]] = []
        at = s[spots]
        for t, (_, n, own, least) in enumerate(self.rows):
            seen = set()
            for k, seed in enumerate(_SEEDS):
                for p in spots[at == least[k]].tolist():
                    if any(u == t and i <= p <= j for _, u, i, j in out[-4:]):
                        continue
                    of = np.searchsorted(doc, [doc[p], doc[p] + 1])  # windows end with their document
                    lo, hi = max(int(of[0]), p - n + 1), min(int(of[1]), p + n)
                    with np.errstate(over="ignore"):
                        near = bpe.mix(s[lo:hi] * seed)
                    under = np.flatnonzero(near < near[p - lo]) + lo  # windows that hold one of these have another minimum
                    a, z = int(under[under < p].max(initial=lo - 1)) + 1, int(under[under > p].min(initial=hi)) - 1
                    if z - a + 1 < min(n, int(of[1] - of[0])) or (a, z) in seen:
                        continue
                    seen.add((a, z))
                    found = self.verify(s, n, own, max(int(of[0]), a - int(SLACK * n)), min(int(of[1]), z + 1 + int(SLACK * n)))
                    if found and found[0] >= share:
                        out.append((found[0], t, found[1], found[2]))
        return out

    @staticmethod
    def verify(s: np.ndarray, n: int, own: np.ndarray, lo: int, hi: int) -> tuple[float, int, int] | None:
        """(containment, first, last) of the widened window of shingles lo to hi that holds most of own."""
        inside = np.flatnonzero(np.isin(s[lo:hi], own)) + lo
        wide, held, left, best = int(n * (1 + 2 * SLACK)), {}, 0, None
        places, values = inside.tolist(), s[inside].tolist()
        for right, v in enumerate(values):
            held[v] = held.get(v, 0) + 1
            while places[right] - places[left] >= wide or held[values[left]] > 1:
                held[values[left]] -= 1
                if not held[values[left]]:
                    del held[values[left]]
                left += 1
            if best is None or len(held) > best[0]:
                best = len(held), places[left], places[right]
        return best and (best[0] / len(own), best[1], best[2])


def _chosen(found: list[tuple[float, int, int, int]]) -> list[tuple[float, int, int, int]]:
    """Of overlapping matches (containment, template, start, end) of one template the best."""
    out, taken = [], {}
    for c, t, i, j in sorted(set(found), key=lambda m: (-m[0], m[2], m[3])):
        spans = taken.setdefault(t, [])
        k = bisect.bisect_left(spans, (i, j))
        if (k == 0 or spans[k - 1][1] < i) and (k == len(spans) or j < spans[k][0]):
            spans.insert(k, (i, j))
            out.append((c, t, i, j))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, share: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, matches array<struct<license, start, end, containment>>), byte offsets in UTF-8."""
    texts = templates or TEMPLATES
    Templates(texts)  # refuses templates that are too short
    item = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])

    def run(batches):
        table = Templates(texts)
        for b in batches:
            data, off = bpe.buffers(b.column(1))
            out: list[list] = [[] for _ in range(b.num_rows)]
            carried, last = None, -1

            def look(at, end, h, doc):
                s = shingled(h)
                s[doc[: len(s)] != doc[WORDS - 1 :][: len(s)]] = 0  # those that run over the end of a document
                for c, t, i, j in table.matches(s, doc[: len(s)], share):
                    d = int(doc[i])
                    out[d].append((c, t, int(at[i]) - int(off[d]), int(end[j + WORDS - 1]) - int(off[d])))  # noqa: B023

            place = int(off[0]) if len(off) else 0
            for raw, starts, which in bpe.slices(data, off):
                at, end, h = words(raw, starts)
                base = int(off[which[0]]) if which[0] != last else place
                doc = which[np.searchsorted(starts, at, "right") - 1] if len(at) else np.zeros(0, np.int64)
                at, end = at + base, end + base
                if carried is not None and which[0] == last:
                    at, end, h, doc = (np.concatenate(x) for x in zip(carried, (at, end, h, doc)))
                look(at, end, h, doc)
                place, last = base + len(raw), int(which[-1])
                keep = slice(max(0, len(at) - table.carry), None)
                carried = at[keep], end[keep], h[keep], doc[keep]
            rows = []
            for found in out:
                named = [{"license": table.rows[t][0], "start": i, "end": j, "containment": c} for c, t, i, j in _chosen(found)]
                rows.append(sorted(named, key=lambda m: (m["start"], m["license"])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(item))], ["doc_id", "matches"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), "doc_id long, matches array<struct<license:string,start:long,end:long,containment:double>>")
