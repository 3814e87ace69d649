"""License scans by patience alignment (operator 5).

Words unique to both the text and a template are anchors; their longest increasing run is the skeleton of the alignment, and the
gaps between its anchors are aligned in the same way, until no gap has a word unique to both; such a gap adds its longest common
subsequence. Coverage is the share of the
template's words that are aligned. A license stands where a stretch of three times its template's words at most covers 0.8 of it. A text is
aligned around those words of a template of which one must be there; where a template stands more than once, or its words are spread
wider, windows of up to that length on each side are aligned instead.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches
from .words import FOLDED, Words, pieces

#: Coverage from which a license counts as found, and words of the longest stretch that may hold it, as a multiple of the template's: what is spread wider
#: shares words with a license, but does not state it.
COVERAGE, SLACK = 0.8, 3
# fixed values: notices of public licenses, by SPDX id
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MIT": "Released under the MIT License.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by the first number, that rises in the second."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        back[n] = at[k - 1] if k else -1
        if k == len(tops):
            tops.append(j)
            at.append(n)
        else:
            tops[k], at[k] = j, n
    out = []
    n = at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of a and b. Gaps are kept on a list, not on the call stack."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        once_a: dict = {}
        for i in range(a0, a1):
            once_a[a[i]] = -1 if a[i] in once_a else i
        once_b: dict = {}
        for j in range(b0, b1):
            once_b[b[j]] = -1 if b[j] in once_b else j
        pairs = _rising(sorted((i, once_b[w]) for w, i in once_a.items() if i >= 0 and once_b.get(w, -1) >= 0))
        if not pairs and a0 < a1 and b0 < b1:  # equal words in the order that makes a rising run a common subsequence
            places: dict = {}
            for j in range(b1 - 1, b0 - 1, -1):
                places.setdefault(b[j], []).append(j)
            out += _rising([(i, j) for i in range(a0, a1) for j in places.get(a[i], ())])
            continue
        out += pairs
        edges = [(a0 - 1, b0 - 1), *pairs, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False) if i + 1 < k and j + 1 < m]
    return sorted(out)


class Scanner:
    """A template of n words of which `need` must be aligned has an aligned word among any n - need + 1 of its places. Those
    of its longest words, which are rare in most texts, are its gate: a text is aligned only around them."""

    def __init__(self, templates: dict[str, str]):
        self.words, self.need, self.gate = {}, {}, {}  # gate: the places of a template's gate words
        gates: dict[int, list[str]] = {}
        for name, text in templates.items():
            data = np.frombuffer(text.encode(), np.uint8)
            w = Words(data, np.array([0, len(data)]), FOLDED)
            t = self.words[name] = w.hash.tolist()
            need = self.need[name] = -(-int(COVERAGE * 1000 * len(t)) // 1000)
            rare = sorted(range(len(t)), key=lambda i: (w.start[i] - w.end[i], i))[: len(t) - need + 1]  # noqa: B023
            self.gate[name] = {}
            for h in {t[i] for i in rare}:
                gates.setdefault(h, []).append(name)
                self.gate[name][h] = [i for i, x in enumerate(t) if x == h]
        self.gates = gates
        self.known = np.array(sorted(gates), dtype=np.uint64)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True

    def marked(self, h: np.ndarray) -> np.ndarray:
        """Positions of gate words of any template."""
        i = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
        return i[np.isin(h[i], self.known)]

    def stretches(self, name: str, part: list[int]) -> list[tuple[int, int, int]]:
        """(words aligned, first word, end word) of all separate stretches of part that cover the template."""
        t, need, gate = self.words[name], self.need[name], self.gate[name]
        most = Counter(t)
        enough = lambda words: sum(min(k, most[w]) for w, k in Counter(words).items() if w in most) >= need
        out, todo = [], [(0, len(part))]
        while todo:
            x, y = todo.pop()
            if y - x < need or not enough(part[x:y]):
                continue
            al = patience(part[x:y], t)
            if len(al) >= need and al[-1][0] + 1 - al[0][0] <= SLACK * len(t):
                best = (len(al), x + al[0][0], x + al[-1][0] + 1)
            else:  # it may stand there more than once
                seen = []
                widths = (0, len(t) // 4, len(t), (SLACK - 1) * len(t))  # of other words on each side; no stretch has more than the last
                around = {(max(x, p - i - more), min(y, p - i + len(t) + more)) for p in range(x, y) for i in gate.get(part[p], ()) for more in widths}
                begun = {(p, min(y, p + len(t) + more)) for p in range(x, y) if part[p] in most for more in widths}  # by any of its words
                for windows in (around, begun):
                    for u, v in sorted(windows) if not seen else ():
                        if v - u >= need and enough(part[u:v]):
                            al = patience(part[u:v], t)
                            if len(al) >= need and al[-1][0] + 1 - al[0][0] <= SLACK * len(t):
                                seen.append((len(al), u + al[0][0], u + al[-1][0] + 1))
                if not seen:
                    continue
                best = min(seen, key=lambda f: (-f[0], f[2] - f[1], f[1]))
            out.append(best)
            todo += [(x, best[1]), (best[2], y)]
        return out

    def scan(self, h: np.ndarray, marked: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, end word) of one text: all stretches of each template that are covered enough, those left out that
        overlap a better one."""
        hits: dict[str, list[int]] = {}
        for p, word in zip(marked.tolist(), h[marked].tolist(), strict=True):
            for name in self.gates[word]:
                hits.setdefault(name, []).append(p)
        found = []
        for name, places in hits.items():
            t, need = self.words[name], self.need[name]
            reach, own = SLACK * len(t), set(t)
            spans: list[list[int]] = []
            for p in places:  # near gate words are looked at together, but never more than a few templates' lengths
                if spans and p + reach - spans[-1][0] <= 4 * reach:
                    spans[-1][1] = p + reach
                else:
                    spans.append([p - reach, p + reach])
            for x, y in spans:
                x, part = max(0, x), h[max(0, x) : y].tolist()
                if sum(w in own for w in part) >= need:
                    found += [(name, m / len(t), x + u, x + v) for m, u, v in self.stretches(name, part)]
        # of templates that share words, the one with most of them aligned in the least space, then the one covered best
        found.sort(key=lambda f: (-(round(f[1] * len(self.words[f[0]])) ** 2 / (f[3] - f[2])), -f[1], f[0], f[3] - f[2], f[2]))
        kept: list[tuple[str, float, int, int]] = []
        starts: list[int] = []  # of kept, in the order of the text; they don't overlap
        ends: list[int] = []
        for f in found:
            k = bisect_left(ends, f[2] + 1)
            if k == len(starts) or starts[k] >= f[3]:
                kept.append(f)
                starts.insert(k, f[2])
                ends.insert(k, f[3])
        return kept


def scan(spark: SparkSession, docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, coverage, licenses of every row: the license of the best coverage (null if none), its coverage (0 if none), and all found,
    as name:first word:end word, comma-joined.

    Nulls: a null text has no license; a null doc_id is kept. Ties: the name that comes first. Repeated rows are returned each. Empty tables: no rows.
    Long texts are scanned whole."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Scanner(templates))  # of the templates, whatever the documents
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for b in batches:
            out: list[list] = [[None, 0.0, ""] for _ in range(b.num_rows)]
            for i, _, data, offsets in pieces(b.column("text")):
                w = Words(data, offsets, FOLDED)
                marked = scanner.marked(w.hash)
                cut = np.searchsorted(marked, w.first)
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    first = int(w.first[k])
                    found = scanner.scan(w.hash[first : w.first[k + 1]], marked[cut[k] : cut[k + 1]] - first)
                    if found:
                        top = min(found, key=lambda f: (-f[1], f[0]))
                        out[i + k] = [top[0], round(top[1], 6), ",".join(f"{n}:{x}:{y}" for n, _, x, y in sorted(found, key=lambda f: (f[2], f[0])))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[c] for r in out], t) for c, t in enumerate((pa.string(), pa.float64(), pa.string())))], ["doc_id", "license", "coverage", "licenses"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, license string, coverage double, licenses string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
