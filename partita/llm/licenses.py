"""License scan: winnowed fingerprints of templates pick candidates, a banded alignment confirms and places them."""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from partita.llm.common import slices

_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Public license texts, from their grant on (the copyright lines above them name the holder).
TEXTS = {
    "mit-text": _MIT_GRANT + """, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-2-clause-text": f"{_BSD_2}\n{_BSD_END}",
    "bsd-3-clause-text": f"{_BSD_2}\n{_BSD_3}\n{_BSD_END}",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsl-1.0-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
}

#: Public license notices, as they are printed.
NOTICES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-grant": _MIT_GRANT,
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "public-domain": "This is free and unencumbered software released into the public domain.",
}

TEMPLATES = NOTICES | TEXTS

_WORD = re.compile(r"\S+")
_EDGE = re.compile(r"^\W+|\W+$")


def word(chunk: str) -> str:
    """A word as it is compared: lower case, without marks at its ends."""
    return _EDGE.sub("", chunk).lower()


class Scanner:
    """The inverted index of a set of templates, and the scan of one text's word numbers.

    Fingerprints are word runs of length `run` (or the whole template, if shorter); of every `window` neighbouring runs of a
    template the one of least hash is indexed. The set of templates is a parameter, small by nature; it travels with the task.
    """

    def __init__(self, templates: Mapping[str, str], run: int = 3, window: int = 2, band: int = 4, coverage: float = 0.8):
        self.run, self.band, self.coverage = run, band, coverage
        self.names = sorted(templates)
        self.words = [[w for c in _WORD.findall(templates[n]) if (w := word(c))] for n in self.names]
        self.number = {w: k for k, w in enumerate(sorted({w for t in self.words for w in t}), 1)}
        self.codes = [[self.number[w] for w in t] for t in self.words]
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: list[int] = [t for t, c in enumerate(self.codes) if 0 < len(c) < run]
        for t, codes in enumerate(self.codes):
            keys = self.keys(np.array(codes, np.int64)).tolist()
            chosen = {min(range(a, min(a + window, len(keys))), key=lambda j: (self.mix(keys[j]), j)) for a in range(max(1, len(keys) - window + 1))} if keys else set()
            for j in sorted(chosen):
                self.index[keys[j]].append((t, j))
        self.known = np.array(sorted(self.index), np.int64)

    @staticmethod
    def mix(x: int) -> int:
        return (x * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF

    def keys(self, codes: np.ndarray) -> np.ndarray:
        n = max(0, len(codes) - self.run + 1)
        out = np.zeros(n, np.int64)
        for k in range(self.run):
            out = out * (len(self.number) + 1) + codes[k : k + n]
        return out

    def align(self, codes: np.ndarray, template: list[int], diagonal: int) -> tuple[int, int, int]:
        """The longest common subsequence inside the band around a diagonal: matches, first and last matched word."""
        if diagonal >= 0 and np.array_equal(codes[diagonal : diagonal + len(template)], template):
            return len(template), diagonal, diagonal + len(template) - 1  # nothing is longer, or as near
        low = max(0, diagonal - self.band)
        part = codes[low : diagonal + len(template) + self.band + 1].tolist()
        best: list[dict[int, tuple[int, int, int]]] = []
        none = (0, -1, -1)
        for j, want in enumerate(template):
            row: dict[int, tuple[int, int, int]] = {}
            for i in range(max(0, diagonal + j - self.band - low), min(len(part), diagonal + j + self.band + 1 - low)):
                up = best[j - 1].get(i, none) if j else none
                left = row.get(i - 1, none)
                cell = max(up, left, key=lambda c: (c[0], c[1]))
                if part[i] == want:
                    before = best[j - 1].get(i - 1, none) if j else none
                    hit = (before[0] + 1, before[1] if before[0] else i, i)
                    cell = max(cell, hit, key=lambda c: (c[0], c[1]))
                row[i] = cell
            best.append(row)
        # of equal matches the shortest span, then the one nearest to the diagonal
        m, first, last = max(best[-1].values(), key=lambda c: (c[0], c[1] - c[2], -abs(c[1] + low - diagonal)), default=none)
        return m, first + low, last + low

    def scan(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, matched words, first word, last word) of the places that reach the coverage."""
        found: set[tuple[int, int]] = set()
        keys = self.keys(codes)
        for i in np.flatnonzero(np.isin(keys, self.known)).tolist():
            found.update((t, i - j) for t, j in self.index[int(keys[i])])
        for t in self.short:
            first = self.codes[t]
            found.update((t, i) for i in np.flatnonzero(codes == first[0]).tolist())
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for t, diagonal in sorted(found):
            m, first, last = self.align(codes, self.codes[t], diagonal)
            if m and m >= self.coverage * len(self.codes[t]):
                out[t, first] = max(out.get((t, first), (0, 0)), (m, last))
        kept: list[tuple[int, int, int, int]] = []
        taken: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by template, in order; spans don't overlap, so neighbours suffice
        for (t, first), (m, last) in sorted(out.items(), key=lambda x: (x[0][0], -x[1][0], x[0][1])):
            spans, at = taken[t], bisect(taken[t], (first, last))
            if (at == 0 or spans[at - 1][1] < first) and (at == len(spans) or last < spans[at][0]):
                spans.insert(at, (first, last))
                kept.append((t, m, first, last))
        return kept


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, run: int = 3, window: int = 2, band: int = 4, coverage: float = 0.8) -> DataFrame:
    """One row per place where a template stands: doc_id, license, matched_words, template_words, coverage, start, stop.

    start and stop count code points of the text, stop being exclusive. A place counts if an alignment within `band` words of a
    diagonal matches at least `coverage` of the template's words; places of one template don't overlap (the fuller first).
    A place is found if it has one indexed run unchanged. Null and empty texts have no places; repeated rows repeat them;
    a null doc_id stays null; other columns are ignored; an empty table gives none. Templates of fewer words than a run are sought by
    their first word; a notice inside a whole text is a place of its own. No shuffle: each task scans its own rows over whole texts.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, run, window, band, coverage)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                cut = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
                coded = pc.dictionary_encode(cut.values)
                offsets = np.asarray(cut.offsets, dtype=np.int64)
                numbers = np.array([scanner.number.get(word(c), 0) if c else -1 for c in coded.dictionary.to_pylist()], np.int64)
                codes = numbers[np.asarray(coded.indices)] if len(numbers) else np.empty(0, np.int64)
                # texts with a run of template words at all
                near = np.concatenate([[0], np.cumsum(codes > 0)])
                out = []
                for k in np.flatnonzero(near[offsets[1:]] > near[offsets[:-1]]).tolist():
                    own = codes[offsets[k] : offsets[k + 1]]
                    own = own[own >= 0]
                    places = scanner.scan(own)
                    if places:
                        spans = [m.span() for m in _WORD.finditer(texts[k])]
                        doc = batch.column("doc_id")[k].as_py()
                        for t, m, first, last in places:
                            n = len(scanner.codes[t])
                            out.append((doc, scanner.names[t], m, n, m / n, spans[first][0], spans[last][1]))
                if out:
                    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "license", "matched_words", "template_words", "coverage", "start", "stop"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, license string, matched_words long, template_words long, coverage double, start long, stop long")
