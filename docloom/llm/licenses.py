"""License scans by patience alignment.

A text and a template are aligned on the words unique to both: the longest increasing
subsequence of their positions gives anchors, and the gaps between anchors are aligned
in the same way, down to equal runs at their ends.  Coverage is the share of the
template's words that are aligned; a notice is found where it reaches ``LEAST``.

Words repeat when a notice does, so a text is aligned in windows that hold enough of
the template's words, each about as long as the template.  Of overlapping windows the
one of the best coverage gives the notice, of equal ones the shortest span; what is
left before and behind it is searched again.  A document that lacks words which make
up more than 1 - ``LEAST`` of a template, repeats counted, is not aligned with it.
Whole texts are read.

Null and empty texts, and texts without notices, have an empty license and coverage
0.0.  A document's license is the template of the best coverage, of equal ones the
longest, of equally long ones the one listed first.  Repeated rows are found alike.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import common

LEAST = 0.8
STRETCH = 1.5  # a window's words for each word of the template

# Public license notices, and the grants of those whose warranty text is often left out.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS '
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
        "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        'written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY '
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
        'SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details. You should have received a copy of the GNU General Public License "
        "along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "lgpl-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
        "the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser "
        "General Public License along with this library. If not, see <https://www.gnu.org/licenses/>."
    ),
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
        "the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero "
        "General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright "
        "laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
        "public domain. We make this dedication for the benefit of the public at large and to the detriment of our "
        "heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all "
        'present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT '
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "bsd-2-clause-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "gpl-3.0-grant": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "reserved-notice": "All rights reserved.",
}


def plain(word: str) -> str:
    return word.lower().strip(".,;:()[]\"'*#/-")


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience piles."""
    tops, at, back = [], [], []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    found, i = [], at[-1] if at else -1
    while i >= 0:
        found.append(i)
        i = back[i]
    return found[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b), ascending in both."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = _once(a, a0, a1), _once(b, b0, b1)
        pairs = [(i, once_b[w]) for w, i in once_a.items() if w in once_b]
        anchors = [pairs[i] for i in increasing([j for _, j in pairs])]
        found += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        if anchors:
            todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(ends, ends[1:])]
    return sorted(found)


def _once(words: list[str], low: int, high: int) -> dict[str, int]:
    """Words that stand once in words[low:high], in order, with their position."""
    at: dict[str, int] = {}
    for i in range(low, high):
        at[words[i]] = -1 if words[i] in at else i
    return {w: i for w, i in at.items() if i >= 0}


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.templates = [(name, [w for w in map(plain, text.split()) if w]) for name, text in templates.items()]
        self.sets = [frozenset(words) for _, words in self.templates]
        self.counts = [Counter(words) for _, words in self.templates]
        self.plain = common.Remembered(plain, 200_000)
        self.words = re.compile(r"\S+")

    def scan(self, text: str) -> tuple[int, list[tuple[str, int, int, float]]]:
        """Number of words; (template, start, end, coverage) of each notice, in code points, by start."""
        raw = text.split()
        words = list(map(self.plain.__getitem__, raw))
        have, found, spans = set(words), [], None
        for (name, template), known, need in zip(self.templates, self.sets, self.counts):
            lacking = sum(map(need.__getitem__, known - have))
            if len(template) - lacking < LEAST * len(template):
                continue
            spans = spans or [m.span() for m in self.words.finditer(text)]
            for first, last, coverage in self._windows(words, template, need):
                found.append((name, spans[first][0], spans[last][1], coverage))
        return len(raw), sorted(found, key=lambda x: (*x[1:3], x[0]))

    def _windows(self, words: list[str], template: list[str], need: Counter):
        """(first word, last word, coverage) of each notice of the template."""
        hits = [i for i, w in enumerate(words) if w in need]
        todo = [(0, len(words))]
        while todo:
            low, high = todo.pop()
            starts = self._starts(words, template, need, hits, low, high)
            if not starts:
                continue
            reach = starts[0][1] + self._width(template)
            near = [x for x in starts if x[1] < reach]
            best = self._best(words, template, near, high)
            if best is None:
                todo.append((near[-1][1] + 1, high))
                continue
            n, first, last = best
            yield first, last, n / len(template)
            todo += [(low, first), (last + 1, high)]

    @staticmethod
    def _width(template: list[str]) -> int:
        return int(STRETCH * len(template)) + 1

    def _starts(self, words: list[str], template: list[str], need: Counter, hits: list[int], low: int, high: int) -> list[tuple[int, int]]:
        """(words shared, start) of the windows in words[low:high] that share ``LEAST`` of the template's words,
        each of them as often as the template has it: up to a width behind the first of them."""
        width, least = self._width(template), LEAST * len(template)
        at, stop = bisect_left(hits, low), bisect_left(hits, high)
        held, shared, end, found = dict.fromkeys(need, 0), 0, at, []
        for k in range(at, stop):
            start = hits[k]
            if found and start >= found[0][1] + width:
                break
            while end < stop and hits[end] < start + width:
                w = words[hits[end]]
                held[w] += 1
                shared += held[w] <= need[w]
                end += 1
            if shared >= least:
                found.append((shared, start))
            w = words[start]
            shared -= held[w] <= need[w]
            held[w] -= 1
        return found

    def _best(self, words: list[str], template: list[str], starts: list[tuple[int, int]], high: int) -> tuple[int, int, int] | None:
        """(words aligned, first word, last word) of the window that aligns most, of equal ones the shortest."""
        size, width = len(template), self._width(template)
        best = None

        def consider(low: int, stop: int):
            nonlocal best
            pairs = align(words[low:stop], template)
            if len(pairs) < LEAST * size:
                return
            first, last = low + pairs[0][0], low + pairs[-1][0]
            if best is None or (len(pairs), first - last) > (best[0], best[1] - best[2]):
                best = len(pairs), first, last

        for shared, low in sorted(starts, key=lambda x: (-x[0], -x[1])):
            if best and (shared < best[0] or best[0] == size == best[2] - best[1] + 1):
                break
            for wide in (size, width):
                consider(low, min(low + wide, high))
        return best


def licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, license, coverage, n_notices, notices) for every row of docs, without a shuffle.

    license: the template of the best coverage, of equal ones the longest, then the first
    listed; notices: name:start:end of all, by start, comma-joined.
    """
    known = dict(templates or TEMPLATES)

    def start():
        scanner = common.per_process(("licenses", hash(tuple(known.items()))), lambda: Scanner(known))
        order = {name: (len(words), -at) for at, (name, words) in enumerate(scanner.templates)}

        def fn(keys, texts):
            out = [keys[0], [], [], [], [], []]
            for text in texts:
                n, found = scanner.scan(text)
                best = max(found, key=lambda x: (x[3], *order[x[0]], -x[1]), default=("", 0, 0, 0.0))
                row = (n, best[0], best[3], len(found), ",".join(f"{name}:{a}:{b}" for name, a, b, _ in found))
                for column, value in zip(out[1:], row):
                    column.append(value)
            return out

        return fn

    return common.map_texts(docs, ["doc_id"], "doc_id long, n_words long, license string, coverage double, n_notices long, notices string", start)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(common.table(spark, sf_dir, "documents"))
