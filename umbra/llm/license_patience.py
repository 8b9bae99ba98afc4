"""License scans by patience alignment.

Text and template are word sequences (lower case, punctuation dropped). Words that occur once in both anchor the
alignment; the longest increasing subsequence of their positions is kept, and the gaps between anchors are aligned
in the same way, where further words have become unique. Equal words next to an anchor are taken along first. The
coverage of a template is the share of its words that the alignment matches.

The text is aligned in windows about one template length wide on each side of a seed, a text word held against its
place in the template, so that words elsewhere in a long text don't hide a notice. Seeds are the occurrences of the
template's words that are rarest in the text, of so many that a notice with the least coverage must match one of them.
Each seed has its own windows: up to the seed word's neighbouring occurrences, so that a further copy of the notice
doesn't make its words ambiguous, a tight one, and the uncut one. Of alignments that overlap the best counts (the most
words, then the first), so every copy of a notice is found. A template is tried only if the text's set of words can
reach the coverage, which loses nothing. Null text: no words, no rows. Very long texts are aligned around seeds only,
in time linear in their length and number of seeds. Null ids, repeated rows: a row for each (row, notice) found. Empty
table: empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

MIN_COVERAGE = 0.8
_WORD = re.compile(r"[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]")
#: Public license notices and the lines that refer to them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit-line": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsl-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "proprietary-line": "All rights reserved. Unauthorized copying or distribution is prohibited.",
}


def words(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of the text's words; offsets in code points (``lower`` keeps ASCII words in place)."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return [(m[0], m.start(), m.end()) for m in _WORD.finditer(low)]


def _increasing(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of (i, j), sorted by i, with increasing j: patience piles with links back."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(points):
        pile = bisect.bisect_left(tops, j)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[pile], at[pile] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(points[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched (index in a, index in b), increasing in both. Gaps are kept on a list, not on the call stack."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if nb[w] == 1}
        anchors = _increasing([(i, where[a[i]]) for i in range(a0, a1) if na[a[i]] == 1 and a[i] in where])
        if not anchors:
            continue
        out += anchors
        for (p, q), (r, s) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            gaps.append((p + 1, r, q + 1, s))
    return sorted(out)


_TEMPLATE_WORDS = {name: [w for w, _, _ in words(t)] for name, t in TEMPLATES.items()}


def _windows(found: list[tuple[str, int, int]], template: list[str], have: Counter, least: float) -> list[tuple[int, int, int, int]]:
    """(i, j, lo, hi): text word i is held against template word j, and found[lo:hi] is aligned around them."""
    m = len(template)
    places: dict[str, list[int]] = {}
    for j, w in enumerate(template):
        places.setdefault(w, []).append(j)
    spare = m - math.ceil(least * m - 1e-9)  # template words that a notice may lack
    picks: set[str] = set()
    for w in sorted(places, key=lambda w: (have.get(w, 0), len(places[w]), w)):
        if spare < 0:
            break
        picks.add(w)
        spare -= len(places[w])
    at: dict[str, list[int]] = {w: [] for w in picks}
    for i, (w, _, _) in enumerate(found):
        if w in picks:
            at[w].append(i)
    out = set()
    for w, own in at.items():
        for n, i in enumerate(own):
            for r, j in enumerate(places[w]):  # r occurrences in the template before j, the others after it
                before, after = n - r - 1, n + len(places[w]) - r
                low, high = max(0, i - j - m), min(len(found), i + 2 * m)
                cut = (own[before] + 1 if before >= 0 else 0, own[after] if after < len(own) else len(found))
                near = (max(0, i - j - m // 8), min(len(found), i - j + m + m // 8))
                for lo, hi in {(low, high), (max(low, cut[0]), min(high, cut[1])), near}:
                    if lo <= i < hi:
                        out.add((i, j, lo, hi))
    return sorted(out)


def _seeded(a: list[str], b: list[str], i: int, j: int) -> list[tuple[int, int]]:
    """Alignment of a with b in which a[i] meets b[j]."""
    left, right = align(a[:i], b[:j]), align(a[i + 1 :], b[j + 1 :])
    return [*left, (i, j), *((p + i + 1, q + j + 1) for p, q in right)]


def find_licenses(text: str, templates: dict[str, list[str]] = _TEMPLATE_WORDS, least: float = MIN_COVERAGE) -> list[tuple[str, int, int, int, int]]:
    """(license, matched words, template words, start, end) of every notice that covers at least ``least`` of its
    template; those of one template do not overlap."""
    found = words(text)
    if not found:
        return []
    have = Counter(w for w, _, _ in found)
    out = []
    for name, template in templates.items():
        need, must = Counter(template), least * len(template)
        if len(need) - len(need.keys() & have.keys()) > len(template) - must or sum(min(n, have[w]) for w, n in need.items()) < must:
            continue
        hits: list[tuple[int, int, int]] = []  # (matched, first word, last word)
        whole: list[tuple[int, int]] = []  # of these, the complete ones, in order
        for i, j, lo, hi in _windows(found, template, have, least):
            at = bisect.bisect_right(whole, (i, len(found))) - 1
            if at >= 0 and i <= whole[at][1]:
                continue
            window = [w for w, _, _ in found[lo:hi]]
            if sum((need & Counter(window)).values()) < must:
                continue
            pairs = _seeded(window, template, i - lo, j)
            if len(pairs) >= must:
                hits.append((len(pairs), lo + pairs[0][0], lo + pairs[-1][0]))
                if len(pairs) == len(template) and pairs[-1][0] - pairs[0][0] < len(template):
                    bisect.insort(whole, hits[-1][1:])
        taken: list[tuple[int, int]] = []
        for n, a, b in sorted(hits, key=lambda h: (-h[0], h[1], h[2])):
            at = bisect.bisect_right(taken, (b, len(found)))
            if at and taken[at - 1][1] >= a:
                continue
            bisect.insort(taken, (a, b))
            out.append((name, n, len(template), found[a][1], found[b][2]))
    return out


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = MIN_COVERAGE) -> DataFrame:
    """key, license, n_matched, n_template, coverage_bp (hundredths of a percent), start and end of every notice."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, license string, n_matched long, n_template long, coverage_bp long, start long, `end` long"

    def run(batches):
        for batch in batches:
            rows = [(i, *hit) for i, t in enumerate(batch.column(1).to_pylist()) if t for hit in find_licenses(t, least=least)]
            if rows:
                i, name, n, of, a, b = zip(*rows, strict=True)
                whole = lambda x: pa.array(x, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(name), whole(n), whole(of), whole([10000 * x // y for x, y in zip(n, of, strict=True)]), whole(a), whole(b)], names=[key, "license", "n_matched", "n_template", "coverage_bp", "start", "end"])

    return docs.select(key, text).mapInArrow(run, schema)
