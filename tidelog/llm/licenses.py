"""Licence scans: passages compared with licence templates by Dice coefficient.

Texts and templates are normalised (A to Z in lower case; ASCII characters
other than letters and digits part words) and cut into word bigrams. For each
template, windows of its length slide over a document. A running count of
bigrams that the template has bounds the coefficient from above; windows that
reach the threshold by this bound are compared by the exact coefficient of
the two multisets, and of overlapping matches the best stays. Size bounds
prune templates first: with threshold t, sets of a and b bigrams can only
match if t / (2 - t) <= a / b <= (2 - t) / t, so a document too short for a
template is never compared with it.

Cases with a defined result: a null or empty text matches nothing; a licence
may match several times; of equal matches at a place, the template that comes
first in the list is named; repeated rows get equal results; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import arrow_map, text_bytes
from ._words import grams, words

THRESHOLD = 0.85

# Wording of public licences and of the notices that name them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2}General Public License for more details."""
_TITLES = (
    ("MIT", "MIT License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("ISC", "ISC License"), ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-3.0", "GNU General Public License, version 3"), ("GPL-2.0", "GNU General Public License, version 2"), ("LGPL-3.0", "GNU Lesser General Public License, version 3"), ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"), ("MPL-2.0", "Mozilla Public License, version 2.0"), ("EPL-2.0", "Eclipse Public License, version 2.0"), ("BSL-1.0", "Boost Software License, Version 1.0"), ("Zlib", "zlib License"), ("CC0-1.0", "CC0 1.0 Universal License"),
)
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}"),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("LGPL-2.1", _GNU.format("library", ";", "Lesser ", ";", "2.1")),
    ("LGPL-3.0", _GNU.format("library", ":", "Lesser ", ",", "3")),
    ("AGPL-3.0", _GNU.format("program", ":", "Affero ", ",", "3")),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    *((name, f"{how} under the {title}.") for name, title in _TITLES for how in ("Licensed", "Released", "Distributed")),
    *((f"CC-{k}-{v}", f"Licensed under CC {k} {v}.") for k in _CC for v in ("2.0", "2.5", "3.0", "4.0")),
    *((f"CC-{k}-{v}", f"This work is licensed under a Creative Commons {title} {v} {scope} License.") for k, title in _CC.items() for v, scope in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))),
)

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


def _bigrams(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bigram hashes of all rows in turn, and the rows' edges among them."""
    hashes, rows, _, _ = words(_PLAIN[body], offsets)
    both = grams(hashes, 2)
    inside = rows[:-1] == rows[1:] if len(rows) > 1 else np.zeros(0, bool)
    return both[inside], np.searchsorted(rows[:-1][inside], np.arange(len(offsets)))


@cache
def _templates(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, Counter, np.ndarray, int]]:
    """Name, bigram counts, sorted distinct bigrams and number of bigrams of each."""
    found = []
    for name, text in templates:
        body = np.frombuffer(text.encode(), np.uint8)
        grams_, _ = _bigrams(body, np.array([0, len(body)]))
        found.append((name, Counter(grams_.tolist()), np.unique(grams_), len(grams_)))
    return found


def dice(a: Counter, b: Counter) -> float:
    """2 |a and b| / (|a| + |b|) of multisets."""
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


def _matches(one: np.ndarray, hits: list[np.ndarray], table: list, threshold: float) -> list[tuple[float, int, int, int]]:
    """(coefficient, template, first bigram, number of bigrams) of a document's matches, not overlapping."""
    found = []
    for t, (_, counts, _, size) in enumerate(table):
        n = min(size, len(one))
        if (2 - threshold) * n < threshold * size:  # size bound
            continue
        run = np.append(0, np.cumsum(hits[t]))
        bound = 2 * (run[n:] - run[: len(run) - n]) / (n + size)
        for at in np.flatnonzero(bound >= threshold).tolist():
            value = dice(Counter(one[at : at + n].tolist()), counts)
            if value >= threshold:
                found.append((value, t, at, n))
    chosen: list[tuple[float, int, int, int]] = []
    taken = np.zeros(len(one), bool)
    for m in sorted(found, key=lambda m: (-m[0] * m[3], -m[0], m[1], m[2])):
        if not taken[m[2] : m[2] + m[3]].any():
            taken[m[2] : m[2] + m[3]] = True
            chosen.append(m)
    return sorted(chosen, key=lambda m: m[2])


def scan(df: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_matches, and the matches in order (licence, coefficient, first word, number of words of the normalised text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = _templates(templates)
        both, edge = _bigrams(*text_bytes(batch))
        known = np.unique(np.concatenate([distinct for _, _, distinct, _ in table]))
        place = np.minimum(np.searchsorted(known, both), len(known) - 1)
        place[known[place] != both] = len(known)  # in no template
        inside = [np.append(np.isin(known, distinct), False) for _, _, distinct, _ in table]
        # documents with as many of a template's bigrams as a match needs
        lens = np.diff(edge)
        hopeful = np.zeros(batch.num_rows, bool)
        for of, (_, _, _, size) in zip(inside, table, strict=True):
            s = np.append(0, np.cumsum(of[place]))
            hopeful |= 2 * (s[edge[1:]] - s[edge[:-1]]) >= threshold * (np.minimum(lens, size) + size)
        rows = [[] for _ in range(batch.num_rows)]
        for i in np.flatnonzero(hopeful & (lens > 0)).tolist():
            a, b = int(edge[i]), int(edge[i + 1])
            rows[i] = [{"license": table[t][0], "dice": round(v, 6), "first_word": at, "n_words": n + 1} for v, t, at, n in _matches(both[a:b], [of[place[a:b]] for of in inside], table, threshold)]
        kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_word", pa.int32()), ("n_words", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(r) for r in rows], pa.int64()), pa.array(rows, kind)], ["doc_id", "n_matches", "matches"])

    schema = "doc_id long, n_matches long, matches array<struct<license: string, dice: double, first_word: int, n_words: int>>"
    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(arrow_map(run), schema)
