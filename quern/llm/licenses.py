"""Licence scans: Dice coefficient over word bigrams between normalised text and licence templates.

Each line, each paragraph (run of lines with words) and the whole text is a segment. Two bags of a and b
bigrams have Dice at most 2 min(a, b) / (a + b), so with a threshold t only templates of
a t / (2 - t) <= b <= a (2 - t) / t bigrams are compared; most segments meet no template at all.

A licence in the middle of a longer line, or broken over lines, is met by windows: as many bigrams as the template
has, or as are left, from every place where one of its bigrams stands. A window that reaches the threshold
shares at least b t / (2 - t) of the template's b bigrams, so of any more than the others it holds one: a
text that has none of those (the longest are taken, as the rarest) is passed over in one pass.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import doc_texts

THRESHOLD = 0.8

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_DEALINGS = "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_USE, _ISC_COPIES = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_GPL = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
_GPL_END = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."

#: Whole texts of short public licences, then notices and short forms, by SPDX identifier.
TEMPLATES = (
    ("MIT", f"{_MIT_GRANT} {_AS_IS} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS {_DEALINGS}"),
    ("ISC", f"{_ISC_USE}{_ISC_COPIES} {_ISC_END}"),
    ("0BSD", f"{_ISC_USE}. {_ISC_END}"),
    ("BSD-2-Clause", f"{_BSD_START} {_BSD_TWO} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_START} {_BSD_TWO} {_BSD_THREE} {_BSD_END}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Unlicense", f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS} IN NO EVENT SHALL THE AUTHORS {_DEALINGS} For more information, please refer to <https://unlicense.org>"),
    ("Apache-2.0", f'{_APACHE} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0-or-later", f"{_GPL.format(':', ',', 3)} {_GPL_END}"),
    ("GPL-2.0-or-later", f"{_GPL.format(';', ';', 2)} {_GPL_END}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT_GRANT),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", _GPL.format(":", ",", 3)),
    ("GPL-2.0-or-later", _GPL.format(";", ";", 2)),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause OR BSD-3-Clause", _BSD_START),
    ("ISC", f"{_ISC_USE}{_ISC_COPIES}"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)

_WORD = re.compile(r"[a-z0-9]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalised(text: str) -> list[str]:
    """Words: runs of a-z and 0-9, once A-Z are lower-cased."""
    return _WORD.findall(text.translate(_FOLD) if not text.isascii() else text.lower())


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


class Scanner:
    """Templates sorted by size, ready to be compared."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        made = [(sum(b.values()), i, name, b) for i, (name, text) in enumerate(templates) if (b := bigrams(normalised(text)))]
        self.templates = sorted(made, key=lambda t: t[:2])
        self.sizes = [t[0] for t in self.templates]
        self.threshold = threshold
        #: Bigrams of which any window that reaches the threshold holds one -> the templates they are such of.
        self.keys: dict[tuple[str, str], list[int]] = {}
        for k, (n, _, _, bag) in enumerate(self.templates):
            spare = n - n * threshold / (2 - threshold) + 1e-9
            for pair in sorted(bag, key=lambda p: (-len(p[0]) - len(p[1]), p)):
                self.keys.setdefault(pair, []).append(k)
                spare -= bag[pair]
                if spare < 0:
                    break

    def candidates(self, size: int) -> range:
        """Places of the templates whose size lets the threshold be reached."""
        t = self.threshold
        return range(bisect_left(self.sizes, size * t / (2 - t) - 1e-9), bisect_right(self.sizes, size * (2 - t) / t + 1e-9))

    def best(self, words: list[str]) -> tuple[float, int, str] | None:
        """(dice, template's place in the list, licence) of the best template at or above the threshold."""
        size = len(words) - 1
        near = self.candidates(size) if size > 0 else ()
        if not near:
            return None
        own, best = None, None
        pairs = set(zip(words, words[1:]))
        for k in near:
            n, i, name, other = self.templates[k]
            if pairs.isdisjoint(other):
                continue
            own = own or bigrams(words)
            dice = 2 * sum(min(c, own[b]) for b, c in other.items()) / (size + n)
            if dice >= self.threshold and (best is None or (-dice, i) < (-best[0], best[1])):
                best = (dice, i, name)
        return best

    def windows(self, words: list[str]) -> list[tuple[float, int, str, int]]:
        """(dice, template's place in the list, licence, first word) of the windows at or above the threshold."""
        if self.keys.keys().isdisjoint(zip(words, words[1:])):
            return []
        pairs = list(zip(words, words[1:]))
        found = []
        for k in sorted({k for p in pairs if p in self.keys for k in self.keys[p]}):
            size, i, name, bag = self.templates[k]
            at = [x for x, p in enumerate(pairs) if p in bag]
            last = 0
            for first, x in enumerate(at):
                own = min(size, len(pairs) - x)
                while last < len(at) and at[last] < x + own:
                    last += 1
                if 2 * (last - first) >= self.threshold * (own + size) - 1e-9:
                    shared = sum(min(c, bag[p]) for p, c in Counter(pairs[y] for y in at[first:last]).items())
                    dice = 2 * shared / (own + size)
                    if dice >= self.threshold:
                        found.append((dice, i, name, x))
        return found

    def scan(self, text: str | None) -> tuple[str | None, float, int, int]:
        """(licence, dice, segments that match, places at which windows that match start) of a whole text; ties go to the template listed first."""
        lines = [normalised(x) for x in (text or "").split("\n")]
        segments, paragraph, several = [x for x in lines if x], [], 0
        blocks: list[list[str]] = []
        for x in [*lines, []]:
            if x:
                paragraph, several = paragraph + x, several + 1
            elif several:
                blocks.append(paragraph) if several > 1 else None
                paragraph, several = [], 0
        whole = [w for x in lines for w in x]
        rows = sum(map(bool, lines))
        segments += blocks + ([whole] if rows > 1 and not (len(blocks) == 1 and len(blocks[0]) == len(whole)) else [])
        found = [b for x in segments if (b := self.best(x))]
        inside = self.windows(whole)
        if not found and not inside:
            return None, 0.0, 0, 0
        dice, _, name = min((b[:3] for b in (*found, *inside)), key=lambda b: (-b[0], b[1]))
        return name, dice, len(found), len({x for *_, x in inside})


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, license (null if none), dice (0 if none), matches (lines, paragraphs and
    whole texts at or above the threshold), windows (words at which a window that reaches it starts).

    A null or empty text, or one with fewer than two words, matches nothing. Repeated rows and null
    doc_ids get a row each; an empty table gives none; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("dice", pa.float64()), ("matches", pa.int64()), ("windows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for x in batches:
            found = [scanner.scan(t.as_py()) for t in x.column("text")]
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), *(pa.array([f[i] for f in found], schema.field(i + 1).type) for i in range(4))], schema=schema)

    return doc_texts(docs).mapInArrow(run, "doc_id long, license string, dice double, matches long, windows long")


def license_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in SQL, comparing every segment with every template (no size bounds)."""
    quoted = ", ".join(f"({i}, '{name}', '{' '.join(normalised(text))}')" for i, (name, text) in enumerate(templates))
    return rf"""
with templates as (
  select i, name, unnest(list_transform(generate_series(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1])) as b, len(ws) - 1 as size
  from (select i, name, string_split(t, ' ') as ws from (values {quoted}) as v(i, name, t))
), tb as (
  select i, name, b, size, count(*) as c from templates group by all
), docs as (
  select row_number() over () as rid, doc_id, string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) as ls from documents
), lines as (
  select rid, k, regexp_extract_all(l, '[a-z0-9]+') as ws from (select rid, unnest(ls) as l, generate_subscripts(ls, 1) as k from docs)
), grouped as (
  select rid, k, ws, k - row_number() over (partition by rid, len(ws) > 0 order by k) as block from lines
), full_lines as (
  select rid, k, ws, block from grouped where len(ws) > 0
), paragraphs as (
  select rid, 1 as kind, block as k, flatten(list(ws order by k)) as ws, count(*) as n from full_lines group by rid, block having count(*) > 1
), wholes as (
  select rid, 2 as kind, 0 as k, flatten(list(ws order by k)) as ws, count(*) as n, count(distinct block) as blocks from full_lines group by rid having count(*) > 1
), segments as (
  select rid, 0 as kind, k, ws from full_lines
  union all select rid, kind, k, ws from paragraphs
  union all select rid, kind, k, ws from wholes where blocks > 1
), pairs as (
  select rid, kind, k, len(ws) - 1 as size, unnest(list_transform(generate_series(1, len(ws) - 1), lambda j: ws[j] || ' ' || ws[j + 1])) as b from segments where len(ws) > 1
), counted as (
  select rid, kind, k, size, b, count(*) as c from pairs group by all
), dice as (
  select s.rid, s.kind, s.k, t.i, t.name, 2 * sum(least(s.c, t.c)) / (any_value(s.size) + any_value(t.size)) as dice from counted s join tb t using (b) group by s.rid, s.kind, s.k, t.i, t.name
), best as (
  select rid, kind, k, max(dice) as dice, arg_min(name, struct_pack(a := -dice, b := i)) as name, min(struct_pack(a := -dice, b := i)) as place
  from dice where dice >= {threshold} group by rid, kind, k
), places as (
  select rid, n, unnest(generate_series(1, n)) as p, unnest(bs) as b from (
    select rid, len(ws) - 1 as n, list_transform(generate_series(1, len(ws) - 1), lambda j: ws[j] || ' ' || ws[j + 1]) as bs
    from (select rid, flatten(list(ws order by k)) as ws from full_lines group by rid) where len(ws) > 1)
), hits as (
  select rid, n, p, s.b, i, name, t.size, c, least(t.size, n - p + 1) as own from places s join tb t on s.b = t.b
), starts as (
  select * from (select *, count(*) over (partition by rid, i order by p range between current row and size - 1 following) as near from hits) where 2 * near >= {threshold} * (own + size) - 1e-9
), shared as (
  select s.rid, s.i, s.name, s.p, s.own + s.size as sizes, h.b, least(count(*), any_value(h.c)) as in_both
  from starts s join hits h on h.rid = s.rid and h.i = s.i and h.p between s.p and s.p + s.size - 1 group by s.rid, s.i, s.name, s.p, s.own, s.size, h.b
), inside as (
  select rid, i, name, p, 2 * sum(in_both) / any_value(sizes) as dice from shared group by rid, i, name, p having 2 * sum(in_both) / any_value(sizes) >= {threshold}
), all_found as (
  select rid, dice, name, place, true as segment, null as p from best
  union all select rid, dice, name, struct_pack(a := -dice, b := i), false, p from inside
), per_doc as (
  select rid, max(dice) as dice, arg_min(name, place) as name, count(*) filter (segment) as n, count(distinct p) as starts from all_found group by rid
)
select d.doc_id, p.name as license, coalesce(round(p.dice, 9), 0)::double as dice, coalesce(p.n, 0)::bigint as matches, coalesce(p.starts, 0)::bigint as windows from docs d left join per_doc p using (rid)
"""
