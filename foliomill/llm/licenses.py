"""License scan: documents against licence templates by the Dice coefficient of word bigrams.

Text is normalised (lower case, words are runs of letters and digits). For every template, the spans of a
document that begin and end with a bigram of the template are compared with it:
dice = 2 * sum(min(count in span, count in template)) / (bigrams of span + bigrams of template). A span can
reach the threshold t only if its length lies within n*t/(2-t) and n*(2-t)/t for a template of n
bigrams, and only if it holds at least t*(n + shortest length)/2 template bigrams; both bounds prune before any counting.
A document gets the best span of every template that reaches the threshold, but of spans that overlap only the one of the highest dice.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

THRESHOLD = 0.8

_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_END = (
    "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. "
    "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; "
    "or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
)

#: Well-known public notices. A template is a notice as it stands in source files and pages.
TEMPLATES: dict[str, str] = {
    "MIT": "Released under the MIT License.",
    "MIT-terms": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-2-Clause": _BSD_TWO + " " + _BSD_END,
    "BSD-3-Clause": _BSD_TWO + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved. No part of this publication may be reproduced without prior written permission.",
}

_WORD = re.compile(r"[^\W_]+")


def normalise(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def length_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Least and greatest number of bigrams of a span that can reach the threshold against n bigrams."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


class Matcher:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        self.names = sorted(templates)
        self.counts: list[Counter] = []
        self.owners: dict[tuple[str, str], list[int]] = defaultdict(list)
        for k, name in enumerate(self.names):
            words = normalise(templates[name])
            if len(words) < 2:
                raise ValueError(f"template {name} has no bigram")
            self.counts.append(Counter(zip(words, words[1:])))
            for gram in self.counts[-1]:
                self.owners[gram].append(k)
        self.sizes = [c.total() for c in self.counts]
        self.bounds = [length_bounds(n, threshold) for n in self.sizes]

    def spans(self, text: str | None) -> list[tuple[float, int, int, int]]:
        """(-dice, template, first bigram, bigrams) of the best span of each template that reaches the threshold; of equals the earliest, then the shortest."""
        words = normalise(text or "")
        owners = self.owners
        hits: dict[int, list[tuple[int, tuple[str, str]]]] = {}
        for at, gram in enumerate(zip(words, words[1:])):
            if gram in owners:
                for k in owners[gram]:
                    hits.setdefault(k, []).append((at, gram))
        found = []
        for k, places in hits.items():
            n, (low, high) = self.sizes[k], self.bounds[k]
            least = self.threshold * (n + low) / 2
            if len(places) < least - 1e-9:
                continue
            counts = self.counts[k]
            best: tuple | None = None
            reach = 0
            for i, (a, _) in enumerate(places):
                # a span that begins here holds no more template bigrams than lie within its greatest length
                while reach < len(places) and places[reach][0] - a < high:
                    reach += 1
                if reach - i < least - 1e-9:
                    continue
                seen: Counter = Counter()
                overlap = 0
                for b, gram in places[i:reach]:
                    size = b - a + 1
                    seen[gram] += 1
                    if seen[gram] <= counts[gram]:
                        overlap += 1
                    if size >= low:
                        dice = 2 * overlap / (size + n)
                        if dice >= self.threshold and (best is None or (-dice, k, a, size) < best):
                            best = (-dice, k, a, size)
            if best:
                found.append(best)
        return found

    def notices(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """Template, dice, first word and end word (exclusive) of each notice, in order of place.

        Of spans that share a word the one of the higher dice stays; ties go to the longer one, then to the template first by name. A text under two licences has two.
        """
        kept: list[tuple[float, int, int, int]] = []
        for span in sorted(self.spans(text), key=lambda x: (x[0], -x[3], x[1])):
            if all(span[2] > a + n or a > span[2] + span[3] for _, _, a, n in kept):
                kept.append(span)
        return [(self.names[k], -dice, a, a + n + 1) for dice, k, a, n in sorted(kept, key=lambda x: x[2])]


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, first_word, end_word of each licence notice of each document; see Matcher.notices().

    Words count from 0 in the normalised text; end_word is exclusive. Whole texts are read, however long. Documents without
    a span at the threshold, and null or empty texts, give no row; a null doc_id stays null; repeated rows give
    repeated rows; other columns are ignored; an empty table gives an empty result.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for at, text in enumerate(part.column(1).to_pylist()):
                    if text:
                        rows += [(at, *notice) for notice in matcher.notices(text)]
                if rows:
                    at, name, dice, first, end = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pc.take(part.column(0), pa.array(at)), pa.array(name), pa.array(dice), pa.array(first, pa.int64()), pa.array(end, pa.int64())],
                        ["doc_id", "license", "dice", "first_word", "end_word"],
                    )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, license string, dice double, first_word long, end_word long")


def license_sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for license_scan over a table documents whose doc_id is unique."""
    templates = TEMPLATES if templates is None else templates
    rows, sizes = [], []
    for k, name in enumerate(sorted(templates)):
        words = normalise(templates[name])
        counts = Counter(zip(words, words[1:]))
        low, high = length_bounds(counts.total(), threshold)
        sizes.append(f"({k},'{name}',{counts.total()},{low},{high})")
        rows += [f"({k},'{a} {b}',{c})" for (a, b), c in counts.items()]
    return f"""
WITH tpl(k, license, n, low, high) AS (VALUES {",".join(sizes)}),
tg(k, gram, c) AS (VALUES {",".join(rows)}),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest(range(0, len(ws) - 1)) AS pos, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS gram
      FROM w WHERE len(ws) > 1),
h AS (SELECT g.doc_id, tg.k, g.pos, g.gram, tg.c FROM g JOIN tg USING (gram)),
s AS (SELECT a.doc_id, a.k, a.pos AS a, b.pos AS b, t.n FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.k = b.k AND b.pos >= a.pos
      JOIN tpl t ON t.k = a.k WHERE b.pos - a.pos + 1 BETWEEN t.low AND t.high),
o AS (SELECT s.doc_id, s.k, s.a, s.b, s.n, h.gram, least(count(*), any_value(h.c)) AS m
      FROM s JOIN h ON h.doc_id = s.doc_id AND h.k = s.k AND h.pos BETWEEN s.a AND s.b GROUP BY ALL),
d AS (SELECT doc_id, k, a, b, 2.0::DOUBLE * sum(m)::DOUBLE / (b - a + 1 + n)::DOUBLE AS dice FROM o GROUP BY doc_id, k, a, b, n),
e AS (SELECT * FROM d WHERE dice >= {threshold} QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY dice DESC, a, b) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, b - a DESC, k) AS r FROM e),
l AS (SELECT doc_id, list({{'k': k, 'a': a, 'b': b + 2, 'dice': dice}} ORDER BY r) AS spans FROM r GROUP BY doc_id),
z AS (SELECT doc_id, unnest(list_reduce(list_transform(spans, lambda x: [x]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: y.a < x[1].b AND x[1].a < y.b)) = 0 THEN list_concat(kept, x) ELSE kept END)) AS s FROM l)
SELECT doc_id, license, s.dice AS dice, s.a AS first_word, s.b AS end_word FROM z JOIN tpl t ON t.k = s.k
"""
