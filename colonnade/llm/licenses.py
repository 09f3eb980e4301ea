"""License notices in documents, by patience alignment with templates.

Two word sequences are aligned by the words that occur once in each: their longest increasing subsequence
anchors the alignment, and the gaps between anchors are aligned the same way, after equal words at either
end of a gap.  The coverage is the share of the template's words that are aligned.

Neighbouring licences differ in a word or two, so coverage alone cannot tell them apart: the words that name
a licence must be among those aligned, and words that name a neighbour must not stand in a gap.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.tables import filled, table

COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

# Notices as their publishers word them, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This work is licensed under the Mozilla Public License, version 2.0.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ],
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-ND-4.0": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-NC-SA-4.0": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-ND-4.0": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ],
}
# Words that name a licence, all of which a notice holds as far as its template does.
NAMING = {
    "Apache-2.0": "apache 2.0",
    "MPL-2.0": "mozilla 2.0",
    "MIT": "mit sublicense",
    "ISC": "isc fee provided copies",
    "0BSD": "fee granted",
    "GPL-3.0": "gnu 3",
    "GPL-2.0": "gnu 2",
    "LGPL-3.0": "lesser 3",
    "LGPL-2.1": "lesser 2.1",
    "AGPL-3.0": "affero 3",
    "BSD": "bsd redistribution binary",
    "BSD-2-Clause": "bsd 2 redistributions reproduce",
    "BSD-3-Clause": "bsd 3 redistributions reproduce neither endorse",
    "CC-BY-4.0": "cc by creative attribution 4.0",
    "CC-BY-SA-4.0": "cc by sa creative attribution sharealike 4.0",
    "CC-BY-ND-4.0": "cc by nd creative attribution noderivatives 4.0",
    "CC-BY-NC-4.0": "cc by nc creative attribution noncommercial 4.0",
    "CC-BY-NC-SA-4.0": "cc by nc sa creative attribution noncommercial sharealike 4.0",
    "CC-BY-NC-ND-4.0": "cc by nc nd creative attribution noncommercial noderivatives 4.0",
}
# Words that turn a notice into a neighbour's, wherever its own template does not hold them.
FOREIGN = "lesser library affero nc sa nd noncommercial sharealike noderivatives advertising apache mit isc mozilla gnu"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal words, increasing in both; gaps are kept on a stack, not on Python's."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once = [{w for w, n in Counter(s).items() if n == 1} for s in (a[a0:a1], b[b0:b1])]
        common = once[0] & once[1]
        place = {b[j]: j for j in range(b0, b1) if b[j] in common}
        tails, ends, back, chain = [], [], {}, []
        for i in range(a0, a1):
            if a[i] in common:
                j = place[a[i]]
                k = bisect.bisect_left(tails, j)
                back[(i, j)] = ends[k - 1] if k else None
                tails[k : k + 1], ends[k : k + 1] = [j], [(i, j)]
        step = ends[-1] if ends else None
        while step:
            chain.append(step)
            step = back[step]
        chain.reverse()
        if chain:
            out += chain
            edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


class Scanner:
    """Templates, and the bounds that a text must reach before it is aligned."""

    def __init__(self, templates: dict[str, list[str]], coverage: float, naming: dict[str, str], foreign: str):
        self.coverage = coverage
        self.templates = [(name, k, w) for name, texts in templates.items() for k, t in enumerate(texts) if (w := words_of(t))]
        self.kinds = [(set(w), int((1 - coverage) * len(w) + 1e-9)) for _, _, w in self.templates]
        named = [set(naming.get(name, "").split()) & kind for (name, _, _), (kind, _) in zip(self.templates, self.kinds, strict=True)]
        others = [set(foreign.split()) - kind if name in naming else set() for (name, _, _), (kind, _) in zip(self.templates, self.kinds, strict=True)]
        self.marks = list(zip(named, others, strict=True))
        self.all = set().union(*(s for s, _ in self.kinds)) if self.kinds else set()

    def scan(self, text: str) -> list[dict]:
        words = words_of(text)
        known = self.all.intersection(words)
        found = []
        for which, (kind, spare) in enumerate(self.kinds):
            if len(kind - known) > spare or not self.marks[which][0] <= known:  # too many of its words are missing, or one that names it
                continue
            found += [(which, c, i, j) for c, i, j in self._notices(words, which)]
        return [
            {"license": self.templates[w][0], "template": self.templates[w][1], "coverage": c, "first_word": i, "last_word": j}
            for w, c, i, j in found
            if not any(self._within((w, i, j), (v, k, m)) for v, _, k, m in found)
        ]

    def _within(self, one: tuple[int, int, int], other: tuple[int, int, int]) -> bool:
        """Whether a notice is a part of another licence's notice, whose template is longer."""
        (own, _, mine), (name, _, words) = self.templates[one[0]], self.templates[other[0]]
        return own != name and len(mine) < len(words) and other[1] <= one[1] and one[2] <= other[2]

    def _notices(self, words: list[str], which: int) -> Iterator[tuple[float, int, int]]:
        """Disjoint stretches, from left to right, that hold enough of the template in no more than its length and a spare."""
        template, (kind, spare) = self.templates[which][2], self.kinds[which]
        least, width = len(template) - spare, -(-int(1000 * len(template) / self.coverage) // 1000)
        spots = [i for i, w in enumerate(words) if w in kind]
        k = 0
        while k + least <= len(spots):
            start = spots[k]
            if spots[k + least - 1] - start < width:
                pairs = patience(words[start : start + width], template)
                if len(pairs) >= least and pairs[0][0] == 0 and self._named(words[start : start + pairs[-1][0] + 1], pairs, which):
                    yield len(pairs) / len(template), start, start + pairs[-1][0]
                    k = bisect.bisect_right(spots, start + pairs[-1][0])
                    continue
            k += 1

    def _named(self, stretch: list[str], pairs: list[tuple[int, int]], which: int) -> bool:
        needed, foreign = self.marks[which]
        aligned = {i for i, _ in pairs}
        return needed <= {stretch[i] for i in aligned} and not any(w in foreign for i, w in enumerate(stretch) if i not in aligned)


def license_notices(
    docs: DataFrame,
    templates: dict[str, list[str]] | None = None,
    coverage: float = COVERAGE,
    text: str = "text",
    naming: dict[str, str] | None = None,
    foreign: str | None = None,
) -> DataFrame:
    """Every document with the license notices in it.

    A notice is a stretch of words that begins with a word of the template, is at most 1 / ``coverage``
    times as long, and covers ``coverage`` of the template's words in the patience alignment.  Of a
    licence in ``naming`` the words given there are aligned, as far as the template holds them, and none of
    ``foreign`` stands in a gap; without templates of one's own both are those of this module.  A notice
    inside one of another licence with a longer template is a part of that and not listed.  A document is
    scanned as a whole, in the task that reads it.  Null and empty texts hold none; null ids and
    repeated rows are kept.  Returns doc_id, n_notices, licenses (distinct, sorted) and notices (license,
    template, coverage, first_word, last_word).
    """
    marks = (NAMING, FOREIGN) if templates is None else ({}, "")
    scanner = Scanner(TEMPLATES if templates is None else templates, coverage, marks[0] if naming is None else naming, marks[1] if foreign is None else foreign)
    kind = "array<struct<license:string,template:int,coverage:double,first_word:int,last_word:int>>"
    arrow = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("coverage", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "notices": pa.array([scanner.scan(t.as_py()) for t in batch.column("_text")], arrow)})

    rows = docs.select("doc_id", filled(text).alias("_text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, notices {kind}")
    names = F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["license"])))
    return rows.select("doc_id", F.size("notices").cast("long").alias("n_notices"), names.alias("licenses"), "notices")


def op4_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_notices(table(spark, sf_dir, "documents"))
