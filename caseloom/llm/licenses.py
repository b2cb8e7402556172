"""Operator 1: license scans by patience alignment.

Texts and templates are sequences of words (lower case; split at ASCII white
space and punctuation).  A stretch of the text of about one and a half template
lengths is a candidate where it holds enough distinct words of the template;
below that no alignment reaches the coverage asked for.  Each candidate is
aligned: words that are unique in both sequences are anchors, the longest
increasing subsequence of anchors is kept, and the gaps between them are aligned
in the same way.  A gap without anchors is settled by its exact longest common
subsequence (bit-parallel).  Coverage is the share of template words aligned.
The words that tell licenses and versions apart (braces in a template) must all be
aligned, side by side, whatever the coverage.

After a match the scan goes on behind it, so repeated notices are all found; after
a failure it goes on a quarter of the template further, which a stretch of one and a
half lengths covers, so cost is linear in the text.  Of overlapping notices the best
stays (ties: the first name).  Null and empty texts match nothing; very long texts are
read whole; repeated rows give repeated results; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .flat import MARKS, chunks, flat, hashes, lean, spans

# Wordings of public license notices.  Words in braces decide: they tell one license
# or version from another, and must all be aligned, one next to the other.
TEMPLATES = {
    "agpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the {GNU Affero General Public License} as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "all-rights-reserved": "{All rights reserved}.",
    "apache-2.0": "Licensed under the {Apache License}, Version {2.0}.",
    "apache-2.0-notice": """Licensed under the {Apache License}, Version {2.0} (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "boost-1.0": "Distributed under the {Boost Software License}, Version {1.0}.",
    "bsd-2-clause": "Released under the BSD {2-Clause} License.",
    "bsd-3-clause": "Released under the BSD {3-Clause} License.",
    "bsd": "Released under the {BSD License}.",
    "bsd-2-clause-notice": """{Redistribution and use in source and binary forms}, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "bsd-3-clause-notice": """{Redistribution and use in source and binary forms}, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to {endorse or promote products} derived from this software without specific prior written permission.""",
    "cc0-1.0": "To the extent possible under law, the author has {waived all copyright and related} or neighboring rights to this work.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the {Eclipse Public License 2.0}.",
    "gpl-2.0": "This work is licensed under the {GNU General Public License}, version {2}.",
    "gpl-2.0-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the {GNU General Public License} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "gpl-3.0": "This work is licensed under the {GNU General Public License}, version {3}.",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the {GNU General Public License} as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "isc": """{Permission to use, copy, modify}, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "lgpl-2.1-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the {GNU Lesser General Public License} as published by the Free Software Foundation; either version {2.1} of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "lgpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the {GNU Lesser General Public License} as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "mit": "Released under the {MIT License}.",
    "mit-notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of {this software and associated documentation files} (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "mpl-1.1": """The contents of this file are subject to the {Mozilla Public License} Version {1.1} (the "License"); you may not use this file except in compliance with the License.""",
    "mpl-2.0": "This Source Code Form is subject to the terms of the {Mozilla Public License}, v. {2.0}.",
    "unlicense": "This is {free and unencumbered software released into the public domain}.",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the {authors be held liable for any damages} arising from the use of this software.""",
}
for _parts in ("", "-NonCommercial", "-ShareAlike", "-NoDerivatives", "-NonCommercial-ShareAlike", "-NonCommercial-NoDerivatives"):
    for _version in ("3.0", "4.0"):
        _code = "BY" + _parts.replace("-NonCommercial", "-NC").replace("-ShareAlike", "-SA").replace("-NoDerivatives", "-ND")
        _name = f"cc-{_code.lower()}-{_version}"
        TEMPLATES[_name] = f"Licensed under {{CC {_code} {_version}}}."
        TEMPLATES[_name + "-notice"] = f"This work is licensed under a {{Creative Commons Attribution{_parts} {_version}}} License."

COVERAGE = 0.8


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience piles)."""
    tops: list[int] = []
    top_at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            top_at.append(i)
        else:
            tops[k], top_at[k] = v, i
        back[i] = top_at[k - 1] if k else -1
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence of two sequences as index pairs; rows of bits, one for each word of ``b``."""
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, rows = full, []
    for w in b:
        m = where.get(w, 0)
        row = (row + (row & m) | row & ~m) & full
        rows.append(row)
    # A zero bit i of row j is a place where the common length of a[:i + 1], b[:j + 1] rises.
    length = lambda i, j: i - (rows[j - 1] & (1 << i) - 1).bit_count() if i and j else 0
    i, j, out = len(a), len(b), []
    while i and j:
        if length(i, j - 1) == (now := length(i, j)):
            j -= 1
        elif length(i - 1, j) == now:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience alignment of ``a`` (template) and ``b`` (text): ascending index pairs of equal words."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        pairs = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in place]
        if not pairs:
            out.extend((a0 + i, b0 + j) for i, j in common(a[a0:a1], b[b0:b1]))
            continue
        anchors = [pairs[k] for k in increasing([j for _, j in pairs])]
        out.extend(anchors)
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            work.append((i + 1, k, j + 1, m))
    return sorted(out)


class Templates:
    def __init__(self, texts: dict[str, str], coverage: float) -> None:
        self.names = sorted(texts)
        word, first = words(pa.array([texts[n] for n in self.names], pa.string()))  # braces are punctuation
        self.decide = [deciding(texts[n]) for n in self.names]
        self.words = [word[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        self.vocabulary = np.unique(word)
        self.bloom = np.zeros(1 << 20, bool)
        self.bloom[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        self.member = [np.isin(self.vocabulary, np.array(w, np.uint64)) for w in self.words]
        self.least = [math.ceil(coverage * len(w) - 1e-9) for w in self.words]
        #: Aligned words that repeat in the template may lack distinct ones.
        self.distinct = [max(1, len(set(w)) - (len(w) - k)) for w, k in zip(self.words, self.least, strict=True)]
        self.reach = [len(w) + len(w) // 2 + 5 for w in self.words]

    def matches(self, word: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, template, aligned words, first word, end word) in rows of words laid end to end."""
        hit = np.flatnonzero(self.bloom[(word >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, word[hit]), len(self.vocabulary) - 1)
        real = self.vocabulary[at] == word[hit]
        hit, at = hit[real], at[real]
        row = np.searchsorted(first, hit, "right") - 1
        out = []
        for t, mine in enumerate(self.member):
            use = mine[at]
            pos, of = hit[use], row[use]
            stop = np.minimum(pos + self.reach[t], first[of + 1])
            enough = np.searchsorted(pos, stop) - np.arange(len(pos)) >= self.distinct[t]
            behind, step = -1, max(1, len(self.words[t]) // 4)
            for p, r in zip(pos[enough].tolist(), of[enough].tolist(), strict=True):
                if p < behind:
                    continue
                behind = p + step if p + step < first[r + 1] else p
                found = self._at(word, p, int(first[r]), int(first[r + 1]), t)
                if found:
                    out.append((r, t, found[0], found[1] - int(first[r]), found[2] - int(first[r])))
                    behind = found[2]
        return self._best(out)

    def _best(self, found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Of notices whose stretches overlap, the one with the most aligned words, then the fullest, then the first name."""
        kept: dict[int, list[tuple[int, int, int, int, int]]] = {}
        for m in sorted(found, key=lambda m: (m[0], -m[2], len(self.words[m[1]]) - m[2], m[1], m[3])):
            mine = kept.setdefault(m[0], [])
            if all(m[4] <= o[3] or o[4] <= m[3] for o in mine):
                mine.append(m)
        return sorted(m for mine in kept.values() for m in mine)

    def _at(self, word: np.ndarray, p: int, low: int, high: int, t: int) -> tuple[int, int, int] | None:
        template = self.words[t]
        text = word[p : min(p + self.reach[t], high)].tolist()
        if len(set(text) & set(template)) < self.distinct[t]:
            return None
        pairs = align(template, text)
        if not pairs:
            return None
        # Once more where the alignment says that the template starts.
        begin = max(low, p + min(j - i for i, j in pairs))
        text = word[begin : min(begin + self.reach[t], high)].tolist()
        pairs = align(template, text)
        if len(pairs) < self.least[t]:
            return None
        place = dict(pairs)
        if any(place.get(i) is None or i > a and place[i] != place[i - 1] + 1 for a, b in self.decide[t] for i in range(a, b)):
            return None
        return len(pairs), begin + pairs[0][1], begin + pairs[-1][1] + 1


def deciding(template: str) -> list[tuple[int, int]]:
    """Ranges of word numbers that stand in braces."""
    size = lambda part: int(words(pa.array([part], pa.string()))[1][-1])
    out, at = [], 0
    for k, part in enumerate(re.split(r"[{}]", template)):
        n = size(part)
        if k % 2 and n:
            out.append((at, at + n))
        at += n
    return out


def words(column) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = flat(pc.utf8_lower(column.cast(pa.large_string())))
    starts, ends, first = spans(buf, offs, MARKS)
    return hashes(buf, starts, ends), first


def scan(df: DataFrame, templates: dict[str, str] | None = None, text: str = "text", key: str = "doc_id", coverage: float = COVERAGE) -> DataFrame:
    """(key, license, coverage, aligned_words, first_word, end_word): each notice in each whole text."""
    texts = TEMPLATES if templates is None else templates
    schema = T.StructType([df.schema[key], T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), *(T.StructField(c, T.LongType()) for c in ("aligned_words", "first_word", "end_word"))])

    def run(batches):
        known = Templates(texts, coverage)
        for part in chunks(batches, text):
            found = known.matches(*words(part.column(text)))
            rows, of, aligned, start, end = zip(*found, strict=True) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [part.column(key).take(pa.array(rows, pa.int64())), pa.array([known.names[t] for t in of], pa.string()), pa.array([n / len(known.words[t]) for n, t in zip(aligned, of, strict=True)], pa.float64()), *(pa.array(c, pa.int64()) for c in (aligned, start, end))],
                names=schema.names,
            )

    return df.select(key, text).mapInArrow(lean(run), schema)
