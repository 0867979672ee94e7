"""Licence notices in documents: winnowed fingerprints, then banded alignment.

Templates are normalized to words. The fingerprint of ``gram`` neighbouring words is
kept where it is the smallest of a window of ``window`` neighbours, so any shared run
of gram + window - 1 words keeps a common fingerprint. The inverted index maps
fingerprints to template places. A document's own winnowed fingerprints look up the
index; hits near one diagonal that are a ``least_hits`` share of the template's make a
candidate, and a local alignment within ``band`` words of the diagonal gives the
matched words, the coverage of the template and the span in the document. Words that
tell a licence from its siblings must be among the matched: in a template of at most
``short`` words all but the phrases of any notice (``COMMON``), in a longer one the
version numbers. Of matches that overlap the one with more matched words stays.

Documents are scanned whole in one pass without a shuffle. The index is broadcast: it
is bounded by ``block_words`` template words, and more templates make more passes.

Defined results: null and empty texts match nothing; a template without words matches
nothing; repeated rows are scanned each; ties of overlapping matches go to the higher
coverage, then the earlier template; an empty table gives no rows; columns other than
id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockledger.llm.common import mix, word_bytes

# Creative Commons licences by what their names add.
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
GNU = {"GPL": ("General", "2", "3"), "LGPL": ("Lesser General", "2.1", "3"), "AGPL": ("Affero General", "3")}
DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def spdx(name: str, version: str) -> str:
    return f"{name}-{version}" if "." in version else f"{name}-{version}.0"


# Common notices (fixed values).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
    *((name, f"Released under the {name} License.") for name in ("BSD", "ISC")),
    *((f"Apache-{v}", f"Licensed under the Apache License, Version {v}.") for v in ("1.0", "1.1")),
    *((f"MPL-{v}", f"Licensed under the Mozilla Public License, Version {v}.") for v in ("1.1", "2.0")),
    *((spdx(name, v), f"This work is licensed under the GNU {title} Public License, version {v}.") for name, (title, *versions) in GNU.items() for v in versions if (name, v) != ("GPL", "3")),
    *((f"CC-{name}-{v}", f"Licensed under CC {name} {v}.") for name in CC for v in ("4.0", "3.0") if (name, v) != ("BY-NC", "4.0")),
    *((f"CC-{name}-{v}", f"This work is licensed under a Creative Commons {title} {v} {scope} License.") for name, title in CC.items() for v, scope in (("4.0", "International"), ("3.0", "Unported")) if (name, v) != ("BY", "4.0")),
    *((name, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {title} Public License") for name, (title, *_) in GNU.items() if name != "GPL"),
    *(
        (spdx(name, v), f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {title} Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.")
        for name, (title, *versions) in GNU.items()
        for v in versions
    ),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + DISCLAIMER,
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
)
# Words of short templates that any notice may have.
COMMON = frozenset(b"a the this work is released licensed under license version international unported".split())
VERSION = re.compile(rb"\d+(\.\d+)*")


@dataclass(frozen=True)
class Scan:
    gram: int = 2
    window: int = 2
    band: int = 8
    least_hits: float = 0.25
    coverage: float = 0.7
    short: int = 14
    block_words: int = 200_000


PUNCTUATION = b".,;:!?()[]{}\"'*"


def normalized(text: str | None) -> list[bytes]:
    return [w.strip(PUNCTUATION) for w in word_bytes(text)]


def winnowed(ids: np.ndarray, how: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the fingerprints of word numbers (0: a word of no template,
    whose grams are left out)."""
    n = len(ids) - how.gram + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    value = np.zeros(n, dtype=np.uint64)
    known = np.ones(n, dtype=bool)
    for i in range(how.gram):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n].astype(np.uint64))
        known &= ids[i : i + n] > 0
    value[~known] = np.iinfo(np.uint64).max
    if n <= how.window:
        kept = value == value.min()
    else:
        least = np.lib.stride_tricks.sliding_window_view(value, how.window).min(axis=1)
        kept = np.zeros(n, dtype=bool)
        for i in range(how.window):
            kept[i : i + len(least)] |= value[i : i + len(least)] == least
    at = np.flatnonzero(kept & known)
    return at, value[at]


def telling(found: Sequence[bytes], how: Scan) -> np.ndarray:
    """Which words of a template must be matched."""
    if len(found) <= how.short:
        return np.array([w not in COMMON for w in found], dtype=bool)
    return np.array([VERSION.fullmatch(w) is not None for w in found], dtype=bool)


class Index:
    """The templates of one block."""

    def __init__(self, templates: Sequence[tuple[int, str, str]], how: Scan) -> None:
        self.how, self.vocabulary = how, {}
        self.templates: list[tuple[int, str, np.ndarray, np.ndarray]] = []
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.counts: list[int] = []
        for number, name, text in templates:
            found = normalized(text)
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], dtype=np.int64)
            at, values = winnowed(ids, how)
            for p, v in zip(at.tolist(), values.tolist(), strict=True):
                self.postings[v].append((len(self.templates), p))
            self.templates.append((number, name, ids, telling(found, how)))
            self.counts.append(len(at))
        self.values = np.array(sorted(self.postings), dtype=np.uint64)

    def align(self, ids: np.ndarray, template: np.ndarray, must: np.ndarray, diagonal: int) -> tuple[int, int, int, int]:
        """Matched words, how many of them must be, first and one past the last document
        word of the best local alignment within the band (+2 a match, -1 a mismatch or
        gap)."""
        band = self.how.band
        best = (0, 0, 0, 0, 0)
        before: dict[int, tuple[int, int, int, int]] = {}
        for t, (word, told) in enumerate(zip(template.tolist(), must.tolist(), strict=True)):
            row: dict[int, tuple[int, int, int, int]] = {}
            for d in range(max(0, t + diagonal - band), min(len(ids), t + diagonal + band + 1)):
                score, matched, needed, start = before.get(d - 1, (0, 0, 0, d))
                same = ids[d] == word
                options = [(score + 2, matched + 1, needed + told, start) if same else (score - 1, matched, needed, start)]
                if d in before:
                    options.append((before[d][0] - 1, *before[d][1:]))
                if d - 1 in row:
                    options.append((row[d - 1][0] - 1, *row[d - 1][1:]))
                cell = max(options)
                if cell[0] <= 0:
                    continue
                row[d] = cell
                if same and cell[:3] > best[:3]:
                    best = (*cell, d + 1)
            before = row
        return best[1:]

    def matches(self, text: str | None) -> list[tuple[int, str, float, int, int, int]]:
        ids = np.array([self.vocabulary.get(w, 0) for w in normalized(text)], dtype=np.int64)
        at, values = winnowed(ids, self.how)
        if not len(at) or not len(self.values):
            return []
        place = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        hit = self.values[place] == values
        near: dict[tuple[int, int], set[int]] = defaultdict(set)
        for p, v in zip(at[hit].tolist(), values[hit].tolist(), strict=True):
            for t, q in self.postings[v]:
                for lane in {(p - q) // self.how.band, (p - q + self.how.band // 2) // self.how.band}:
                    near[t, lane].add(q)
        found = set()
        for (t, lane), places in near.items():
            number, name, template, must = self.templates[t]
            if len(places) < max(1, self.how.least_hits * self.counts[t]):
                continue
            matched, needed, start, end = self.align(ids, template, must, lane * self.how.band)
            if matched >= self.how.coverage * len(template) and needed == must.sum():
                found.add((matched, matched / len(template), -number, name, start, end))
        kept: list[tuple[int, str, float, int, int, int]] = []  # spans that do not meet, by where they start
        for matched, share, minus, name, start, end in sorted(found, reverse=True):
            at = bisect_left(kept, start, key=lambda k: k[4])
            if (at == len(kept) or end <= kept[at][4]) and (at == 0 or kept[at - 1][5] <= start):
                kept.insert(at, (-minus, name, share, matched, start, end))
        return kept


RESULT = "doc_id long, template int, license string, coverage double, matched long, start_word long, end_word long"


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, how: Scan = Scan()) -> DataFrame:
    """One row per notice found; words count from 0, ``end_word`` is exclusive."""
    blocks: list[list[tuple[int, str, str]]] = [[]]
    room = how.block_words
    for number, (name, text) in enumerate(templates):
        room -= len(normalized(text))
        if room < 0 and blocks[-1]:
            blocks.append([])
            room = how.block_words - len(normalized(text))
        blocks[-1].append((number, name, text))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, how))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, *m) for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in shared.value.matches(text.as_py())]
                names = [c.split()[0] for c in RESULT.split(", ")]
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                columns = zip(*rows, strict=True) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        found = given.mapInArrow(run, RESULT)
        out = found if out is None else out.unionByName(found)
    return out
