"""License scans (operator 2): patience alignment of texts with license templates.

Words that occur once in a stretch of text and once in the template are
anchors; the longest increasing subsequence of their positions is kept, and the
gaps between anchors are aligned in the same way, down to gaps without anchors,
which are matched from both ends.  Coverage is the share of the template's words
that are aligned.

A text can hold a notice several times, and long texts hold few unique words,
so texts are aligned in windows: neighbouring pairs of template words are looked
up in the text, and pairs that agree on where the template would begin make one
window of twice the template's length.  Windows of one template that cover too
little of it are put together, by the longest increasing subsequence of what
they aligned, so a notice with other words in between is found as long as it
stretches over at most ``reach`` times the template's length (templates of fewer
than ``LONG`` words, whose words are met anywhere, must lie in one window).
Before all this a text must hold one of a template's longest words, which every
reported match must.

Rows: one per match of a row's text, so repeated ids repeat their matches.
Null and empty texts have none.  Overlapping matches keep the larger coverage,
then the longer template, then the first by name.  Very long texts are read
whole.  Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.common import table, text_of

COVERAGE = 0.8
#: How many times its template's length a match may stretch over, and words of a template that may be met in pieces.
REACH, LONG = 6, 20
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
#: Beginnings of words that any text holds; they make poor filters.
_COMMON = {w[:k] for w in "the under and this that with any not may you from work free one can provided other".split() for k in range(3, 8)}

TEMPLATES = {
    "MIT": "Released under the MIT License",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words(text: str) -> list[str]:
    """The lower-cased words of a text; dots and hyphens inside a word belong to it."""
    return [w.lower() for w in _WORD.findall(text)]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first part, whose second parts rise (patience sorting)."""
    tops: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        before.append(last[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            last.append(k)
        else:
            tops[pile], last[pile] = b, k
    out: list[tuple[int, int]] = []
    k = last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions of equal words in ``a`` and ``b``, both rising."""
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
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a.get(w) == 1}
        anchors = increasing([(i, once[w]) for i, w in enumerate(a[a0:a1], a0) if w in once])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        work += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:])]
    return sorted(out)


@dataclass(frozen=True)
class Match:
    license: str
    coverage: float
    start: int  # words of the text, end exclusive
    end: int
    aligned: int


class Scanner:
    """Templates prepared for scanning; ``coverage`` is the least share of a template's words, ``reach`` how many times its length a match may have."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE, reach: int = REACH):
        self.reach = reach
        self.coverage, self.templates = coverage, {n: words(t) for n, t in sorted(templates.items())}
        self.pairs = {n: {} for n in self.templates}
        for name, t in self.templates.items():
            for k in range(len(t) - 1):
                self.pairs[name].setdefault((t[k], t[k + 1]), []).append(k)
        self.wanted = {p for pairs in self.pairs.values() for p in pairs}
        self.stems = self._stems()

    def _stems(self) -> list[str]:
        """Few strings of which every match holds one: a match misses at most (1 - coverage) of a template's words, and the words that hold a stem are more."""
        need = {n: int((1 - self.coverage) * len(t) + 1e-9) + 1 for n, t in self.templates.items()}
        stems: list[str] = []
        left = {n: list(t) for n, t in self.templates.items()}
        while any(need.values()):
            gains: Counter[str] = Counter()
            for name, t in left.items():
                inside: Counter[str] = Counter(w[:k] for w in t for k in range(3, 8) if len(w) >= k)
                for stem, times in inside.items():
                    gains[stem] += min(need[name], times)
            stem = max(gains, key=lambda x: (gains[x] * (0.01 if x in _COMMON else len(x) >= 5 or 0.5), len(x), x))
            stems.append(stem)
            for name, t in left.items():
                need[name] = max(0, need[name] - sum(w.startswith(stem) for w in t))
                left[name] = [w for w in t if not w.startswith(stem)] if need[name] else []
        return stems

    def windows(self, text: list[str], places: dict[tuple[str, str], list[int]], name: str) -> list[tuple[int, int]]:
        """Stretches of the text that may hold the template, merged by where it would begin."""
        size = len(self.templates[name])
        begins = sorted(i - k for pair, ks in self.pairs[name].items() for i in places.get(pair, ()) for k in ks)
        out: list[tuple[int, int]] = []
        slack, k = max(4, size // 2), 0
        while k < len(begins):
            first = begins[k]
            out.append((max(0, first - slack), min(len(text), first + size + slack)))
            while k < len(begins) and begins[k] <= first + slack // 2:
                k += 1
        return out

    def scan(self, content: str) -> list[Match]:
        low = content.lower()
        if not any(stem in low for stem in self.stems):
            return []
        text = words(content)
        places: dict[tuple[str, str], list[int]] = {}
        for i, pair in enumerate(zip(text, text[1:])):
            if pair in self.wanted:
                places.setdefault(pair, []).append(i)
        found: list[Match] = []
        for name, template in self.templates.items():
            parts: list[list[tuple[int, int]]] = []
            for start, end in self.windows(text, places, name):
                pairs = [(start + i, k) for i, k in align(text[start:end], template)]
                if pairs and len(pairs) >= self.coverage * len(template):
                    found.append(self._match(name, pairs))
                elif pairs:
                    parts.append(pairs)
            if len(template) >= LONG:
                found += self._together(name, parts)
        kept: list[Match] = []
        begins: list[int] = []
        for m in sorted(found, key=lambda m: (-m.coverage, -m.aligned, m.end - m.start, m.license, m.start)):
            at = bisect_left(begins, m.start)
            if (at == 0 or kept[at - 1].end <= m.start) and (at == len(kept) or kept[at].start >= m.end):
                begins.insert(at, m.start)
                kept.insert(at, m)
        return kept

    def _match(self, name: str, pairs: list[tuple[int, int]]) -> Match:
        return Match(name, len(pairs) / len(self.templates[name]), pairs[0][0], pairs[-1][0] + 1, len(pairs))

    def _together(self, name: str, parts: list[list[tuple[int, int]]]) -> list[Match]:
        """Matches made of several windows' alignments, each beginning with the first window that isn't in a match yet."""
        size, out, first = len(self.templates[name]), [], 0
        parts = sorted(parts)
        while first < len(parts) - 1:
            begin = parts[first][0][0]
            last = first
            while last < len(parts) and parts[last][0][0] < begin + self.reach * size:
                last += 1
            near = {p for part in parts[first:last] for p in part if p[0] < begin + self.reach * size}
            pairs = increasing(sorted(near, key=lambda p: (p[0], -p[1])))
            if last - first > 1 and len(pairs) >= self.coverage * size:
                out.append(self._match(name, pairs))
                while first < len(parts) and parts[first][0][0] <= pairs[-1][0]:
                    first += 1
            else:
                first += 1
        return out


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, id: str = "doc_id", text: str = "text", coverage: float = COVERAGE, reach: int = REACH) -> DataFrame:
    """``id, license, coverage, start_word, end_word, aligned_words`` of every match; see the module."""
    kind = docs.schema[id].dataType.simpleString()
    chosen = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, coverage, reach)
        for batch in batches:
            rows = [(k, m) for k, content in enumerate(batch.column("text")) for m in scanner.scan(content.as_py())]
            if rows:
                ids = batch.column("id").take(pa.array([k for k, _ in rows]))
                ms = [m for _, m in rows]
                yield pa.record_batch({"id": ids, "license": pa.array([m.license for m in ms]), "coverage": pa.array([round(m.coverage, 6) for m in ms]), "start_word": pa.array([m.start for m in ms], pa.int64()), "end_word": pa.array([m.end for m in ms], pa.int64()), "aligned_words": pa.array([m.aligned for m in ms], pa.int64())})

    found = docs.select(F.col(id).alias("id"), text_of(text).alias("text")).mapInArrow(run, f"id {kind}, license string, coverage double, start_word long, end_word long, aligned_words long")
    return found.withColumnRenamed("id", id)


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return license_matches(table(spark, sf_dir, "documents"))
