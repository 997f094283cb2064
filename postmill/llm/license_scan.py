"""Operator 1, license scans.

Templates are short license notices and permission texts.  Their word
k-grams are winnowed (the smallest hash of every ``WINDOW`` neighbours) into
an inverted index from fingerprint to (template, position), and so many of
their longest words (anchors) that a match at the coverage must hold one; the
index is of the size of the template table, which is code, not data.  A text's
words are hashed and looked up the same way; where a window around a hit's
diagonal holds words enough, banded alignments of it with the template give
the matched words, the coverage and the span.  What lies before and after an
accepted span is aligned again, so every place has its row.  Any alignment
within ``BAND`` words of a diagonal that reaches the coverage is found.

The whole job is one narrow stage over the texts: no shuffle, memory bounded
by one text's words.

Defined results: null and empty texts give no row; a template that occurs
several times in a text gives a row for each place (spans of one template do
not overlap); among overlapping regions
of several templates all that reach the coverage are reported; repeated rows
repeat their findings; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.shared import blocks, bounded_batches, documents, texts_of

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8

# Public license notices and permission texts.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def bare(word: str) -> str:
    """A word without case and outer punctuation."""
    return word.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


class _WordHash(dict):
    """Hashes of bare words by raw word, remembered up to a bound; 0 for a
    word that is punctuation only."""

    def __missing__(self, word: str) -> int:
        w = bare(word)
        h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) | 1 if w else 0
        if len(self) < 300_000:
            self[word] = h
        return h


_HASHES = _WordHash()


_WORD = re.compile(r"\S+")


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words and each one's number among all its words;
    words of punctuation only are left out."""
    words = _WORD.findall(text)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    at = np.flatnonzero(h)
    return h[at], at


def grams(h: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hashes of all k-grams of a hashed text."""
    n = len(h) - gram + 1
    if n < 1:
        return np.empty(0, np.uint64)
    mix, g = np.uint64(0x9E3779B97F4A7C15), np.zeros(n, np.uint64)
    for k in range(gram):
        g = (g + h[k : n + k]) * mix
        g ^= g >> np.uint64(29)
    return g


def winnow(g: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints among k-gram hashes and their positions."""
    if not len(g):
        return g, np.empty(0, np.int64)
    if len(g) < window:
        at = np.array([int(np.argmin(g))])
    else:
        views = np.lib.stride_tricks.sliding_window_view(g, window)
        at = np.unique(np.argmin(views, axis=1) + np.arange(len(views)))
    return g[at], at


class Index:
    """Inverted fingerprints and anchor words of templates, and the words that
    each must match."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.names = sorted(templates)
        self.words = [word_hashes(templates[n])[0] for n in self.names]
        self.need = [next((n for n in range(1, len(h) + 1) if n / len(h) >= coverage), len(h) + 1) for h in self.words]
        self.winnowed = self._posted([(f, t, p) for t, h in enumerate(self.words) for f, p in zip(*winnow(grams(h)))])
        self.anchors = self._posted([(self.words[t][p], t, p) for t, n in enumerate(self.names) for p in self._longest(templates[n])[: len(self.words[t]) - self.need[t] + 1]])

    @staticmethod
    def _longest(template: str) -> list[int]:
        """Positions of the template's words, the longest first."""
        words = [w for w in map(bare, _WORD.findall(template)) if w]
        return sorted(range(len(words)), key=lambda p: (-len(words[p]), p))

    @staticmethod
    def _posted(found: list) -> tuple[np.ndarray, list[tuple[int, int]]]:
        found = sorted(found)
        return np.array([f for f, _, _ in found], np.uint64), [(t, int(p)) for _, t, p in found]

    def hits(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, position in the template, position in the text)."""
        out = []
        for (prints, postings), (seen, at) in ((self.winnowed, winnow(grams(h))), (self.anchors, (h, np.arange(len(h))))):
            if not len(prints) or not len(seen):
                continue
            low = np.searchsorted(prints, seen)
            for i in np.flatnonzero(prints[np.minimum(low, len(prints) - 1)] == seen):
                j = int(low[i])
                while j < len(prints) and prints[j] == seen[i]:
                    out.append((*postings[j], int(at[i])))
                    j += 1
        return out


@lru_cache(maxsize=4)
def _index(items: tuple, coverage: float) -> Index:
    return Index(dict(items), coverage)


def banded(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Longest common subsequence of ``template`` and ``text`` whose matches
    stay within ``band`` of the diagonal text = template + shift; matched
    words and the text span [first, last) of the matches (the earliest end,
    then the latest start among equals)."""
    width = 2 * band + 1
    best = [(0, 0)] * (width + 1)  # per diagonal of the row above: (matched, -first)
    top, end = (0, 0), -1
    for i in range(len(template)):
        row = [(0, 0)] * (width + 1)
        for d in range(width):
            j = i + shift + d - band
            here = max(best[d + 1] if d + 1 < width else (0, 0), row[d - 1] if d else (0, 0))
            if 0 <= j < len(text) and text[j] == template[i]:
                n, first = best[d]
                here = max(here, (n + 1, first if n else -j))
                if here > top and here[0] == n + 1:
                    top, end = here, j + 1
            row[d] = here
        best = row
    return top[0], -top[1], end


def best_near(words: np.ndarray, h: np.ndarray, inside: np.ndarray, lo: int, hi: int, shift: int, need: int, tried: set, band: int) -> tuple[int, int, int]:
    """The best alignment on the diagonals within ``band`` of ``shift`` that
    were not tried: matched words and span in ``h``; (0, 0, 0) if none has
    ``need`` words.  ``inside`` counts the text's words that are template words."""
    best, wide = (0, 0, 0), slice(max(lo, shift - 2 * band), max(lo, min(hi, shift + len(words) + 2 * band)))
    if inside[wide.stop] - inside[wide.start] < need or (Counter(words.tolist()) & Counter(h[wide].tolist())).total() < need:
        return best
    for middle in sorted(range(shift - band, shift + band + 1), key=lambda c: abs(c - shift)):
        if middle in tried:
            continue
        tried.add(middle)
        low, top = max(lo, middle - band), min(hi, middle + len(words) + band)
        if top <= low or inside[top] - inside[low] < need:
            continue
        matched, first, last = banded(words, h[low:top], middle - low, band)
        if matched >= need and matched > best[0]:
            best = matched, low + first, low + last
            if matched == len(words):
                break
    return best


def places(words: np.ndarray, h: np.ndarray, hits: list[tuple[int, int]], need: int, band: int = BAND) -> Iterator[tuple[int, int, int]]:
    """(matched words, first, last) of every place of a template in a hashed
    text; ``hits``: sorted (position in the text, diagonal)."""
    inside, left = np.append(0, np.cumsum(np.isin(h, words))), [(0, len(h), 0, len(hits))]
    while left:
        lo, hi, i, j = left.pop()
        tried: set[int] = set()
        for k in range(i, j):
            matched, first, last = best_near(words, h, inside, lo, hi, hits[k][1], need, tried, band) if hits[k][1] not in tried else (0, 0, 0)
            if matched:
                yield matched, first, last
                left += [(lo, first, k, bisect_left(hits, (first,), k, j)), (last, hi, bisect_left(hits, (last,), k, j), j)]
                break


def findings(text: str, index: Index, band: int = BAND) -> list[tuple[str, int, int, float, int, int]]:
    """(template, matched words, template words, coverage, start, end) of a
    text; start and end are code points of the text."""
    h, numbers = word_hashes(text)
    by: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for t, p, q in index.hits(h):
        by[t].add((q, q - p))
    out, spans = [], None
    for t, hits in by.items():
        words = index.words[t]
        for matched, first, last in places(words, h, sorted(hits), index.need[t], band):
            if spans is None:
                spans = [m.span() for m in _WORD.finditer(text)]
            out.append((index.names[t], matched, len(words), matched / len(words), spans[numbers[first]][0], spans[numbers[last - 1]][1]))
    return sorted(out)


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per template and place: doc_id, license, matched_words,
    template_words, coverage, span_start, span_end (code points)."""
    items = tuple(sorted(templates.items()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items, coverage)
        for block in blocks(batches):
            of, found = [], []
            for i, t in enumerate(texts_of(block)):
                for f in findings(t, index):
                    of.append(i)
                    found.append(f)
            columns = list(zip(*found)) or [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([block.column("doc_id").take(pa.array(of, pa.int32())), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], ["doc_id", "license", "matched_words", "template_words", "coverage", "span_start", "span_end"])

    schema = "doc_id long, license string, matched_words long, template_words long, coverage double, span_start long, span_end long"
    return bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, schema)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
