"""License scan: winnowed template fingerprints, an inverted index, banded alignment.

Words are runs of ASCII letters and digits and non-ASCII characters, lower-cased (A-Z).
A template of m words matches where at least ``min_coverage`` of them stand in order, so at most
k = m - ceil(min_coverage * m) are missing. Its single words are winnowed (in every window of
consecutive word hashes the smallest is a fingerprint) with the largest window that leaves more
than k fingerprints, kept with their places in an inverted index: whatever words are changed,
missing or added, one fingerprint is among the words that match. Every fingerprint found in a
document is a seed. Seeds around which too few of the template's words stand, in any order, are
passed over; from the others a banded alignment runs to both sides, matching template words to
document words in order, allowing changed, missing and further words, at most ``BAND`` diagonals
(k, if that is more) away from the seed. Coverage is the share of the template's words that match; spans of at least
``min_coverage`` are reported in words and in characters, each span once per template. Spans of one
template don't overlap: of notices that follow one another each has its own. Of near variants the best
wins: the operator drops a match whose matched words all match another template, too, that has
more matched words there, or as many and a larger coverage; equal ones stay.

Defined results: null and empty texts have no matches. A template without words matches nothing.
Repeated rows are scanned alike. Matches are sorted by start, then template. An empty table
gives no rows. Templates are a parameter, bounded by what the caller passes (they travel with
the tasks); documents are only scanned, never shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commune.llm.common import table, text_or_empty
from commune.llm.license_texts import TEXTS

SHINGLE, WINDOW, BAND, MIN_COVERAGE = 3, 4, 8, 0.8

# Public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
        "OF ANY KIND, either express or implied."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so"),
    **TEXTS,
}

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_NEVER = -(1 << 60)


def normalized(text: str) -> bytes:
    """Same length in bytes as the text in UTF-8; words stand between spaces."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP)


def winnow(words: list[bytes], shingle: int = SHINGLE, window: int = WINDOW) -> list[tuple[int, int]]:
    """(hash, place) of the fingerprints; the rightmost of equal minima."""
    size = min(shingle, len(words))
    if not size:
        return []
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + size])) for i in range(len(words) - size + 1)]
    picked = set()
    for k in range(max(1, len(h) - window + 1)):
        part = h[k:k + window]
        least = min(part)
        picked.add(k + max(i for i, x in enumerate(part) if x == least))
    return [(h[i], i) for i in sorted(picked)]


def fingerprints(words: list[bytes], missing: int) -> list[tuple[int, int]]:
    """Winnowed single words, more than ``missing`` of them, by the largest window that gives so many."""
    for window in range(len(words), 0, -1):
        found = winnow(words, 1, window)
        if len(found) > missing:
            return found
    return []


def extend(template: tuple[bytes, ...], words: tuple[bytes, ...], band: int = BAND,
           by_score: bool = False) -> tuple[int, int, int]:
    """(matches, score, end) of the best alignment of ``template`` with the start of ``words``.

    Template word i meets document words i - band to i + band. A match scores 2; a changed, missing or
    further word costs 1. The most matches are best, then the highest score (``by_score``: the highest
    score, then the most matches), then the fewest words.
    """
    width = 2 * band + 1
    # A cell holds (matches, score, - end of the last matched word), with ``by_score`` the score first;
    # column c of row i is word i + c - band. Row -1 stands before the first template word: only further words.
    (hit_1, hit_2), (gap_1, gap_2) = ((2, 1), (-1, 0)) if by_score else ((1, 2), (0, -1))
    none = (_NEVER, 0, 0)
    before = [none] * (width + 2)
    for c in range(band, width):
        before[c + 1] = ((c - band) * gap_1, (c - band) * gap_2, 0)
    best = (0, 0, 0)
    for i, w in enumerate(template):
        row = [none] * (width + 2)
        for c in range(1, width + 1):
            j = i + c - 1 - band
            if j < -1 or j >= len(words):
                continue
            # Cell (i, j): template words up to i and document words up to j are used.
            d, up, left = before[c], before[c + 1], row[c - 1]
            here = none
            if j >= 0 and d is not none:
                if words[j] == w:
                    here = (d[0] + hit_1, d[1] + hit_2, -(j + 1))
                    best = max(best, here)
                else:
                    here = (d[0] + gap_1, d[1] + gap_2, d[2])
            if up is not none:
                here = max(here, (up[0] + gap_1, up[1] + gap_2, up[2]))
            if left is not none:
                here = max(here, (left[0] + gap_1, left[1] + gap_2, left[2]))
            row[c] = here
        before = row
    return (best[1], best[0], -best[2]) if by_score else (best[0], best[1], -best[2])


class Scanner:
    """The inverted index of a set of templates."""

    def __init__(self, templates: dict[str, str], min_coverage: float = MIN_COVERAGE, band: int = BAND):
        self.words = {name: w for name, t in templates.items() if (w := tuple(normalized(t).split()))}
        self.min_coverage = min_coverage
        #: Matches that a template needs; its words with their counts, the longest (as a rule the rarest) first.
        self.needed = {name: next((c for c in range(1, len(w) + 1) if c / len(w) >= min_coverage), len(w) + 1)
                       for name, w in self.words.items()}
        #: Missing words alone shift the diagonal by as many.
        self.bands = {name: max(band, len(w) - self.needed[name]) for name, w in self.words.items()}
        self.counts = {name: Counter(sorted(w, key=len, reverse=True)) for name, w in self.words.items()}
        #: Template -> fingerprint word -> its places.
        self.postings: dict[str, dict[bytes, list[int]]] = {}
        for name, words in self.words.items():
            places = self.postings.setdefault(name, {})
            for _, at in fingerprints(list(words), len(words) - self.needed[name]):
                places.setdefault(words[at], []).append(at)
        self.extend = lru_cache(20_000)(extend)

    def possible(self, name: str, there) -> bool:
        """Whether enough of the template's words are in ``there``, in any order (counts are of no account)."""
        spare = len(self.words[name]) - self.needed[name]
        for w, n in self.counts[name].items():
            if w not in there:
                spare -= n
                if spare < 0:
                    return False
        return True

    def seeds(self, name: str, words: list[bytes]) -> list[tuple[int, int]]:
        """(document word, template word) of the seeds with enough of the template's words, in any order, to both sides."""
        t, need, band, places, counts = (self.words[name], self.needed[name], self.bands[name], self.postings[name],
                                         self.counts[name])
        own = [i for i, w in enumerate(words) if w in counts]
        out = []
        for i in own:
            for at in places.get(words[i], ()):
                low, high = bisect_left(own, i - at - band), bisect_left(own, i + len(t) - at + band)
                if high - low >= need:
                    here = bisect_left(own, i)
                    sides = (t[:at], own[low:here]), (t[at + 1:], own[here + 1:high])
                    if 1 + sum((Counter(part) & Counter([words[k] for k in at_])).total() for part, at_ in sides) >= need:
                        out.append((i, at))
        return out

    def through(self, name: str, words: list[bytes], i: int, at: int, low: int, high: int,
                by_score: bool = False) -> tuple[int, int, int, int]:
        """(matches, score, first word, end word) of the best alignment in which document word i is template word at.

        Only document words ``low`` to ``high`` are used.
        """
        t, band = self.words[name], self.bands[name]
        start = i - at
        if low <= start and start + len(t) <= high and tuple(words[start:start + len(t)]) == t:
            return len(t), 2 * len(t), start, start + len(t)
        m1, s1, back = self.extend(t[:at][::-1], tuple(words[max(low, start - band):i][::-1]), band, by_score)
        m2, s2, on = self.extend(t[at + 1:], tuple(words[i + 1:min(high, start + len(t) + band)]), band, by_score)
        return m1 + 1 + m2, s1 + 2 + s2, i - back, i + 1 + on

    def spans(self, name: str, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(matches, first word, end word) of the template's spans, in order, none over another.

        The span of the highest score is taken first, so that notices that follow one another are told
        apart; a seed whose span meets a taken one is aligned again with the words left free beside it.
        At last each span takes in what further matches are free between its neighbours.
        """
        need, queue, taken = self.needed[name], [], []

        def aligned(i: int, at: int, low: int, high: int) -> None:
            m, score, a, b = self.through(name, words, i, at, low, high, True)
            if m < need:
                m, score, a, b = self.through(name, words, i, at, low, high)
            if m >= need:
                heappush(queue, (-score, b - a, a, b, i, at))

        for i, at in self.seeds(name, words):
            aligned(i, at, 0, len(words))
        while queue:
            _, _, a, b, i, at = heappop(queue)
            k = bisect_left(taken, (i + 1,))
            low = taken[k - 1][1] if k else 0
            high = taken[k][0] if k < len(taken) else len(words)
            if i < low:
                continue
            if low <= a and b <= high:
                taken.insert(k, (a, b, i, at))
            else:
                aligned(i, at, low, high)
        out = []
        for k, (_, _, i, at) in enumerate(taken):
            low = out[-1][2] if out else 0
            high = taken[k + 1][0] if k + 1 < len(taken) else len(words)
            m, _, a, b = self.through(name, words, i, at, low, high)
            out.append((m, a, b))
        return out

    def scan(self, text: str) -> list[tuple[str, float, int, int, int, int]]:
        """(template, coverage, first word, end word, first character, end character), sorted."""
        line = normalized(text)
        words = line.split()
        there = set(words)
        found = [(name, m / len(t), a, b) for name, t in self.words.items() if self.possible(name, there)
                 for m, a, b in self.spans(name, words)]
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(line)]
        raw = text.encode("utf-8", "surrogatepass")
        chars = lambda k: len(raw[:k].decode("utf-8", "surrogatepass"))
        return sorted(((name, cover, a, b, chars(spans[a][0]), chars(spans[b - 1][1])) for name, cover, a, b in found),
                      key=lambda m: (m[2], m[0], m[3]))


def matched(template: tuple[bytes, ...], words: list[bytes], first: int, end: int) -> set[int]:
    """The document words from ``first`` to ``end`` that match ``template`` in order, as many as possible."""
    n, m = len(template), end - first
    most = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            same = template[i] == words[first + j]
            most[i][j] = 1 + most[i + 1][j + 1] if same else max(most[i + 1][j], most[i][j + 1])
    i = j = 0
    out = set()
    while i < n and j < m:
        if template[i] == words[first + j]:
            out.add(first + j)
            i, j = i + 1, j + 1
        elif most[i + 1][j] >= most[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def best_matches(scanner: Scanner, text: str) -> list[tuple[str, float, int, int, int, int]]:
    """The matches of ``text`` without those that a better one of another template explains."""
    found = scanner.scan(text)
    words = normalized(text).split() if len(found) > 1 else []
    sets: dict[int, set[int]] = {}

    def own(k: int) -> set[int]:
        if k not in sets:
            sets[k] = matched(scanner.words[found[k][0]], words, *found[k][2:4])
        return sets[k]

    rank = [(round(m[1] * len(scanner.words[m[0]])), m[1]) for m in found]
    longest = max((m[3] - m[2] for m in found), default=0)
    starts = [m[2] for m in found]
    out = []
    for k, m in enumerate(found):
        near = range(bisect_left(starts, m[2] - longest), bisect_left(starts, m[3]))
        if not any(found[o][3] > m[2] and found[o][0] != m[0] and rank[o] > rank[k] and own(k) <= own(o) for o in near):
            out.append(m)
    return out


def scan_column(text: Column, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> Column:
    """array<struct<template, coverage, first_word, end_word, first_char, end_char>>."""
    chosen = dict(TEMPLATES if templates is None else templates)

    @F.pandas_udf("template array<string>, coverage array<double>, first_word array<int>, end_word array<int>, "
                  "first_char array<int>, end_char array<int>")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        s = Scanner(chosen, min_coverage)
        names = ["template", "coverage", "first_word", "end_word", "first_char", "end_char"]
        for b in batches:
            rows = [list(map(list, zip(*m))) if (m := best_matches(s, t)) else [[] for _ in names] for t in b]
            yield pd.DataFrame(rows, columns=names)

    return scanned(text_or_empty(text))


def scan(documents: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, n_matches, licenses, matches), one row per row of ``documents``."""
    found = documents.select("doc_id", scan_column(F.col("text"), templates, min_coverage).alias("m"))
    zipped = F.arrays_zip(*[F.col(f"m.{c}").alias(c) for c in ("template", "coverage", "first_word", "end_word",
                                                               "first_char", "end_char")])
    return found.select("doc_id", F.size("m.template").cast("bigint").alias("n_matches"),
                        F.array_sort(F.array_distinct("m.template")).alias("licenses"), zipped.alias("matches"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
