"""License scan by patience alignment.

Text and template are words. Words that occur once in each are anchors; the longest run of anchors in the same order on both sides
is kept, and the gaps between neighbouring anchors are aligned in the same way, down to gaps whose words match from one end.
The share of a template's words that find their place is its coverage. Before a template is aligned, its coverage is bounded by the
words it has in common with the text, so most texts are done after one look-up per word. Where words of the template occur more
often than in the template (a notice that stands there twice, or prose beside it), few words are anchors; there the template is
laid through each occurrence of its rarest words and both sides are aligned by longest common runs, which is exact.
A license is told from its relatives by single words, so coverage alone does not decide: a template names the words that must be
matched (the license's name and version) and the words that must not stand between its first and last match (`Lesser`, `Affero`).
One document is one row: no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measurekit.llm.shared import by_bytes, fresh



@dataclass(frozen=True)
class Template:
    """A text that declares a license: `must` are words of it that have to be matched, `never` words that may not stand inside a match."""

    license: str
    text: str
    must: str = ""
    never: str = ""


# Names by which texts declare well-known licenses, by SPDX id: the name as it is written in notices, the words of it that must be there,
# the words that make it another license.
NAMES = (
    ("MIT", "the MIT License", "mit", ""),
    ("Apache-2.0", "the Apache License, Version 2.0", "apache 2.0", ""),
    ("Apache-1.1", "the Apache License, Version 1.1", "apache 1.1", ""),
    ("GPL-2.0", "the GNU General Public License, version 2", "general 2", "lesser library affero"),
    ("GPL-3.0", "the GNU General Public License, version 3", "general 3", "lesser library affero"),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1", "lesser 2.1", ""),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3", "lesser 3", ""),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3", "affero 3", ""),
    ("MPL-2.0", "the Mozilla Public License, Version 2.0", "mozilla 2.0", ""),
    ("EPL-2.0", "the Eclipse Public License, Version 2.0", "eclipse 2.0", ""),
    ("ISC", "the ISC License", "isc", ""),
    ("BSD", "the BSD License", "bsd", "2-clause 3-clause 4-clause"),
    ("BSD-2-Clause", "the BSD 2-Clause License", "bsd 2-clause", ""),
    ("BSD-3-Clause", "the BSD 3-Clause License", "bsd 3-clause", ""),
    ("BSL-1.0", "the Boost Software License, Version 1.0", "boost 1.0", ""),
    ("Zlib", "the zlib License", "zlib", ""),
    ("Unlicense", "the Unlicense", "unlicense", ""),
    ("CC0-1.0", "CC0 1.0", "cc0 1.0", ""),
    ("CC-BY-4.0", "CC BY 4.0", "cc by 4.0", ""),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0", "by-sa 4.0", ""),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0", "by-nc 4.0", ""),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0", "by-nd 4.0", ""),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0", "by-nc-sa 4.0", ""),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0", "by-nc-nd 4.0", ""),
    ("CC-BY-SA-3.0", "CC BY-SA 3.0", "by-sa 3.0", ""),
    ("CC-BY-3.0", "CC BY 3.0", "cc by 3.0", ""),
)
LEADS = ("Licensed under {}", "Released under {}", "This work is licensed under {}", "Distributed under the terms of {}")
TAG = "SPDX-License-Identifier: {}"
# Longer texts by which licenses are declared, the words of each that must be there, and those that make it another.
TEXTS = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "granted sublicense", ""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "permission fee granted appear", ""),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "redistribution binary permitted", ""),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "neither endorse promote", ""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache 2.0 compliance", ""),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "general 3", "lesser library affero"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "general 2", "lesser library affero"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "lesser 2.1", ""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2.0", ""),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered domain", ""),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "commons attribution 4.0", "noncommercial sharealike noderivatives noderivs attribution-noncommercial attribution-sharealike"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "commons attribution-sharealike 4.0", ""),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "commons attribution-noncommercial 4.0", ""),
)
TEMPLATES = (*(Template(spdx, lead.format(name), must, never) for spdx, name, must, never in NAMES for lead in LEADS),
             *(Template(spdx, TAG.format(spdx), f"spdx-license-identifier {spdx}") for spdx, *_ in NAMES), *(Template(*t) for t in TEXTS))
COVERAGE = 0.8
# A short template's words must lie close together: within so many times its length.
SPREAD = 3
# The words of a template of two, as a tag with several licenses behind it, may lie this far apart.
GAP = 6

WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that rises on both sides; pairs come in order of the first. Patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        p = bisect_left(tops, b)
        back.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[p], piles[p] = b, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Places (text, template) of the words that patience alignment matches, in order."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:                  # matching ends
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        at = {w: k for k, w in enumerate(template[c:d], c) if in_template[w] == 1}
        anchors = _longest_rising([(k, at[w]) for k, w in enumerate(text[a:b], a) if in_text[w] == 1 and w in at])
        if not anchors:
            continue
        found += anchors
        for (s, u), (t, v) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
            if s + 1 < t and u + 1 < v:
                todo.append((s + 1, t, u + 1, v))
    return sorted(found)


def _matched_first(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """A longest common run of both as places (text, template), as early in the text as can be. Bit-parallel: a row is one integer."""
    masks: dict[str, int] = {}
    for k, w in enumerate(template):
        masks[w] = masks.get(w, 0) | 1 << k
    full = row = (1 << len(template)) - 1
    rows, at, held = [row], [], []                          # a row after each word of the template; cleared bits are steps
    for i, w in enumerate(text):
        if mask := masks.get(w):
            u = row & mask
            new = (row + u | row - u) & full
            at.append(i)
            held.append(w)
            rows.append(new)
            row = new
    out: list[tuple[int, int]] = []
    j = len(template)
    k, need = len(at), len(template) - row.bit_count()
    while need:
        prefix = (1 << j) - 1
        while k and j - (rows[k - 1] & prefix).bit_count() == need:     # the earliest word that ends a run so long
            k -= 1
        below = masks[held[k - 1]] & prefix
        while True:                                         # of the template the last place of this word that leaves need - 1 before it
            j = below.bit_length() - 1
            if j - (rows[k - 1] & ((1 << j) - 1)).bit_count() >= need - 1:
                break
            below ^= 1 << j
        out.append((at[k - 1], j))
        k, need = k - 1, need - 1
    return out[::-1]


def _in_place(found: list[tuple[int, int]], before: list[int], least: int, stray: float) -> list[tuple[int, int]]:
    """The longest part of an alignment, `least` words or more, between whose ends at most `stray` template words are out of place.
    before: how many template words stand before each word of the text."""
    best: list[tuple[int, int]] = []
    e = 0
    for s in range(len(found) - least + 1):
        while e < len(found) and before[found[e][0] + 1] - before[found[s][0]] - (e + 1 - s) <= stray:
            e += 1
        if e - s >= max(least, len(best) + 1):
            best = found[s:e]
    return best


def align_near(text: list[str], template: list[str], need: float, reach: int, stray: float) -> list[tuple[int, int]]:
    """The longest alignment with at least `need` words within `reach` words of one of its own words, or none. Between its ends
    at most `stray` words of the template may be out of place: words of a notice in any order are none.

    If m words of the template may be missing, one of any m + 1 of its words is matched. The rarest in the text are tried first: the
    template is laid through each occurrence, and each side aligned on its own. What is found lowers m.
    """
    places: dict[str, list[int]] = {}
    for i, w in enumerate(text):
        places.setdefault(w, []).append(i)
    order = sorted(range(len(template)), key=lambda j: (len(places.get(template[j], ())), j))
    known = set(template)
    before_word = [0, *accumulate(w in known for w in text)]
    best: list[tuple[int, int]] = []
    least = ceil(need - 1e-9)
    for tried, j in enumerate(order):
        if tried > len(template) - least:                   # whoever matches none of these has too few words
            break
        for i in places.get(template[j], ()):
            if best and best[0][0] <= i <= best[-1][0] and len(best) == len(template):
                continue
            left, right = text[max(0, i - reach):i][::-1], text[i + 1:i + 1 + reach]
            if 1 + min(len(left), j) + min(len(right), len(template) - j - 1) < least:
                continue
            before = _matched_first(left, template[:j][::-1])
            if len(before) + len(template) - j < least:
                continue
            after = _matched_first(right, template[j + 1:])
            if (n := len(before) + 1 + len(after)) < least:
                continue
            found = [(i - 1 - a, j - 1 - b) for a, b in before[::-1]] + [(i, j)] + [(i + 1 + a, j + 1 + b) for a, b in after]
            if (n := len(found := _in_place(found, before_word, least, stray))) < least:
                continue
            if n > len(best) or (found[-1][0] - found[0][0], found[0][0]) < (best[-1][0] - best[0][0], best[0][0]):
                best, least = found, n
        if len(best) == len(template):
            break
    return best


class Scanner:
    def __init__(self, templates: Sequence[Template] | Mapping[str, str], coverage: float):
        if isinstance(templates, Mapping):
            templates = [Template(name, text) for name, text in templates.items()]
        self.templates = []
        for t in sorted(templates, key=lambda t: (t.license, t.text)):
            line = words(t.text)
            must = [line.index(w) for w in words(t.must)]
            self.templates.append((t.license, line, Counter(line), must, frozenset(line[k] for k in must), frozenset(words(t.never))))
        self.vocabulary = set().union(*(line for _, line, *_ in self.templates)) if self.templates else set()
        # templates by the word they cannot do without; those without such a word are always looked at
        self.by_word: dict[str | None, list[int]] = {}
        for k, (_, line, _, must, _, _) in enumerate(self.templates):
            self.by_word.setdefault(line[must[0]] if must else None, []).append(k)
        self.coverage = coverage

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, float, int, int, int]]]:
        """Number of words, and (license, coverage, matched words, first word, end) of each license found, best first: of a
        license with several templates the best.

        A template is aligned with the stretches of the text in which its words lie, each SPREAD template lengths at most
        on both sides of a word; the best stretch that holds the words it must and none it must not counts.
        """
        if not text:
            return 0, []
        line = words(text)
        seen = self.vocabulary.intersection(line)
        if not seen:
            return len(line), []
        near = [k for k, w in enumerate(line) if w in seen]
        found: dict[str, tuple[str, float, int, int, int]] = {}
        for k in sorted(k for word, ks in self.by_word.items() if word is None or word in seen for k in ks):
            name, template, count, must, needed, never = self.templates[k]
            if not needed <= seen:
                continue
            need = self.coverage * len(template)
            at = [i for i in near if line[i] in count]
            if sum((Counter(line[i] for i in at) & count).values()) < need:
                continue
            best = max((self._stretch(line, template, count, s, e, need, must, never) for s, e in self._stretches(at, len(template))), default=None)
            if best and best[0] >= need:
                here = name, best[0] / len(template), best[0], -best[1], best[2]
                if name not in found or (here[1], here[2], -here[3]) > (found[name][1], found[name][2], -found[name][3]):
                    found[name] = here
        return len(line), sorted(found.values(), key=lambda x: (-x[1], -x[2], x[0]))

    @staticmethod
    def _stretches(at: list[int], n: int) -> Iterator[tuple[int, int]]:
        """Runs of template words with gaps of at most n words (of GAP for a pair); long runs are cut into overlapping ones of 2 * SPREAD * n words."""
        s = 0
        for k in range(1, len(at) + 1):
            if k == len(at) or at[k] - at[k - 1] > (n if n > 2 else GAP):
                lo, hi = at[s], at[k - 1] + 1
                step = SPREAD * n
                for start in range(lo, max(lo + 1, hi - step), step):
                    yield start, min(hi, start + 2 * step)
                s = k

    @staticmethod
    def _stretch(line: list[str], template: list[str], count: Counter, s: int, e: int, need: float, must: list[int], never: frozenset[str]) -> tuple[int, int, int]:
        part = line[s:e]
        seen = Counter(w for w in part if w in count)
        if sum((seen & count).values()) < need or any(template[k] not in seen for k in must):
            return 0, -s, s

        def fits(pairs: list[tuple[int, int]]) -> bool:
            return len(pairs) >= need and pairs[-1][0] - pairs[0][0] < SPREAD * max(len(template), GAP if len(template) == 2 else 0) and {j for _, j in pairs}.issuperset(must) and never.isdisjoint(part[pairs[0][0]:pairs[-1][0] + 1])

        pairs = align(part, template)
        if not fits(pairs):
            pairs = []
        if len(pairs) < (seen & count).total() and any(n > count[w] for w, n in seen.items()):
            again = align_near(part, template, max(need, len(pairs) + 1), SPREAD * len(template), len(template) - need)
            pairs = again if fits(again) and len(again) > len(pairs) else pairs
        return len(pairs), -(s + pairs[0][0]) if pairs else -s, s + pairs[-1][0] + 1 if pairs else s


def scan_licenses(docs: DataFrame, templates: Sequence[Template] | Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE, *, text: str = "text") -> DataFrame:
    """Adds n_words and licenses, an array of (license, coverage, n_matched, first_word, end_word), best first, to the rows of docs.

    templates are Templates, or texts by license where coverage alone decides. A null or empty text has no words and an empty array. Ties go by
    license name; equal rows get equal answers; texts of any length are scanned whole; an empty table stays empty.
    """
    names = fresh(docs, "n_words", "licenses")
    scanner = Scanner(templates, coverage)
    column, kind = docs.columns.index(text), "array<struct<license:string,coverage:double,n_matched:long,first_word:long,end_word:long>>"
    text_name = docs.columns[column]
    found_type = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_name):
            out = [scanner.scan(t) for t in batch.column(column).to_pylist()]
            found = pa.array([[dict(zip(("license", "coverage", "n_matched", "first_word", "end_word"), x)) for x in f] for _, f in out], found_type)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([n for n, _ in out], pa.int64()), found], [*batch.schema.names, *names])

    return docs.mapInArrow(run, docs.select("*", F.lit(0).cast("long").alias(names[0]), F.lit(None).cast(kind).alias(names[1])).schema)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    best = F.get("licenses", F.lit(0))
    return out.select("doc_id", "n_words", best["license"].alias("license"), best["coverage"].alias("coverage"), best["n_matched"].alias("n_matched"),
                      best["first_word"].alias("first_word"), best["end_word"].alias("end_word"), F.array_join("licenses.license", ",").alias("licenses"))
