"""License scans by patience alignment of whole texts with license templates.

Only places where enough words of a template stand together can reach the coverage; they are found by array operations
on word hashes.  There text and template are aligned: words that are unique in both are anchors, the longest increasing
subsequence of the anchors is kept, and the gaps between them are aligned in the same way.  Coverage is the share of the
template's words that are aligned.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import map_arrow, slices_by_bytes, unique_docs
from tessera.llm.pretokens import string_buffers
from tessera.llm.shingles import word_hashes

COVERAGE = 0.8
#: A text part may be so much longer than the template.
STRETCH = 1.5
#: Words from which on a template is long.
LONG = 64
CHUNK_BYTES = 1 << 20
#: Notices of public licenses.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-3-clause-header": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


#: The full texts of public licenses, a file each in ``licenses``.
TEXTS = {path.name.removesuffix(".txt"): path.read_text("utf-8") for path in sorted(Path(__file__).with_name("licenses").glob("*.txt"))}
TEMPLATES = NOTICES | TEXTS


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience piles."""
    tops, tails, back = [], [], []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        back.append(tails[pile - 1] if pile else -1)
        tops[pile : pile + 1], tails[pile : pile + 1] = [v], [i]
    out, i = [], tails[-1] if tails else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Aligned places (of text, of template), ascending in both."""
    out, open_parts = [], [(0, len(text), 0, len(template))]
    while open_parts:
        a, b, c, d = open_parts.pop()
        while a < b and c < d and text[a] == template[c]:  # equal ends need no anchor
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        ours, theirs = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(template[c:d], c) if theirs[w] == 1 and ours[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(text[a:b], a) if w in place]
        anchors = [anchors[k] for k in increasing([t for _, t in anchors])]
        if not anchors:
            continue
        out += anchors
        bounds = [(a - 1, c - 1), *anchors, (b, d)]
        open_parts += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(bounds, bounds[1:], strict=False)]
    return sorted(out)


def trimmed(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Without stray words before the first and after the last run of aligned words that stand together."""
    together = [k for k, ((a, c), (b, d)) in enumerate(zip(pairs, pairs[1:], strict=False)) if b - a == d - c == 1]
    return pairs[together[0] : together[-1] + 2] if together else []


class Templates:
    """Word codes of all templates over one vocabulary."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        hashed = [word_hashes([text])[0] for _, text in templates]
        self.names = [name for name, _ in templates]
        self.vocabulary = np.unique(np.concatenate(hashed))
        self.codes = [np.searchsorted(self.vocabulary, h).tolist() for h in hashed]
        self.holds = np.zeros((len(hashed), len(self.vocabulary)), bool)
        for k, codes in enumerate(self.codes):
            self.holds[k, codes] = True
        self.kinds = self.holds.sum(1)
        self.need = COVERAGE * np.array([len(codes) for codes in self.codes])

    def matches(self, places: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, int, str, float]]:
        """(first word, end word, license, coverage) in one text; places and codes: its words that any template has.

        Most templates are ruled out by how many of their words the whole text has.  A part of the text is aligned if it
        has enough words of the template.  Short templates are tried from every word
        on, which must be an aligned one; long ones at steps of an eighth of their length, and the part reaches as much
        farther.
        """
        possible = (self.holds[:, np.unique(codes)].sum(1) >= 0.5 * self.kinds) & (self.need <= len(codes))
        for k in np.flatnonzero(possible).tolist():
            name, template, need, kinds = self.names[k], self.codes[k], self.need[k], self.kinds[k]
            mine = self.holds[k, codes]
            at, word = places[mine], codes[mine]
            step = len(template) // 8 if len(template) >= LONG else 1
            reach = int(STRETCH * len(template)) + step
            ends = np.searchsorted(at, at + reach)
            start = 0
            for i in np.flatnonzero(ends - np.arange(len(at)) >= need).tolist():
                if i < start or len(set(part := word[i : ends[i]].tolist())) < 0.5 * kinds:
                    continue
                pairs = align(part, template)
                if step > 1:
                    pairs = trimmed(pairs)
                if len(pairs) >= need and (step > 1 or pairs[0][0] == 0):
                    yield int(at[i + pairs[0][0]]), int(at[i + pairs[-1][0]]) + 1, name, len(pairs) / len(template)
                    start = i + pairs[-1][0] + 1
                else:
                    start = i + step


@functools.lru_cache(maxsize=4)
def compiled(templates: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(templates)


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Licenses of every whole text.

    docs needs ``doc_id`` and ``text``; other columns are ignored.  A null or empty text has none; repeated rows are
    scanned once each; no rows give no rows.  Matches of one license don't overlap; a notice that is also the beginning
    of a longer one counts for both.  Places are words (runs of letters and digits), the end exclusive.  Returns doc_id,
    n_matches, licenses (distinct names, comma-joined), spans (name:start:end:coverage by start, then name), best_license
    (highest coverage, ties to the smaller name; null for none) and coverage (0 for none).
    """
    shipped = docs.sparkSession.sparkContext.broadcast(tuple(sorted((templates or TEMPLATES).items())))  # bounded by the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = compiled(shipped.value)
        for batch in batches:
            offsets, data = string_buffers(batch.column(1))
            view = memoryview(data)
            for first, last in slices_by_bytes(np.diff(offsets), CHUNK_BYTES):
                texts = [str(view[offsets[i] : offsets[i + 1]], "utf-8") for i in range(first, last)]
                hashes, owners = word_hashes(texts)
                begins = np.searchsorted(owners, np.arange(len(texts)))
                code = np.minimum(np.searchsorted(known.vocabulary, hashes), len(known.vocabulary) - 1)
                some = np.flatnonzero(known.vocabulary[code] == hashes)
                bounds = np.searchsorted(owners[some], np.arange(len(texts) + 1))
                rows = []
                for k in range(len(texts)):
                    part = some[bounds[k] : bounds[k + 1]]
                    found = sorted(known.matches(part - begins[k], code[part])) if len(part) > 2 else []
                    best = min(found, key=lambda m: (-m[3], m[2]), default=None)
                    rows.append((len(found), ",".join(sorted({m[2] for m in found})), ",".join(f"{m[2]}:{m[0]}:{m[1]}:{m[3]:.3f}" for m in found), best and best[2], best[3] if best else 0.0))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64())
                columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *columns], ["doc_id", "n_matches", "licenses", "spans", "best_license", "coverage"])

    return map_arrow(unique_docs(docs, "doc_id", "text"), run, "doc_id long, n_matches long, licenses string, spans string, best_license string, coverage double")
