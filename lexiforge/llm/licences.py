"""Operator 10: licence scans by winnowed fingerprints and banded alignment.

Templates are cut into words (letters and digits, lower-cased); hashes of ``GRAM`` consecutive words are winnowed (the
smallest of every window of hashes) and put in an inverted index hash -> (template, position).  Templates are configuration:
their number and length do not depend on the data, so the index travels to the tasks.  A text's grams are looked up in
the index; every diagonal of a template (text position - template position) with hits is a candidate, and a candidate is
aligned with the template in a band around its diagonal.  Matched words over the template's words are the coverage; candidates
that reach ``min_coverage`` are reported with their span, the best first.  Hits outside the reported spans are aligned again in
the text between them, so that notices which repeat or follow each other closely are all found.

A common run of GRAM + WINDOW - 1 words shares a fingerprint.  Templates shorter than that keep all their grams, and a
template shorter than a gram is one gram of its own length.

Defined results: a null or empty text has no matches and therefore no row; a template without words is left out; repeated
templates are reported under the smallest id; rows that repeat an id are scanned each.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm import words as W

GRAM = 3
WINDOW = 4
BAND = 12
MIN_COVERAGE = 0.8

#: Short forms of common licence notices, as they stand in files and on pages.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
    "required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
    "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
    "governing permissions and limitations under the License.",
    "mit-line": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
    "this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
    "any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
    "details.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
    "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
    "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

_OUTSIDE = np.ones(256, dtype=bool)
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _split(texts: list[str | None]) -> W.Words:
    return W.split([t.lower() if t else t for t in texts], separator=_OUTSIDE)


class Index:
    """Winnowed fingerprints of the templates: sorted hashes with (template, position) entries."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW):
        self.gram, self.names, self.words, entries, seen = gram, [], [], [], set()
        for name in sorted(templates):
            h = _split([templates[name]]).hashes()
            if not len(h) or h.tobytes() in seen:
                continue
            seen.add(h.tobytes())
            size = min(gram, len(h))
            g = W.grams(h, size)
            span = window if len(g) >= window else 1
            chosen = {i + int(np.argmin(g[i:i + span])) for i in range(len(g) - span + 1)}
            entries += [(size, int(g[p]), len(self.names), p) for p in sorted(chosen)]
            self.names.append(name)
            self.words.append(h)
        self.bags = [np.unique(h, return_counts=True) for h in self.words]
        self.sizes = sorted({e[0] for e in entries})
        self.at = {}
        for size in self.sizes:
            own = sorted(e[1:] for e in entries if e[0] == size)
            self.at[size] = (np.array([e[0] for e in own], np.uint64), np.array([e[1] for e in own]), np.array([e[2] for e in own]))

    def common(self, template: int, h: np.ndarray) -> int:
        """Words that a template and a run of word hashes have in common, in any order."""
        words, counts = self.bags[template]
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        return int(np.minimum(np.bincount(at[words[at] == h], minlength=len(words)), counts).sum())

    def hits(self, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text positions, templates, template positions) of the grams found in a run of word hashes."""
        out = []
        for size in self.sizes:
            g, (keys, templates, positions) = W.grams(h, size), self.at[size]
            low, high = np.searchsorted(keys, g, "left"), np.searchsorted(keys, g, "right")
            found = np.flatnonzero(high > low)
            n = (high - low)[found]
            entry = np.repeat(low[found], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out.append((np.repeat(found, n), templates[entry], positions[entry]))
        return out


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, past last) of the best common subsequence of template and text whose diagonals lie within
    ``band`` of the given one; first and last are those of the matched words in ``text``.  Of subsequences with as many words
    the one with the shortest span is taken, and of those the one that starts nearest to the diagonal."""
    m, width = len(template), 2 * band + 1
    columns = np.arange(width)
    at = np.arange(m)[:, None] + diagonal - band + columns
    same = (at >= 0) & (at < len(text))
    same[same] = text[at[same]] == np.broadcast_to(template[:, None], same.shape)[same]
    word = m + width  # a matched word counts more than all words that a span can skip; those count -1 each
    best = np.zeros(width, np.int64)  # of what follows, inside a span, from template row i, text i + diagonal - band + column
    take = np.zeros((m, width), np.int64)
    for i in range(m - 1, -1, -1):
        # row i + 1 is shifted by one column: the same text position is one column further left there
        take[i] = np.where(same[i], best + word, 0)
        skip = np.concatenate([[0], best[:-1]])
        best = np.maximum(np.maximum.accumulate((np.maximum(take[i], skip) - columns)[::-1])[::-1] + columns, 0)
    top = int(take.max(initial=0))
    if not top:
        return 0, 0, 0
    rows, starts = np.nonzero(take == top)
    k = int(np.argmin(np.abs(starts - band)))
    first, n = int(at[rows[k], starts[k]]), -(-top // word)
    return n, first, first + n + n * word - top


def scan_words(h: np.ndarray, index: Index, band: int = BAND, min_coverage: float = MIN_COVERAGE) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first, past last) of the matches in one text, in text order.  Every diagonal with a hit is a
    candidate in the run of free text around its hits.  The best candidate is kept and takes its span out of the free text;
    the hits that are left are aligned again in what is left, until none reaches ``min_coverage``."""
    spots = defaultdict(list)
    for position, template, at in index.hits(h):
        for p, t, q in zip(position.tolist(), template.tolist(), at.tolist()):
            spots[t, p - q].append(p)
    kept: list[tuple[int, int, int, int]] = []  # first, past last, template, matched words; in text order
    queue: list[tuple[int, ...]] = []

    def free(p: int) -> tuple[int, int] | None:
        """The run of free text around a position."""
        k = bisect_right(kept, (p, len(h) + 1))
        low = kept[k - 1][1] if k else 0
        return (low, kept[k][0] if k < len(kept) else len(h)) if p >= low else None

    def propose(t: int, diagonal: int, low: int, high: int) -> None:
        words = index.words[t]
        for s, e in {free(p) for p in spots[t, diagonal] if low <= p < high} - {None}:
            s, e = max(s, diagonal - band), min(e, diagonal + len(words) + band)
            if index.common(t, h[s:e]) < min_coverage * len(words):
                continue  # no alignment has more words than the two have in common
            n, a, b = align(words, h[s:e], diagonal - s, band)
            if n and n >= min_coverage * len(words):
                heappush(queue, (-n, b - a, s + a, t, diagonal, s, e))

    for t, diagonal in spots:
        propose(t, diagonal, 0, len(h))
    while queue:
        n, size, a, t, diagonal, s, e = heappop(queue)
        run = free(a)
        if run and a + size <= run[1]:
            insort(kept, (a, a + size, t, -n))
        propose(t, diagonal, s, e)
    return [(t, n, a, b) for a, b, t, n in kept]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM,
         window: int = WINDOW, band: int = BAND, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per match: doc_id, licence, template_words, matched_words, coverage, first_word, end_word (past the last;
    words are runs of letters and digits), matched_text."""
    index = Index(TEMPLATES if templates is None else templates, gram, window)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # as large as the templates
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = d.schema["doc_id"].dataType

    def task(batches):
        index = shared.value
        for batch in batches:
            texts, rows, out = batch.column(1).to_pylist(), [], []
            for a, b in W.chunks(texts):
                w = _split(texts[a:b])
                h = w.hashes()
                hit = np.unique(np.concatenate([p for p, _, _ in index.hits(h)] or [np.zeros(0, np.int64)]))
                for d in np.unique(np.searchsorted(w.first, hit, side="right") - 1).tolist():
                    first = int(w.first[d])
                    for t, n, x, y in scan_words(h[first:w.first[d + 1]], index, band, min_coverage):
                        size = len(index.words[t])
                        span = w.data[w.starts[first + x]:w.ends[first + y - 1]].tobytes().decode("utf-8", "replace")
                        rows.append(a + d)
                        out.append((index.names[t], size, n, n / size, x, y, span))
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string())
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            names = ["doc_id", "licence", "template_words", "matched_words", "coverage", "first_word", "end_word", "matched_text"]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, kinds))], names=names)

    return d.mapInArrow(task, f"doc_id {kind.simpleString()}, licence string, template_words long, matched_words long, coverage double, "
                              "first_word long, end_word long, matched_text string")
