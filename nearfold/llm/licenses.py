"""License scans: winnowed fingerprints of templates in an inverted index pick candidates, then a banded
alignment of the word sequences reports matched coverage and spans."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearfold.llm.arrowtext import text_slices
from nearfold.llm.common import as_docs
from nearfold.llm.words import cleaned_words, shingle_hashes

#: Templates by name: short public licence notices (fixed values).
TEMPLATES = {
    "agpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "boost-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
    "bsd-advertising": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-disclaimer": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "bsd-lead": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "gpl-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "mit-line": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-line": "This is free and unencumbered software released into the public domain.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}
#: Words of a fingerprint, fingerprints of a winnowing window: any shared run of GRAM + WINDOW - 1 words has one.
GRAM, WINDOW = 3, 2
#: Diagonals on either side that an alignment may drift to.
BAND = 8
#: Words that may be inserted between two parts of one match, as a multiple of the template's words.
GAP = 4
MIN_COVERAGE = 0.75
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def clean_word(word: str) -> str:
    """A word without the punctuation around it."""
    return word if word.isalnum() else _EDGES.sub("", word)


def winnow(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Positions of the least hash of every window of WINDOW hashes inside a text (the last of equals); a
    text with fewer hashes keeps its least."""
    picked = np.zeros(len(h), bool)
    sizes = np.diff(off)
    end = np.repeat(off[1:], sizes)
    at = np.arange(len(h))
    for k in range(WINDOW):  # is h[i] the last least of the window that starts k before it?
        start = at - k
        ok = (start >= np.repeat(off[:-1], sizes)) & ((start + WINDOW <= end) | (k == at - np.repeat(off[:-1], sizes)) & (sizes.repeat(sizes) < WINDOW))
        for j in range(WINDOW):
            other = np.minimum(start + j, len(h) - 1) if len(h) else start
            inside = start + j < end
            ok &= ~inside | (h[other] > h) | ((h[other] == h) & (start + j <= at))
        picked |= ok
    return np.flatnonzero(picked)


class TemplateIndex:
    """Word hashes of the templates, and fingerprint -> (template, position) as sorted arrays."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        words, off, _ = cleaned_words(pa.array([templates[n] for n in self.names], pa.string()), clean_word)
        self.words = [words[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        h, h_off = shingle_hashes(words, off, GRAM)
        at = winnow(h, h_off)
        template = np.searchsorted(h_off, at, side="right") - 1
        order = np.argsort(h[at], kind="stable")
        self.hashes, self.template, self.place = h[at][order], template[order], (at - h_off[template])[order]

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which query each hit belongs to, its template, and the position there."""
        low, high = np.searchsorted(self.hashes, h, side="left"), np.searchsorted(self.hashes, h, side="right")
        n = high - low
        query = np.repeat(np.arange(len(h)), n)
        entry = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum())) if len(h) else np.zeros(0, int)
        return query, self.template[entry], self.place[entry]


def banded_alignment(doc: np.ndarray, template: np.ndarray, low: int, high: int) -> tuple[int, int, int, int, int]:
    """Best local alignment on the diagonals low..high (document minus template position): matched words,
    the document span and the template span. A match scores 2, a mismatch or gap -1; of equals the first end wins."""
    width = high - low + 1
    doc_list = doc.tolist()
    score, start, count = [0] * width, [(0, 0)] * width, [0] * width
    top, best = 0, (0, 0, 0, 0, 0)
    for j, word in enumerate(template.tolist()):
        new_score, new_start, new_count = [0] * width, [(0, 0)] * width, [0] * width
        for b in range(max(0, -j - low), min(width, len(doc_list) - j - low)):
            i = j + low + b
            same = doc_list[i] == word
            s, at, n = score[b] + (2 if same else -1), start[b] if score[b] else (i, j), (count[b] if score[b] else 0) + same
            if b + 1 < width and score[b + 1] - 1 > s:  # template word without partner
                s, at, n = score[b + 1] - 1, start[b + 1], count[b + 1]
            if b and new_score[b - 1] - 1 > s:  # document word without partner
                s, at, n = new_score[b - 1] - 1, new_start[b - 1], new_count[b - 1]
            if s > 0:
                new_score[b], new_start[b], new_count[b] = s, at, n
                if s > top:
                    top, best = s, (n, at[0], i + 1, at[1], j + 1)
        score, start, count = new_score, new_start, new_count
    return best


def alignments(own: np.ndarray, want: np.ndarray, low: int, high: int, least: float) -> tuple[list[tuple], list[tuple]]:
    """All disjoint alignments of a template on the diagonals low..high of a document, as ``banded_alignment``
    returns them: those with ``least`` matched words, and the best shorter ones of what is left."""
    whole, parts = [], []
    # an alignment with a positive score spans less than 3 x the template: one that starts in a window's first half ends in it
    half, some = 3 * len(want), min(GRAM, least)
    todo = [(max(0, low), min(len(own), high + len(want) + 1))]
    while todo:
        a, b = todo.pop()
        if b - a < min(GRAM, len(want)):
            continue
        end = min(b, a + 2 * half)
        first, last = max(low - a, 1 - len(want)), min(high - a, end - a - 1)
        if first > last:
            continue
        n, s, e, ts, te = banded_alignment(own[a:end], want, first, last)
        s, e = a + s, a + e
        if end < b and (n < some or s >= a + half):  # it may go on behind the window
            todo += [(s, b), (a, s)] if s >= a + half else [(a + half, b)]
            continue
        if n >= least:
            whole.append((n, s, e, ts, te))
        elif n >= some:
            parts.append((n, s, e, ts, te))
        else:
            continue
        todo += [(e, b), (a, s)]
    return whole, parts


def apart(found: list[tuple]) -> list[tuple]:
    """Alignments that share no document word, those with more matched words first; in document order."""
    kept: list[tuple] = []
    for x in sorted(set(found), key=lambda x: (-x[0], x[1], x[2])):
        at = bisect_left(kept, x[1], key=lambda y: y[1])
        if (at == len(kept) or x[2] <= kept[at][1]) and (not at or kept[at - 1][2] <= x[1]):
            kept.insert(at, x)
    return kept


def joined(parts: list[tuple], whole: list[tuple], words: int, least: float) -> list[tuple]:
    """Neighbouring parts of one template, in its order, that reach ``least`` matched words together. Between two
    of them lie at most GAP x the template's words, and no other match of it."""
    out, at = [], 0
    while at < len(parts):
        n, s, e, _, te = parts[at]
        used = at
        for k in range(at + 1, len(parts)):
            m, s2, e2, ts2, te2 = parts[k]
            if n >= least or s2 - e > GAP * words or (i := bisect_left(whole, e, key=lambda y: y[1])) < len(whole) and whole[i][1] < s2:
                break
            more = m - max(0, te - ts2)
            if te2 > te and more > 0:
                n, e, te, used = n + more, e2, te2, k
        if n >= least:
            out.append((n, s, e, 0, te))
            at = used
        at += 1
    return out


def places(own: np.ndarray, want: np.ndarray, bands: list[tuple[int, int]], least: float) -> list[tuple[int, int, int]]:
    """Matched words and document span of every place of a template near the given ranges of diagonals."""
    whole, parts = [], []
    for low, high in bands:
        w, p = alignments(own, want, low - BAND, high + BAND, least)
        whole += w
        parts += p
    whole = apart(whole)
    if len(parts) > 1:
        taken = set(whole)
        parts = [x for x in apart(whole + [(x[0] - len(want), *x[1:]) for x in set(parts)]) if x not in taken]
        whole = apart(whole + joined([(x[0] + len(want), *x[1:]) for x in parts], whole, len(want), least))
    return [x[:3] for x in whole]


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``doc_id, template, template_words, matched_words, coverage, word_start, word_end`` of every match.

    Whole texts are scanned; words are compared without case and outer punctuation. ``coverage`` is the
    matched part of the template's words; spans count all of the document's words, also those of punctuation
    alone, which take no part in a match. A template that occurs at several places gives a row for each, also
    on consecutive lines; rows of one template share no word. Parts that only together cover enough, around an
    insertion of at most GAP x the template's words, are one row. Null, empty and clean texts give no rows;
    repeated rows are scanned one by one. An empty table gives no rows.
    """
    index = TemplateIndex(templates or TEMPLATES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in text_slices(batches):
            words, off, number = cleaned_words(text, clean_word)
            h, h_off = shingle_hashes(words, off, GRAM)
            at = winnow(h, h_off)
            at = at[np.isin(h[at], index.hashes)]
            query, template, place = index.lookup(h[at])
            doc = np.searchsorted(h_off, at, side="right")[query] - 1
            diagonal = at[query] - h_off[doc] - place
            order = np.lexsort((diagonal, template, doc))
            doc, template, diagonal = doc[order], template[order], diagonal[order]
            fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (template[1:] != template[:-1]) | (diagonal[1:] - diagonal[:-1] > BAND))) if len(doc) else np.zeros(0, bool)
            first = np.flatnonzero(fresh)
            found: list[tuple] = []
            ends = np.append(first[1:], len(doc)).tolist() if len(first) else []
            bands: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for a, b in zip(first.tolist(), ends, strict=True):
                bands.setdefault((int(doc[a]), int(template[a])), []).append((int(diagonal[a]), int(diagonal[b - 1])))
            for (d, t), ranges in bands.items():
                want = index.words[t]
                for n, s, e in places(words[off[d] : off[d + 1]], want, ranges, min_coverage * len(want)):
                    found.append((d, index.names[t], len(want), n, n / len(want), int(number[off[d] + s]), int(number[off[d] + e - 1]) + 1))
            if found:
                d, *cols = zip(*found, strict=True)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(d)), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "template", "template_words", "matched_words", "coverage", "word_start", "word_end"])

    return as_docs(df, id_col, text_col).mapInArrow(scan, "doc_id long, template string, template_words long, matched_words long, coverage double, word_start long, word_end long")
