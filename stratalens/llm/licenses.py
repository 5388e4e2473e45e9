"""Licence scans by a generalised suffix automaton of template words.

All templates, and the phrases that are asked for as they stand, form one automaton over words.  A text is streamed
through it: at each word it tells the longest piece of any template that ends there (the matching statistics).  Pieces
of at least LEAST_MATCH words that go no further are matches; matches of one template that follow one another in the
text and in the template, at most MOST_GAP words apart, are chained into a span.  A span whose matches hold at least
LEAST_SHARE of its template's words gives the template's label, unless it lies inside a span with more matched words.
A phrase is found wherever the automaton's state ends with the whole of it.

Words: A-Z are lower-cased, then `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.  Arrow splits the texts and numbers their distinct
words; only stretches of two or more template words in a row reach the automaton.

Defined cases: a null or empty text has no words, no places and a score of zero; equal rows give equal results, one for
each row; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

LEAST_MATCH, MOST_GAP, LEAST_SHARE = 3, 6, 0.75

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices by which licences are granted, and their labels.  Several of a label are its variants.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("apache-2.0", "licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or "
        "(at your option) any later version.",
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "licensed under CC BY-ND 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
]

_KEPT = np.full(256, 0x20, np.uint8)  # every byte to itself, its lower case, or a space
for _low, _high, _to in ((0x30, 0x3A, 0x30), (0x41, 0x5B, 0x61), (0x61, 0x7B, 0x61), (0x80, 0x100, 0x80)):
    _KEPT[_low:_high] = np.arange(_to, _to + _high - _low)

SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int64()), ("share", pa.float64())]))
PLACES = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and where each text's begin."""
    raw, bounds = words.content(texts)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(_KEPT[raw]))
    parts = pc.ascii_split_whitespace(plain)
    flat = parts.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    offsets = parts.offsets.to_numpy().astype(np.int64)
    return flat.filter(pa.array(full)), np.append(0, np.cumsum(full))[offsets - offsets[0]]


class Automaton:
    """The generalised suffix automaton of sequences of word numbers; state 0 is the empty piece."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, list[tuple[int, int]]] = defaultdict(list)  # state -> (sequence, words of it that end here)
        for nth, sequence in enumerate(sequences):
            last = 0
            for k, word in enumerate(sequence, 1):
                last = self._extend(last, word)
                ends[last].append((nth, k))
        children = defaultdict(list)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            children[self.link[state]].append(state)
        self.places: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):  # longer pieces first: children before parents
            self.places[state] = sorted({*ends[state], *(x for c in children[state] for x in self.places[c])})

    def _state(self, length: int, link: int, then: dict[int, int]) -> int:
        self.next.append(then)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: int) -> int:
        """The state for the piece of p and this word, apart from longer ones."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> None:
        listed, bounds = split(pa.array([x for _, x in templates] + [x for x, _ in phrases], pa.string()))
        distinct = listed.unique()
        number = pc.index_in(listed, distinct).to_pylist()
        sequences = [number[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
        self.words = distinct
        self.labels = [x for x, _ in templates]
        self.sizes = [len(x) for x in sequences]
        self.machine = Automaton(sequences)
        own: dict[int, tuple[int, str]] = {}
        for sequence, (_, label) in zip(sequences[len(templates) :], phrases, strict=True):
            state = 0
            for word in sequence:
                state = self.machine.next[state][word]
            own[state] = (len(sequence), label)
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.machine.next]  # that the longest piece of a state ends with
        for state in sorted(range(1, len(self.phrases)), key=self.machine.length.__getitem__):
            self.phrases[state] = self.phrases[self.machine.link[state]] + ([own[state]] if state in own else [])

    def stream(self, stretch: list[int], first: int, matches: list, places: list) -> None:
        """Matches (start, end, state) and phrase places (label, word) in template words from word `first` on."""
        then, link, longest, phrases = self.machine.next, self.machine.link, self.machine.length, self.phrases
        state = length = 0
        for at, word in enumerate(stretch, first):
            if word not in then[state]:
                if length >= LEAST_MATCH:
                    matches.append((at - length, at, state))
                while state and word not in then[state]:
                    state = link[state]
                length = longest[state]
            state = then[state][word]
            length += 1
            for size, label in phrases[state]:
                if size <= length:
                    places.append((label, at - size + 1))
        if length >= LEAST_MATCH:
            at = first + len(stretch)
            matches.append((at - length, at, state))

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, start, end, matched words) of the chains that no match continues; matches by their end."""
        done: list[tuple[int, int, int, int]] = []
        live: dict[int, list[list]] = {}  # template -> chains: end in the template, end in the text, start, matched, continued
        for start, end, state in matches:
            for template, to in self.machine.places[state]:
                if template >= len(self.labels):
                    continue
                chains = live.setdefault(template, [])
                ended = [c for c in chains if c[1] + MOST_GAP < start]
                if ended:
                    done += [(template, c[2], c[1], c[3]) for c in ended if not c[4]]
                    chains = live[template] = [c for c in chains if c[1] + MOST_GAP >= start]
                best, grown = None, end - start
                for c in chains:
                    inside = max(0, c[1] - start, c[0] - (to - (end - start)))
                    new = end - start - inside
                    if new > 0 and start + inside - c[1] <= MOST_GAP and to - new - c[0] <= MOST_GAP and c[3] + new > grown:
                        best, grown = c, c[3] + new
                if best:
                    best[4] = True
                chains.append([to, end, best[2] if best else start, grown, False])
        return done + [(t, c[2], c[1], c[3]) for t, chains in live.items() for c in chains if not c[4]]

    def spans(self, matches: list[tuple[int, int, int]]) -> tuple[list[dict], float]:
        """The spans that give a label, by start, and the largest share of any chain."""
        found, top = [], 0.0
        for template, start, end, matched in self.chains(matches):
            share = matched / self.sizes[template]
            top = max(top, share)
            if share >= LEAST_SHARE:
                found.append((start, -matched, -share, end, self.labels[template]))
        kept, reach, held = [], -1, 0  # end and matched words of the span that reaches furthest
        last: dict[str, int] = {}
        for start, less, share, end, label in sorted(found):
            if (end <= reach and -less < held) or start < last.get(label, -1):
                continue
            last[label] = end
            if end > reach:
                reach, held = end, -less
            kept.append({"label": label, "start": start, "end": end, "matched": -less, "share": -share})
        return kept, top

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list, list, list]:
        """Number of words, phrase places, spans, and score of each text."""
        flat, bounds = split(texts)
        n = np.diff(bounds)
        coded = flat.dictionary_encode()
        number = pc.fill_null(pc.index_in(coded.dictionary, self.words), -1).to_numpy()[coded.indices.to_numpy()]
        at = np.flatnonzero(number >= 0)
        doc = np.searchsorted(bounds, at, side="right") - 1
        edge = np.flatnonzero((np.diff(at, prepend=-2) > 1) | (np.diff(doc, prepend=-1) != 0))
        size = np.diff(np.append(edge, len(at)))
        edge, size = edge[size > 1], size[size > 1]
        places: list[list] = [[] for _ in n]
        matches: dict[int, list] = defaultdict(list)
        for own, first, length in zip(doc[edge].tolist(), at[edge].tolist(), size.tolist(), strict=True):
            self.stream(number[first : first + length].tolist(), first - int(bounds[own]), matches[own], places[own])
        spans: list[list] = [[] for _ in n]
        score = [1.0 if x else 0.0 for x in places]
        for own, found in matches.items():
            if found:
                spans[own], top = self.spans(found)
                score[own] = max(score[own], top)
        return n, [[{"label": label, "word": word} for label, word in sorted(x, key=lambda p: (p[1], p[0]))] for x in places], spans, score


@lru_cache(maxsize=2)
def scanner(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates, phrases)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, places (label, word: where a phrase begins), spans (label, start, end, matched, share) and score of every row.

    score: 1 where a phrase stands, else the largest share of a template's words that a chain holds.
    """
    given = tuple(map(tuple, templates)), tuple(phrases.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = scanner(*given)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            edges = [0, *(np.flatnonzero(np.diff(size // words.CHUNK_BYTES)) + 1).tolist(), len(texts)] if len(texts) else [0]
            for a, b in zip(edges, edges[1:], strict=False):
                n, places, spans, score = here.scan(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(places, PLACES), pa.array(spans, SPANS), pa.array(score, pa.float64())],
                    ["doc_id", "n_words", "places", "spans", "score"],
                )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, places array<struct<label:string,word:long>>, spans array<struct<label:string,start:long,end:long,matched:long,share:double>>, score double")
