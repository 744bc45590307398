"""License scans by a generalised suffix automaton of licence texts.

The automaton holds every run of words of every template. A text's words are streamed through it, which gives the
matching statistics: at each word, the longest run ending there that some template has. Runs that can't be extended are
matches; for each template, matches in the same order in text and template, with small gaps, are chained, and a chain
that covers enough of its template is a licence span. Base phrases are templates too: a phrase stands where the
automaton's state lies under the phrase's own in the tree of suffix links.

Words of no template end any run, so whole texts are screened for runs of known words at once, and only these are
streamed.
"""

from __future__ import annotations

import functools
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small, tidy

# Phrases that always give a label.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Public licence notices and the opening grants of licences.
TEMPLATES = (
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the BSD 3-Clause License"),
    ("bsd", "licensed under the BSD 2-Clause License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nd", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("lgpl-3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl-3", "licensed under the GNU Lesser General Public License, version 3"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "released under the MIT License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Words of a match and of a gap in a chain, and the part of a template that a span must cover.
MATCH, GAP, COVER = 3, 6, 0.8

#: A-Z to lower case; every other ASCII character but digits and letters to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """The runs of digits, letters and non-ASCII characters of a UTF-8 text, A-Z lower-cased."""
    return text.translate(_FOLD).split()


@dataclass
class Automaton:
    """Generalised suffix automaton of sequences of word numbers."""

    after: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])  # (template, words up to and with the last)

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.after.append(after)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.after) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The state for the words of p and w, where q also holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.after[q]))
        while p >= 0 and self.after[p].get(w) == q:
            self.after[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, template: int, sequence: list[int]) -> None:
        last = 0
        for i, w in enumerate(sequence):
            if w in self.after[last]:
                last = self._split(last, self.after[last][w], w)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}), last
                while p >= 0 and w not in self.after[p]:
                    self.after[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, self.after[p][w], w)
                last = new
            self.ends[last].add((template, i + 1))

    def finish(self) -> None:
        """Hand the ends down the suffix links."""
        for s in sorted(range(1, len(self.after)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]


class Scanner:
    def __init__(self, base=BASE, templates=TEMPLATES):
        self.labels = [label for label, _ in (*base, *templates)]
        told = [words(t.encode()) for _, t in (*base, *templates)]
        self.number = {w: i for i, w in enumerate(sorted({w for t in told for w in t}))}
        self.sizes = [len(t) for t in told]
        self.automaton = a = Automaton()
        for k, t in enumerate(told):
            a.add(k, [self.number[w] for w in t])
        a.finish()
        self.n_base = len(base)
        whole: dict[int, list[int]] = {}  # states of whole base phrases
        for k in range(self.n_base):
            s = 0
            for w in told[k]:
                s = a.after[s][self.number[w]]
            whole.setdefault(s, []).append(k)
        self.phrases: list[list[int]] = [[] for _ in a.after]  # base phrases that are suffixes of a state's words
        for s in sorted(range(1, len(a.after)), key=lambda s: a.length[s]):
            self.phrases[s] = whole.get(s, []) + self.phrases[a.link[s]]
        self.shortest = min(MATCH, *self.sizes[: self.n_base]) if base else MATCH

    def stream(self, numbers: list[int], start: int, places: list, matches: list) -> None:
        """Matching statistics of a run of known words that begins at word start of the text."""
        a = self.automaton
        after, link, length, phrases, sizes = a.after, a.link, a.length, self.phrases, self.sizes
        s = n = 0
        for i, w in enumerate(numbers):
            if w not in after[s]:
                if n >= MATCH:
                    matches.append((start + i, n, s))
                while s and w not in after[s]:
                    s = link[s]
                    n = length[s]
            if w in after[s]:
                s, n = after[s][w], n + 1
                for k in phrases[s]:
                    if n >= sizes[k]:
                        places.append((start + i + 1 - sizes[k], k))
        if n >= MATCH:
            matches.append((start + len(numbers), n, s))

    def chains(self, matches: list) -> list[tuple[float, int, int, int, int]]:
        """(cover, words covered, first word, word after the last, template) of chains that cover enough."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for end, n, s in matches:
            for k, at in self.automaton.ends[s]:
                if k >= self.n_base:
                    by.setdefault(k, []).append((end, at, min(n, at)))
        out = []
        for k, own in by.items():
            own.sort()
            best: list[tuple[int, int]] = []  # words covered by the best chain that ends with a match, and its first word
            for i, (end, at, n) in enumerate(own):
                top = (n, end - n)
                for j in range(i - 1, -1, -1):
                    e, t, _ = own[j]
                    if end - e > self.sizes[k] + GAP:  # matches are sorted by their ends
                        break
                    new = min(n, end - e, at - t)
                    if new > 0 and end - new - e <= GAP and at - new - t <= GAP and best[j][0] + new > top[0]:
                        top = (best[j][0] + new, best[j][1])
                best.append(top)
                if top[0] >= COVER * self.sizes[k]:
                    out.append((top[0] / self.sizes[k], top[0], top[1], end, k))
        return out

    def scan(self, text: bytes) -> dict:
        told = words(text)
        number = np.fromiter(map(self.number.get, told, repeat(-1)), np.int64, len(told))
        known = np.flatnonzero(np.diff(np.concatenate([[0], (number >= 0).astype(np.int8), [0]])))
        starts, stops = known[::2], known[1::2]
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []
        for i in np.flatnonzero(stops - starts >= self.shortest):
            self.stream(number[starts[i] : stops[i]].tolist(), int(starts[i]), places, matches)
        base = {self.labels[k] for _, k in places}
        spans = [(first, stop, self.labels[k], cover) for cover, _, first, stop, k in decided(self.chains(matches))]
        at = [i for i, _ in places]
        labels = sorted(base | {s[2] for s in spans})
        score = max([1.0] * bool(places) + [s[3] for s in spans], default=0.0)
        return {"n_words": len(told), "n_base": len(places), "first_word": min(at, default=None), "last_word": max(at, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(labels), "score": score, "spans": sorted(spans)}


def decided(chains: list[tuple[float, int, int, int, int]]) -> list[tuple[float, int, int, int, int]]:
    """Of chains over the same words of a text, the one that covers most; another one may share half of its words with it at most.

    Spans that are taken are kept in order, and no longer one reaches further than the longest of them, so a chain is
    held against its neighbours only.
    """
    out, at, longest = [], [], 0
    for c in sorted(chains, key=lambda c: (-c[0] * c[1], -c[1], c[2], c[4])):
        first, stop = c[2], c[3]
        near = at[bisect_left(at, (first - longest,)) : bisect_right(at, (stop,))]
        if all(min(stop, b) - max(first, a) <= (stop - first) / 2 for a, b in near):
            at.insert(bisect_left(at, (first, stop)), (first, stop))
            longest = max(longest, stop - first)
            out.append(c)
    return out


@functools.lru_cache(maxsize=4)
def scanner(base=BASE, templates=TEMPLATES) -> Scanner:
    """One for each worker process."""
    return Scanner(base, templates)


_TYPES = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("cover", pa.float64())]))


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """doc_id, the counts and labels of base phrases, labels, score and spans for every row of docs.

    A null text counts as empty: no words, no labels, score 0. Whole texts are scanned; every place of a base phrase
    counts, overlapping ones too. score is 1 with a base phrase, else the largest cover of a span. spans are (first
    word, word after the last, label, cover); of two over the same words the one that covers more words of more of its
    template stays, of ties the one that begins first, then the template that is named first. Repeated rows (and
    doc_ids, null ones included) each get their own result. Other columns of docs, whatever their names, play no part.
    Work grows in proportion to a text's length. An empty table gives no rows.
    """

    @tidy
    def run(batches):
        s = scanner(base, templates)
        for b in small(batches):
            rows = [s.scan(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            cols = [pa.array([r[k] for r in rows], t) for k, t in _TYPES.items()]
            spans = pa.array([[dict(zip(("first", "stop", "label", "cover"), x, strict=True)) for x in r["spans"]] for r in rows], _SPAN)
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, spans], names=["doc_id", *_TYPES, "spans"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first: long, stop: long, label: string, cover: double>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
