"""Licence texts in documents: matching statistics on a generalised suffix automaton of licence words, chained into spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import raw, tune

# Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Passages of public licences and notices, by label.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

#: Words that a match needs to be chained; words of a file that may lie between links of a chain; share that earns a label.
MIN_MATCH, MAX_GAP, MIN_COVER = 4, 16, 0.6

_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in (x + 32 if 0x41 <= x <= 0x5A else x for x in range(256)))


def split_words(text: bytes) -> list[bytes]:
    """A-Z lowered; runs of ASCII letters and digits and of all other characters beyond ASCII."""
    return text.translate(_WORD_BYTES).split()


class Ends:
    """ends[state]: the places (sequence, word) where a state's substrings end, which are its own and those of all that link to it.

    Own places are listed once, in the order of a walk over the tree of links; a state's are one stretch of that list, so memory
    grows with the words of the sequences.
    """

    def __init__(self, link: list[int], own: list[set[tuple[int, int]]]):
        below: list[list[int]] = [[] for _ in link]
        for v in range(1, len(link)):
            below[link[v]].append(v)
        self.places: list[tuple[int, int]] = []
        self.first, self.last = [0] * len(link), [0] * len(link)
        stack = [(0, False)]
        while stack:
            v, left = stack.pop()
            if left:
                self.last[v] = len(self.places)
                continue
            self.first[v] = len(self.places)
            self.places += sorted(own[v])
            stack.append((v, True))
            stack += [(x, False) for x in below[v]]

    def __getitem__(self, state: int) -> list[tuple[int, int]]:
        return sorted(self.places[self.first[state] : self.last[state]])


class Pairs:
    """Which pairs of neighbouring words are in a licence (1) or in a phrase (2): a small table of slots, then the sorted pairs."""

    SLOTS = 1 << 20

    def __init__(self, sequences: list[tuple[list[int], int]]):
        kinds: dict[int, int] = {}
        for words, kind in sequences:
            for a, b in zip(words, words[1:], strict=False):
                kinds[a << 32 | b] = max(kind, kinds.get(a << 32 | b, 0))
        self.codes = np.array(sorted(kinds), np.int64)
        self.kinds = np.array([kinds[c] for c in sorted(kinds)], np.int8)
        self.slots = np.zeros(self.SLOTS, bool)
        self.slots[self._slot(self.codes >> 32, self.codes & 0xFFFFFFFF)] = True

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 40_503 + b) & (self.SLOTS - 1)

    def of(self, ids: np.ndarray) -> np.ndarray:
        """The kind of each pair of neighbours; 0 for none."""
        a, b = ids[:-1], ids[1:]
        at = np.flatnonzero(self.slots[self._slot(a, b)])
        code = a[at] << 32 | b[at]
        place = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        out = np.zeros(len(a), np.int8)
        if len(self.codes):
            out[at] = np.where(self.codes[place] == code, self.kinds[place], 0)
        return out


class Automaton:
    """All words of several sequences at once: the states are classes of substrings that end at the same places."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for which, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].add((which, at))
        self.ends = Ends(self.link, ends)

    def _state(self, length: int, following: dict[int, int], link: int, ends: list) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int, ends: list) -> int:
        """A copy of q for its substrings that p's make, p and what p links to going there."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], ends)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int, ends: list) -> int:
        if word in self.next[last]:  # another sequence has been here
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q, ends)
        new, p = self._state(self.length[last] + 1, {}, 0, ends), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q, ends)
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """For each place of a stream: the state and length of the longest sequence of words that ends there."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length


@dataclass
class Scan:
    """What is found in a text: base places (word, label), spans (label, template, first word, last word, share covered)."""

    n_words: int
    base: list[tuple[int, str]]
    spans: list[tuple[str, int, int, int, float]]


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER):
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        cut = [(label, split_words(t.encode())) for label, t in templates]
        phrase = [(label, split_words(t.encode())) for t, label in phrases]
        names = sorted({w for _, ws in cut + phrase for w in ws})
        self.vocabulary = {w: k + 1 for k, w in enumerate(names)}  # 0: a word of no licence
        coded = [[self.vocabulary[w] for w in ws] for _, ws in cut + phrase]
        self.automaton = Automaton(coded)
        self.labels, self.sizes, self.templates = [x for x, _ in cut], [len(ws) for _, ws in cut], len(cut)
        self.pairs = Pairs([(sequence, 1 if k < self.templates else 2) for k, sequence in enumerate(coded)])
        marks: list[tuple[tuple[int, str], ...]] = [()] * len(self.automaton.next)
        for (label, _), sequence in zip(phrase, coded[self.templates :], strict=True):
            *_, (state, _) = self.automaton.statistics(sequence)
            marks[state] += ((len(sequence), label),)
        for v in sorted(range(1, len(marks)), key=self.automaton.length.__getitem__):
            marks[v] += marks[self.automaton.link[v]]
        self.marks = marks  # phrases that end where a state's substrings end

    def scan(self, text: bytes) -> Scan:
        words = split_words(text)
        found = Scan(len(words), [], [])
        ids = np.array(list(map(self.vocabulary.get, words, repeat(0))), np.int64)
        if len(ids) < 2:
            return found
        pair = self.pairs.of(ids)
        # Matches of two or more words lie in stretches whose every pair of neighbours is a pair of some licence.
        edge = np.diff(np.concatenate([[0], pair > 0, [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        phrases = np.concatenate([[0], np.cumsum(pair == 2)])
        wanted = (last - first + 1 >= self.min_match) | (phrases[last] > phrases[first])
        anchors: list[tuple[int, int, int]] = []  # first word, words, state
        for a, b in zip(first[wanted].tolist(), last[wanted].tolist(), strict=True):
            before = (0, 0)
            for at, (state, length) in enumerate(self.automaton.statistics(ids[a : b + 1].tolist()), a):
                found.base += [(at - size + 1, label) for size, label in self.marks[state] if length >= size]
                if before[1] >= self.min_match and length != before[1] + 1:
                    anchors.append((at - before[1], before[1], before[0]))
                before = (state, length)
            if before[1] >= self.min_match:
                anchors.append((b + 1 - before[1], before[1], before[0]))
        self._chain(anchors, found)
        found.base.sort()
        return found

    def _chain(self, anchors: list[tuple[int, int, int]], found: Scan) -> None:
        """Matches in the order of the file join the chain of their template that ends last before them, in both, and near enough."""
        open_: dict[int, list[list[int]]] = {}  # template -> chains [first word, last word, last template word, covered]

        def close(template: int, chain: list[int]) -> None:
            share = chain[3] / self.sizes[template]
            if share >= self.min_cover:
                found.spans.append((self.labels[template], template, chain[0], chain[1], share))

        for at, size, state in anchors:
            for template, end in self.automaton.ends[state]:
                if template >= self.templates:
                    continue
                start, best = end - size + 1, None
                chains = open_.setdefault(template, [])
                for chain in [c for c in chains if at - c[1] > self.max_gap]:
                    chains.remove(chain)
                    close(template, chain)
                for chain in chains:
                    shared = max(0, chain[1] - at + 1, chain[2] - start + 1)
                    if shared < size and chain[1] < at + size - 1 and (best is None or chain[3] > best[0][3]):
                        best = (chain, shared)
                if best:
                    chain, shared = best
                    chain[1:] = [at + size - 1, end, chain[3] + size - shared]
                else:
                    chains.append([at, at + size - 1, end, size])
        for template, chains in open_.items():
            for chain in chains:
                close(template, chain)
        found.spans.sort(key=lambda s: (s[2], s[3], s[1]))


@lru_cache(maxsize=4)
def _scanner(templates, phrases, min_match: int, max_gap: int, min_cover: float) -> Scanner:
    return Scanner(templates, phrases, min_match, max_gap, min_cover)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER) -> DataFrame:
    """id, n_words, base (array of word, label), spans (array of label, template, first, last, cover), score for every row.

    Every whole text is streamed through the automaton; a null text is empty. base has every place of a phrase; spans the chains
    of matches that cover at least `min_cover` of a template. score is the largest share covered, a phrase being covered where it
    stands; 0 without any. No shuffle, no state between rows. Other columns are not read.
    """
    tune(docs.sparkSession)
    base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    span_type = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(templates, phrases, min_match, max_gap, min_cover)
        for b in batches:
            out = [scanner.scan(t or b"") for t in raw(b.column(1))]
            base = pa.array([[{"word": w, "label": x} for w, x in s.base] for s in out], base_type)
            spans = pa.array([[dict(zip(("label", "template", "first", "last", "cover"), x, strict=True)) for x in s.spans] for s in out], span_type)
            score = pa.array([1.0 if s.base else max([0.0, *(min(1.0, x[4]) for x in s.spans)]) for s in out], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.n_words for s in out], pa.int64()), base, spans, score], names=["id", "n_words", "base", "spans", "score"])

    schema = "id long, n_words long, base array<struct<word:long,label:string>>, spans array<struct<label:string,template:int,first:long,last:long,cover:double>>, score double"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
