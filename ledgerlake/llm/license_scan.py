"""Licence scans with a generalised suffix automaton of licence words.

The automaton holds every run of words of all templates. A file is streamed
through it word by word, which gives the *matching statistics*: at each word the
longest run ending there that occurs in some template. Runs that cannot be
extended are the maximal matches; those of ``MIN_MATCH`` words or more are chained,
for each template, in increasing order on both sides with gaps of at most
``MAX_GAP`` words. A chain that covers enough of its template is a covered template
span and gives the template's label; where spans of several templates overlap, the
one that covers most words stays.

The base phrases are templates too. A phrase stands at a word if it is a suffix of
the run matched there, which the automaton's suffix links tell.

The automaton has a state for at most two words of a template, is built once in
each Python worker, and does not grow with the data. Files stay in their tasks.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import per_text

# Base phrases with their labels, and licence notices as their publishers word them.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License.",
    ),
    ("agpl-3.0", "GNU Affero General Public License, version 3"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("lgpl-2.1", "GNU Lesser General Public License, version 2.1"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
MIN_MATCH, MAX_GAP, MIN_COVER, LONG_COVER = 4, 6, 0.7, 25

#: Bytes that stand in words, in lower case; all others separate them. Bytes over 127 belong to characters beyond ASCII.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split()


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]
        #: By state: (sequence, place) of the last word of its runs.
        self.ends: list[set] = [set()]
        for number, words in enumerate(sequences):
            last = 0
            for place, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].add((number, place))
        for state in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            self.ends[self.link[state]] |= self.ends[state]

    def _new(self, size: int, following: dict, link: int) -> int:
        self.next.append(following)
        self.size.append(size)
        self.link.append(link)
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, before: int, word: bytes, state: int) -> int:
        """A copy of ``state`` for its runs that end a run of ``before`` with ``word``."""
        copy = self._new(self.size[before] + 1, dict(self.next[state]), self.link[state])
        self.link[state] = copy
        while before >= 0 and self.next[before].get(word) == state:
            self.next[before][word] = copy
            before = self.link[before]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        there = self.next[last].get(word)
        if there is not None:
            return there if self.size[there] == self.size[last] + 1 else self._split(last, word, there)
        state, before = self._new(self.size[last] + 1, {}, 0), last
        while before >= 0 and word not in self.next[before]:
            self.next[before][word] = state
            before = self.link[before]
        if before >= 0:
            there = self.next[before][word]
            self.link[state] = there if self.size[there] == self.size[before] + 1 else self._split(before, word, there)
        return state

    def find(self, words: list[bytes]) -> int:
        state = 0
        for word in words:
            state = self.next[state][word]
        return state


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.labels = [label for label, _ in templates]
        self.sequences = [words_of(text) for _, text in templates]
        runs = [phrase.split() for phrase in phrases]
        runs = [[w.encode() for w in run] for run in runs]
        self.automaton = Automaton([*self.sequences, *runs])
        self.known = {w for seq in (*self.sequences, *runs) for w in seq}
        #: By state: the phrases that may end its runs, as (words, label).
        self.phrases: list[list] = [[] for _ in self.automaton.size]
        own = {}
        for run, label in zip(runs, phrases.values()):
            own.setdefault(self.automaton.find(run), []).append((len(run), label))
        for state in sorted(range(len(self.automaton.size)), key=lambda s: self.automaton.size[s]):
            above = self.automaton.link[state]
            self.phrases[state] = own.get(state, []) + (self.phrases[above] if above >= 0 else [])

    def __call__(self, text: str | None) -> tuple:
        """(n_words, base places, base labels, spans): spans are (label, first word, last word, words covered)."""
        words = words_of(text) if text else []
        known, following, link, size = self.known, self.automaton.next, self.automaton.link, self.automaton.size
        base, found, matches = [], set(), []
        state = length = 0
        before = -2
        for at, word in enumerate(words):
            if word not in known:
                continue
            if at != before + 1:
                if length >= MIN_MATCH:
                    matches.append((before - length + 1, before, state))
                state = length = 0
            before = at
            if word not in following[state]:
                if length >= MIN_MATCH:
                    matches.append((at - length, at - 1, state))
                while state and word not in following[state]:
                    state = link[state]
                length = size[state]
            state = following[state][word]
            length += 1
            for n, label in self.phrases[state]:
                if n <= length:
                    base.append((at - n + 1, n))
                    found.add(label)
        if length >= MIN_MATCH:
            matches.append((before - length + 1, before, state))
        return len(words), base, sorted(found), self._spans(matches) if matches else []

    def _spans(self, matches: list[tuple[int, int, int]]) -> list[tuple]:
        """Chains of matches, best first where they overlap, in order of their place."""
        n = len(self.sequences)
        by_template: dict[int, list] = {}
        for first, last, state in matches:
            for number, place in self.automaton.ends[state]:
                if number < n:
                    by_template.setdefault(number, []).append((first, last, place - (last - first), place))
        chains = []
        for number, parts in by_template.items():
            enough = min(LONG_COVER, MIN_COVER * len(self.sequences[number]))
            open_: list[list] = []  # [last word, last place, first word, words covered]
            for first, last, start, place in sorted(parts):
                best = None
                for chain in reversed(open_):
                    gap, skip = first - chain[0] - 1, start - chain[1] - 1
                    if gap > MAX_GAP + 64:
                        break
                    over = max(0, -gap, -skip)  # runs may share words at their ends
                    if gap <= MAX_GAP and skip <= MAX_GAP and over < last - first + 1 and chain[0] < last and chain[1] < place:
                        covered = chain[3] + last - first + 1 - over
                        if best is None or covered > best[3]:
                            best = [last, place, chain[2], covered]
                open_.append(best or [last, place, first, last - first + 1])
            chains += [(-covered, number, first, last) for last, _, first, covered in open_ if covered >= enough]
        taken: list[tuple] = []
        for less, number, first, last in sorted(chains):
            # ``taken`` is in order of place and without overlaps: only two of them can be in the way.
            k = bisect_right(taken, first, key=lambda x: x[1])
            if (not k or taken[k - 1][2] < first) and (k == len(taken) or last < taken[k][1]):
                taken.insert(k, (self.labels[number], first, last, -less))
        return taken


def covered(spans: list[tuple], base: list[tuple[int, int]]) -> int:
    """Words of template spans, and of the phrases (first word, words) that lie beside them."""
    inside = [(a, b) for _, a, b, _ in spans]
    starts, end, more = [a for a, _ in inside], -1, 0
    for first, n in sorted(base):
        for at in range(max(first, end + 1), first + n):
            k = bisect_right(starts, at) - 1
            more += k < 0 or at > inside[k][1]
        end = max(end, first + n - 1)
    return sum(s[3] for s in spans) + more


@lru_cache(maxsize=2)
def _scanner(templates: tuple, phrases: tuple) -> Scanner:
    return Scanner(list(templates), dict(phrases))


def scan_licenses(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] | None = None,
    phrases: dict[str, str] | None = None,
) -> DataFrame:
    """(id, n_words, base_places, base_labels, spans, labels, score) for each row.

    base_places: the word numbers where a base phrase starts, from 0, in order of
    their ends. spans: ``label:first word:last word:words covered`` of the covered
    template spans, comma-joined. labels: of phrases and spans, distinct, sorted,
    comma-joined. score: share of the words that matches of covered spans or base
    phrases cover, 0 for a text without words. A null text counts as empty. Each
    input row gives one row, equal rows and null ids too; other columns are dropped,
    whatever their names; an empty table gives an empty result. Of spans that overlap
    the one with most words covered is told; of equal ones the first template's. A very
    long text takes about 60 bytes of a worker's memory for each of its words.
    """
    templates = tuple(templates if templates is not None else TEMPLATES)
    phrases = tuple((phrases if phrases is not None else PHRASES).items())

    def make():
        scan = _scanner(templates, phrases)

        def work(texts):
            out = []
            for text in texts:
                n, base, found, spans = scan(text)
                labels = sorted({*found, *(s[0] for s in spans)})
                score = covered(spans, base) / n if n else 0.0
                told = ",".join(f"{a}:{b}:{c}:{d}" for a, b, c, d in spans)
                out.append((n, [at for at, _ in base], ",".join(found), told, ",".join(labels), min(1.0, score)))
            return out

        return work

    schema = "n_words long, base_places array<long>, base_labels string, spans string, labels string, score double"
    return per_text(df, [id_col], text_col, schema, make)


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence phrases and covered licence templates in every document."""
    scanned = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min("base_places").alias("first_word"),
        F.array_max("base_places").alias("last_word"),
        "base_labels",
        "labels",
        "score",
        "spans",
    )
