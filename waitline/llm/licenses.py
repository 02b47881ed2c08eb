"""License scan with a generalised suffix automaton over licence words.

The automaton holds every run of words of every template. Reading a document word by word, it gives for
each place the longest run ending there that occurs in some template. Maximal runs long enough are chained
per template (in order, with short gaps) into spans.

Templates are short notices and whole licence texts (`license_texts`). A text is read as one sequence of
passages (its paragraphs, short ones joined with the next), a notice is one passage. A span may reach over the
whole text; its cover is the share of the best covered passage, so one later paragraph alone is found as well.
Licences share passages: a span inside one of another licence that covers more words gives no label.

Defined cases: a null text counts as empty (no words, no labels, score 0); texts of any length are read
whole, word by word; phrases may overlap, each place counts; ties between templates give all labels;
repeated rows are scored alike; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import pkgutil
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from waitline.llm.common import chunks, texts
from waitline.sources.session import ship_package

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices, and opening words as they stand alone, with the label each gives.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("reserved", "Copyright. All rights reserved."),
    ("gpl", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl", "Licensed under the GNU General Public License, version 2 or later."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
             "Public License as published by the Free Software Foundation"),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    # The passage that the AGPL has and the GPL has not; its other terms are those of the GPL's text.
    ("agpl", "Notwithstanding any other provision of this License, if you modify the Program, your modified version must "
             "prominently offer all users interacting with it remotely through a computer network (if your version supports such "
             "interaction) an opportunity to receive the Corresponding Source of your version by providing access to the "
             "Corresponding Source from a network server at no charge, through some standard or customary means of facilitating "
             "copying of software."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
            "distributed with this file, You can obtain one at"),
    ("mpl", "Licensed under the Mozilla Public License, version 2.0."),
    ("isc", "Licensed under the ISC License."),
    ("bsd", "Licensed under the BSD License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc0", "Released under CC0 1.0 Universal."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("epl", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse "
            "Public License"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
             "Documentation License"),
)
#: Whole licence texts, files of `license_texts`.
WHOLE = (
    ("mit", "MIT"), ("isc", "ISC"), ("bsd", "BSD"), ("unlicense", "Unlicense"), ("bsl-1.0", "BSL-1.0"), ("apache-2.0", "Apache-2.0"),
    ("gpl", "GPL-1"), ("gpl", "GPL-2"), ("gpl", "GPL-3"), ("lgpl", "LGPL-2"), ("lgpl", "LGPL-2.1"), ("lgpl", "LGPL-3"),
    ("gfdl", "GFDL-1.3"), ("mpl", "MPL-1.1"), ("mpl", "MPL-2.0"), ("epl", "EPL-1.0"), ("cc0", "CC0-1.0"),
    ("cc-by-sa", "CC-BY-SA-3.0"), ("cc-by-sa", "CC-BY-SA-4.0"), ("artistic", "Artistic"),
)
SHORTEST, GAP, COVER = 3, 4, 0.75
#: In whole texts: the shortest run that counts and the shortest passage, in words.
SHORTEST_OF_TEXT, PASSAGE = 5, 16
SEPARATORS = bytes(0x20 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, spans array<struct<label: string, start: long, stop: long, cover: double>>")


def scan_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(SEPARATORS).split()


def passages(text: str) -> list[list[bytes]]:
    """Words of the paragraphs of a text; one of fewer than PASSAGE words belongs to the next, or at the end to the one before."""
    out: list[list[bytes]] = [[]]
    for words in map(scan_words, re.split(r"\n\s*\n", text)):
        if len(out[-1]) >= PASSAGE:
            out.append([])
        out[-1] += words
    if len(out) > 1 and len(out[-1]) < PASSAGE:
        last = out.pop()
        out[-1] += last
    return out


def whole_text(name: str) -> str:
    return pkgutil.get_data("waitline.llm", f"license_texts/{name}.txt").decode()


@lru_cache(1)
def default_scanner() -> Scanner:
    """The scanner of all templates, built once in a Python worker."""
    return Scanner()


class Automaton:
    """Suffix automaton of several word sequences; every state knows where in each template its runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((number, place))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The state for the runs of q that end after p; a copy of q if q also holds longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # the run is there from an earlier template
            return self._split(last, self.next[last][word], word)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][word], word)
        return new

    def matches(self, ids: list[int], start: int, stop: int) -> Iterator[tuple[int, int, int]]:
        """(place, length, state) of maximal runs within ids[start:stop]: those that the next word breaks."""
        state = length = 0
        for i in range(start, stop):
            word = ids[i]
            if length and word not in self.next[state]:
                yield i, length, state
                while state and word not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
        if length:
            yield stop, length, state


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, whole=WHOLE):
        self.labels = [label for label, _ in (*templates, *whole)]
        parts = [[scan_words(text)] for _, text in templates] + [passages(whole_text(name)) for _, name in whole]
        split = [[w for words in p for w in words] for p in parts]
        spoken = {tuple(scan_words(p)): label for p, label in phrases.items()}
        self.vocabulary: dict[bytes, int] = {}
        for word in [w for s in [*split, *spoken] for w in s]:
            self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
        number = self.vocabulary.__getitem__
        self.passage_size = [[len(words) for words in p] for p in parts]
        self.passage_at = [[k for k, words in enumerate(p) for _ in words] for p in parts]
        self.least = [min(SHORTEST, len(s)) for s in split[:len(templates)]] + [SHORTEST_OF_TEXT] * len(whole)
        self.automaton = Automaton([[number(w) for w in s] for s in split])
        # Ends in templates for which every run of the state is too short are never asked for.
        self.ends = [sorted(e for e in ends if n >= self.least[e[0]]) if n >= 2 else []
                     for n, ends in zip(self.automaton.length, self.automaton.ends)]
        self.automaton.ends = []
        self.phrases: dict[int, list[tuple[list[int], str]]] = {}
        for words, label in spoken.items():
            ids = [number(w) for w in words]
            self.phrases.setdefault(ids[0], []).append((ids, label))

    def scan(self, text: str) -> tuple:
        words = scan_words(text)
        ids = [*map(self.vocabulary.get, words, bytes(len(words)))]
        places, base = [], set()
        runs, start = [], -1
        for i in (i for i, w in enumerate(ids) if w):
            for phrase, label in self.phrases.get(ids[i], ()):
                if ids[i:i + len(phrase)] == phrase:
                    places.append(i)
                    base.add(label)
            if start < 0 or i != stop:
                if start >= 0 and stop - start >= 2:
                    runs.append((start, stop))
                start = i
            stop = i + 1
        if start >= 0 and stop - start >= 2:
            runs.append((start, stop))
        spans = self._spans(ids, runs)
        score = max([1.0 if places else 0.0, *(x[3] for x in spans)])
        found = base | self._labels([x for x in spans if x[3] >= COVER])
        return (len(words), len(places), min(places, default=None), max(places, default=None),
                ",".join(sorted(base)), ",".join(sorted(found)), score, [x[:4] for x in spans])

    @staticmethod
    def _labels(spans: list[tuple]) -> set[str]:
        """Labels of the spans that lie in no span of another label with more words, or as many and more cover."""
        found, outer = set(), []
        for label, start, stop, cover, words in sorted(spans, key=lambda x: (x[1], -x[2], -x[4], -x[3])):
            outer = [x for x in outer if x[2] >= stop]
            if not any(x[0] != label and (x[4], x[3]) > (words, cover) for x in outer):
                found.add(label)
            outer.append((label, start, stop, cover, words))
        return found

    def _spans(self, ids: list[int], runs: list[tuple[int, int]]) -> list[tuple]:
        """Chain long matches of a template, in its order and GAP words apart at most, and measure what they cover."""
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for start, stop in runs:
            for place, length, state in self.automaton.matches(ids, start, stop):
                for number, end in self.ends[state]:
                    if length >= self.least[number]:
                        hits.setdefault(number, []).append((place - length, end + 1 - length, length))
        best: dict[tuple[int, str], tuple] = {}
        for number, found in hits.items():
            for chain in self._chains(sorted(found)):
                cover, label = self._cover(number, chain), self.labels[number]
                key = (chain[0], label)
                if (cover, chain[3]) > best.get(key, (0, 0, 0, 0.0, 0))[3:]:
                    best[key] = (label, chain[0], chain[1], cover, chain[3])
        return sorted(best.values(), key=lambda x: (x[1], x[0]))

    @staticmethod
    def _chains(hits: list[tuple[int, int, int]]) -> list[list]:
        """Each hit (place in text, place in template, words) extends the longest chain it fits to, without words of that chain.

        Of equally long ones it takes the nearest in the template. A chain: start and end in the text, end in the template, words covered, [place in template, words] pieces
        as a linked list, whether another one extends it.
        """
        out: list[list] = []
        near: list[list] = []
        for at, inside, length in hits:
            near = [c for c in near if c[1] + GAP >= at]
            fit, cut = None, 0
            for c in near:
                d = max(0, c[1] - at, c[2] - inside)
                if d < length and at + d <= c[1] + GAP and (fit is None or (c[3] - d, c[2]) > (fit[3] - cut, fit[2])):
                    fit, cut = c, d
            if fit:
                fit[5] = True
                n = length - cut
                new = [fit[0], at + length, inside + length, fit[3] + n, (inside + cut, n, fit[4]), False]
            if not fit or cut:
                out.append([at, at + length, inside + length, length, (inside, length, None), False])
                near.append(out[-1])
            if fit:
                out.append(new)
                near.append(new)
        return [c for c in out if not c[5]]

    def _cover(self, number: int, chain: list) -> float:
        """Covered share of the passage that a chain covers best."""
        size, passage_at = self.passage_size[number], self.passage_at[number]
        covered: dict[int, int] = {}
        piece = chain[4]
        while piece:
            at, left, piece = piece
            while left:
                k = passage_at[at]
                n = left if len(size) == 1 else min(left, self._rest(number, at))
                covered[k] = covered.get(k, 0) + n
                at, left = at + n, left - n
        return max(n / size[k] for k, n in covered.items())

    def _rest(self, number: int, at: int) -> int:
        """Words from a place to the end of its passage."""
        return bisect_right(self.passage_at[number], self.passage_at[number][at]) - at


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, whole=WHOLE) -> DataFrame:
    """Words, phrase places, labels, score and covered template spans of every document. No shuffle."""
    ship_package(docs.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", spans")[0].split(", ")] + ["spans"]
    spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("cover", pa.float64())]))
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), spans]

    usual = (templates, phrases, whole) == (TEMPLATES, PHRASES, WHOLE)

    def run(batches):
        scanner = default_scanner() if usual else Scanner(templates, phrases, whole)
        for held in chunks(batches):
            rows = [(key, *scanner.scan(text)) for key, text in held]
            columns = list(zip(*rows))
            columns[-1] = [[dict(zip(("label", "start", "stop", "cover"), s)) for s in x] for x in columns[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return texts(docs).mapInArrow(run, SCHEMA)
