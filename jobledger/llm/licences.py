"""Licence notices found with a generalised suffix automaton of the notices' words.

The automaton of all template notices and phrases is built once from its parameter. Every text
is streamed through it word by word, which gives matching statistics: at each word the
longest stretch ending there that stands in some template. Two adjoining words that adjoin in
no template end every match, so the automaton is entered only inside stretches whose adjoining
words all adjoin in a template; elsewhere the statistic is known to be 0 or 1.

A phrase stands where the matched stretch is at least as long and the phrase's state is the
matched one or above it on the suffix links; all its places are reported.

Long matches (``MIN_MATCH`` words or more, not extended by the next word) are chained per template:
in the order of the text and of the template, with at most ``GAP`` words of the text between two
matches, so that a name put into a notice or a changed word doesn't end it. A chain that
covers at least ``COVERAGE`` of the template's words is a span with the template's label.

Nothing is shuffled; a text is handled by the task that reads it. The automaton is as large as the
templates, never as the corpus.

Defined cases: null text counts as empty, and empty texts have no words, places or spans and score 0; rows
with a null or repeated id are handled each on its own; a text of any length is handled whole; of
equally covering chains the earlier one is kept; spans of one template don't overlap; an empty table
gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES

MIN_MATCH = 4
GAP = 12
COVERAGE = 0.8

#: The phrases that are always reported, and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Usual notices and their labels; a label may have several.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer"),
    ("gpl", "licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
]


def words(data: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text: A-Z in lower case, parted by ASCII other than letters and digits."""
    return (data or b"").translate(WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton of word sequences: their common states, suffix links, lengths and ends."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own = []  # (state of a prefix, sequence, words of the prefix)
        for s, sequence in enumerate(sequences):
            last = 0
            for n, word in enumerate(sequence):
                last = self._extend(last, word)
                own.append((last, s, n + 1))
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for state, s, end in own:
            while state > 0:
                self.ends[state].append((s, end))
                state = self.link[state]

    def _new(self, length: int, link: int, then: dict[int, int]) -> int:
        self.next.append(then)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A state for the words of q no longer than p's and one more; returns q if that is q itself."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # the words stand in an earlier sequence, too
            return self._split(last, word, self.next[last][word])
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, word, self.next[p][word])
        return state

    def stream(self, sequence: list[int]):
        """Matching statistics: (state, length) of the longest stretch that ends at each word."""
        state, length = 0, 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length


class Scanner:
    """Finds places of phrases and covered spans of templates in a text's words."""

    def __init__(self, templates=None, phrases=None, min_match: int = MIN_MATCH, gap: int = GAP, coverage: float = COVERAGE):
        self.templates = [(label, words(text.encode())) for label, text in (TEMPLATES if templates is None else templates)]
        self.phrases = [(label, words(text.encode())) for text, label in (PHRASES if phrases is None else phrases)]
        self.min_match, self.gap, self.coverage = min_match, gap, coverage
        vocabulary: dict[bytes, int] = {}
        all_words = [x for _, x in self.templates + self.phrases]
        numbered = [[vocabulary.setdefault(w, len(vocabulary)) for w in x] for x in all_words]
        self.vocabulary, self.automaton = vocabulary, Automaton(numbered)
        self.adjoin = np.zeros((len(vocabulary) + 1, len(vocabulary) + 1), bool)  # the last: words of no template
        for x in numbered:
            self.adjoin[x[:-1], x[1:]] = True
        self.first = len(self.templates)  # number of the first phrase
        # per state, the phrases (label, words) that end every long enough stretch of it: its own and those above it
        self.ending: list[list[tuple[str, int]]] = [[] for _ in self.automaton.next]
        for state in sorted(range(1, len(self.ending)), key=self.automaton.length.__getitem__):
            own = [(self.phrases[s - self.first][0], e) for s, e in self.automaton.ends[state]
                   if s >= self.first and e == len(self.phrases[s - self.first][1])
                   and self.automaton.length[self.automaton.link[state]] < e <= self.automaton.length[state]]
            self.ending[state] = self.ending[self.automaton.link[state]] + own

    def scan(self, text: list[bytes]):
        """([(label, start)] of phrases, [(label, start, stop, covered, coverage)] of spans, greatest coverage)."""
        none = len(self.vocabulary)
        ids = np.fromiter(map(self.vocabulary.get, text, repeat(none)), np.int64, len(text))
        known = ids != none
        joined = self.adjoin[ids[:-1], ids[1:]] if len(ids) else known
        places, matches, best = [], [], 0.0
        single = [(label, self.vocabulary[x[0]]) for label, x in self.phrases if len(x) == 1]
        for label, word in single:
            places += [(label, int(k)) for k in np.flatnonzero(ids == word)]
        edge = np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            stretch, held = ids[a: b + 1].tolist(), None
            for k, (state, length) in enumerate(self.automaton.stream(stretch)):
                end = a + k + 1
                places += [(label, end - n) for label, n in self.ending[state] if length >= n > 1]
                if held and length <= held[2]:  # not extended by this word
                    matches.append(held)
                held = (end, state, length) if length >= self.min_match else None
            if held:
                matches.append(held)
        spans, best = self._chained(matches)
        return sorted(places, key=lambda x: (x[1], x[0])), spans, 1.0 if places else best

    def _chained(self, matches: list[tuple[int, int, int]]):
        """Per template, the chains of matches that cover enough of it; the greatest coverage of any chain."""
        by_template = defaultdict(list)  # template -> [(start, stop, start in the template)]
        for stop, state, length in matches:
            for s, end in self.automaton.ends[state]:
                if s < self.first and end >= length:
                    by_template[s].append((stop - length, stop, end - length))
        spans, best = [], 0.0
        for s, found in by_template.items():
            label, size = self.templates[s][0], len(self.templates[s][1])
            found.sort()
            chains = []  # (covered, start) of the best chain that ends with each match
            low = 0
            for j, (start, stop, at) in enumerate(found):
                chain = (stop - start, start)
                while found[low][1] < start - self.gap and low < j:
                    low += 1
                for i in range(low, j):
                    i_start, i_stop, i_at = found[i]
                    cut = max(0, i_stop - start, i_at + (i_stop - i_start) - at)  # words that both cover
                    if i_stop >= start - self.gap and cut < stop - start and at + cut > i_at:
                        chain = max(chain, (chains[i][0] + stop - start - cut, chains[i][1]), key=lambda c: (c[0], c[1]))
                chains.append(chain)
            best = max(best, max(c / size for c, _ in chains))
            taken_to = -1
            enough = [(-c, a, found[j][1]) for j, (c, a) in enumerate(chains) if c >= self.coverage * size]
            for start, stop, covered in _apart(enough):
                spans.append((label, start, stop, covered, min(1.0, covered / size)))
        return sorted(spans, key=lambda x: (x[1], x[2], x[0])), min(1.0, best)


def _apart(chains: list[tuple[int, int, int]]):
    """(start, stop, covered) of chains that don't overlap: the best of each group of overlapping ones."""
    out: list[tuple[int, int, int]] = []
    for less, start, stop in sorted(chains, key=lambda x: (x[1], x[0], x[2])):
        if out and start < out[-1][1]:
            if -less > out[-1][2]:
                out[-1] = (start, stop, -less)
            continue
        out.append((start, stop, -less))
    return out


_PLACE = pa.struct([("label", pa.string()), ("start", pa.int64())])
_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("covered", pa.int64()),
                   ("coverage", pa.float64())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, phrases=None) -> DataFrame:
    """One row per row: the id, ``n_words``, ``places`` of phrases, ``spans`` of templates (words from 0) and ``score``,
    the greatest share of a template that one chain covers (1 where a phrase stands)."""
    scanner = Scanner(templates, phrases)

    def run(batches):
        for batch in batches:
            counts, places, spans, scores = [], [], [], []
            for data in batch.column(1):
                text = words(data.as_py())
                place, span, score = scanner.scan(text)
                counts.append(len(text))
                places.append([{"label": a, "start": b} for a, b in place])
                spans.append([dict(zip(("label", "start", "stop", "covered", "coverage"), x)) for x in span])
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(places, pa.list_(_PLACE)),
                 pa.array(spans, pa.list_(_SPAN)), pa.array(scores, pa.float64())],
                names=[id_col, "n_words", "places", "spans", "score"])

    schema = (f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, places array<struct<label:string,start:long>>, "
              "spans array<struct<label:string,start:long,stop:long,covered:long,coverage:double>>, score double")
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").cast("binary")).mapInArrow(run, schema)
