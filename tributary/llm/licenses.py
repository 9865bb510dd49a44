"""Licence scans with a generalised suffix automaton of licence templates.

Files are streamed through the automaton of the template words. Of every maximal match the place in
the templates is known from the automaton; matches of ``LONG`` words or more that lie in order in one
template, with small gaps in file and template, are chained into one covered span. A template whose
chain covers ``MIN_COVERAGE`` of it gives its label; the score of a file is its best coverage (1 where
a base phrase names the licence outright).

The automaton is broadcast: the templates are the fixed texts below. Only stretches of words and
neighbouring pairs that occur in the templates are walked, see the decontamination module.

Defined cases: null or empty text has no words, no labels, empty label strings and score 0; a text
may hold several licences; repeated rows are scanned as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tributary.llm import words as W
from tributary.llm.automaton import SuffixAutomaton
from tributary.llm.decontaminate import member

#: Phrases that name a licence outright, and its label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Opening or notice texts of public licences.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
        and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
        in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details.""",
    "cc-by": """This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy
        of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons,
        PO Box 1866, Mountain View, CA 94042, USA.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies.""",
}

LONG = 5
MAX_GAP = 8
MIN_COVERAGE = 0.5


def _words(text: str) -> list[bytes]:
    c = next(W.chunks(pa.array([text]), mark=True))
    return [c.text(i) for i in range(len(c.hash))]


class Templates:
    """The automaton of phrases and templates, and where each state ends in a template."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]) -> None:
        self.labels = list(templates)
        self.lengths = []
        self.automaton = sam = SuffixAutomaton()
        self.phrase: dict[int, list[tuple[int, str]]] = {}
        self.phrases = [(_words(p), label) for p, label in phrases.items()]
        sequences = [_words(t) for t in templates.values()]
        for s in [*sequences, *(p for p, _ in self.phrases)]:
            sam.add(s)
        self.ends: dict[int, list[tuple[int, int]]] = {}  # state -> (template, place after the match)
        for k, s in enumerate(sequences):
            self.lengths.append(len(s))
            for i, (_, state) in enumerate(sam.matches(s)):
                at = state
                while at > 0:
                    self.ends.setdefault(at, []).append((k, i + 1))
                    at = sam.link[at]
        for p, label in self.phrases:
            *_, (_, state) = sam.matches(p)
            self.phrase.setdefault(sam.of_length(state, len(p)), []).append((len(p), label))
        self.least = min([LONG, *(len(p) for p, _ in self.phrases)])
        words, pairs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for c in W.chunks(pa.array([*templates.values(), *phrases]), mark=True):
            words.append(c.hash)
            pairs.append(c.windows(2, 2)[1])
        self.words, self.pairs = np.unique(np.concatenate(words)), np.unique(np.concatenate(pairs))

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int, int]]]:
        """Base phrases (start, end, label), and long maximal matches (template, its start, file start, words)."""
        sam, base, long = self.automaton, [], []
        stats = list(sam.matches(tokens))
        for i, (n, state) in enumerate(stats):
            at, m = state, n
            while at > 0:
                base += [(i + 1 - size, i + 1, label) for size, label in self.phrase.get(at, ()) if size <= m]
                at = sam.link[at]
                m = min(m, sam.length[at])
            if n >= LONG and (i + 1 == len(stats) or stats[i + 1][0] <= n):
                long += [(k, end - n, i + 1 - n, n) for k, end in self.ends.get(state, ())]
        return base, long


def chained(long: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Chains of matches in order in file and template: (template, words covered, file start, file end)."""
    chains: list[list[int]] = []  # template, covered, file start, file end, template end
    near: list[list[int]] = []  # chains that a match at this place or behind can go on
    for k, t, f, n in sorted(long, key=lambda x: (x[0], x[2], x[1])):
        best = None
        near = [c for c in near if c[0] == k and f - c[3] <= MAX_GAP]
        for c in near:
            if -n < f - c[3] <= MAX_GAP and -n < t - c[4] <= MAX_GAP and t + n > c[4] and f + n > c[3] and (best is None or c[1] > best[1]):
                best = c
        if best is None:
            chains.append([k, n, f, f + n, t + n])
            near.append(chains[-1])
        else:
            fresh = n - max(0, best[4] - t, best[3] - f)
            if fresh > 0:
                best[1], best[3], best[4] = best[1] + fresh, f + n, t + n
    return [(k, n, f, e) for k, n, f, e, _ in chains]


def stretches(c: W.Words, t: Templates) -> Iterator[tuple[int, int, int]]:
    """(document, start, end) of stretches all of whose words and neighbouring pairs occur in the templates."""
    n = len(c.hash)
    if n < t.least:
        return
    known = member(t.words, c.hash)
    joined = np.zeros(n, bool)
    both = np.flatnonzero(known[1:] & known[:-1]) + 1
    if len(both):
        p = W.powers(2, 2)
        joined[both] = member(t.pairs, W.mix(c.hash[both - 1] * p[0] + c.hash[both] * p[1]))
    joined[c.offset[:-1][np.diff(c.offset) > 0]] = False
    start = np.flatnonzero(~joined)
    end = np.append(start[1:], n)
    keep = (end - start >= t.least) & known[start]
    start, end = start[keep], end[keep]
    docs = np.searchsorted(c.offset, start, side="right") - 1
    yield from zip(docs.tolist(), start.tolist(), end.tolist(), strict=True)


def licence_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels, labels, score and the covered
    spans (label, start, end, coverage) of templates.

    Null text is empty. A match goes on with the chain that covers most, of chains as long with the first; work
    grows with the matches of a text, each being held against the chains that end near it. Only key and text
    are read, so other columns' names don't matter; without templates (or phrases) only phrases (templates)
    are found."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:int,end:int,coverage:double>>"
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(templates, phrases)
        for batch in batches:
            rows = batch.num_rows
            n_words = np.zeros(rows, np.int64)
            base: dict[int, list[tuple[int, str]]] = {}
            spans: dict[int, list[dict]] = {}
            for c in W.chunks(batch.column(text), mark=True):
                n_words[c.first : c.first + c.n_docs] = np.diff(c.offset)
                long: dict[int, list[tuple[int, int, int, int]]] = {}
                for d, start, end in stretches(c, t):
                    found, own = t.scan([c.text(i) for i in range(start, end)])
                    at = start - int(c.offset[d])
                    if found:
                        base.setdefault(c.first + d, []).extend((at + s, label) for s, _, label in found)
                    if own:
                        long.setdefault(d, []).extend((k, p, at + f, n) for k, p, f, n in own)
                for d, own in long.items():
                    good = [(k, n / t.lengths[k], s, e) for k, n, s, e in chained(own)]
                    if good:
                        spans[c.first + d] = [{"label": t.labels[k], "start": s, "end": e, "coverage": min(1.0, x)} for k, x, s, e in good]
            by = [base.get(i, []) for i in range(rows)]
            by_span = [spans.get(i, []) for i in range(rows)]
            labels = [{x for _, x in b} | {x["label"] for x in s if x["coverage"] >= min_coverage} for b, s in zip(by, by_span, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(key),
                pa.array(n_words),
                pa.array([len(b) for b in by], pa.int64()),
                pa.array([min(b)[0] if b else None for b in by], pa.int64()),
                pa.array([max(b)[0] if b else None for b in by], pa.int64()),
                pa.array([",".join(sorted({x for _, x in b})) for b in by], pa.string()),
                pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                pa.array([1.0 if b else max([0.0, *(x["coverage"] for x in s)]) for b, s in zip(by, by_span, strict=True)], pa.float64()),
                pa.array(by_span, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64())]))),
            ], names=[key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(key, text).mapInArrow(run, schema)


def op3(docs: DataFrame) -> DataFrame:
    return licence_scan(docs).drop("spans")
