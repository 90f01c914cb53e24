"""Licence scans by matching statistics over a generalised suffix automaton.

The automaton holds the tokens of all templates. Files are streamed through it:
after each token the state tells the longest suffix of the file that occurs in
some template, and its suffix links the shorter ones that occur at further
places. Where the template goes on otherwise than the file, a match at that place
ends, so a match inside a longer one of another template counts too; matches of
at least `shortest` tokens (or a whole shorter template) are chained, in the
order of both file and template, into spans of a template, and a template is
reported when its spans cover enough of it. Only stretches whose neighbouring
tokens are neighbours in some template are streamed, and single tokens that are
a template; others cannot hold a match. Templates are those of this module, a
mapping, or text files by their names (`templates_from`); their automaton is
built once and broadcast, its size being that of the templates.

Edge cases: a null or empty text has no words, no label and score 0; texts of
any length are read slice by slice, a document never being split; other columns
of the table are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import _arrow as A
from lamina.llm._session import arrow_map, named

#: Phrases of the base scan and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Template texts of well-known licence notices, by label.
TEMPLATES = {
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd-clauses": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.""",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "gpl-3.0": "licensed under the GNU General Public License, version 3",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.""",
    "mit": "Released under the MIT License",
    "mit-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject
to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense": "This is free and unencumbered software released into the public domain",
}

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")


def tokens(text: str) -> list[bytes]:
    return TOKEN.findall(bytes(A.LOWER[np.frombuffer(text.encode(), np.uint8)]))


class Automaton:
    """Generalised suffix automaton of token rows."""

    def __init__(self, rows: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        self.rows = rows
        for t, row in enumerate(rows):
            state = 0
            for i, token in enumerate(row):
                state = self._extend(state, token)
                self.ends[state].add((t, i))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, token: int) -> int:
        """The state of exactly length[p] + 1 behind p's edge; a copy is made if need be."""
        q = self.next[p][token]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        made, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = made
            p = self.link[p]
        if p >= 0:
            self.link[made] = self._split(p, token)
        return made

    def walk(self, row: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics of the row: length and state after each token."""
        state = size = 0
        for token in row:
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.next[state]:
                state, size = self.next[state][token], size + 1
            else:
                size = 0
            yield size, state

    def matches(self, row: list[int]) -> Iterator[tuple[int, int, int]]:
        """End, length and state of each maximal match."""
        before = held = 0
        for i, (size, state) in enumerate(self.walk(row)):
            if before and size <= before:
                yield i, before, held
            before, held = size, state
        if before:
            yield len(row), before, held

    def places(self, row: list[int], shortest: int) -> Iterator[tuple[int, int, int, int]]:
        """End, length, template and last token there of each match of at least `shortest` tokens that its template does not carry on."""
        for i, (size, state) in enumerate(self.walk(row)):
            token, longer = row[i + 1] if i + 1 < len(row) else -1, set()
            while state > 0 and size >= shortest:
                for t, stop in self.ends[state] - longer:
                    if stop + 1 == len(self.rows[t]) or self.rows[t][stop + 1] != token:
                        yield i + 1, size, t, stop
                longer, state = self.ends[state], self.link[state]
                size = self.length[state]


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str], shortest: int, cover: float, gap: int) -> None:
        self.names, self.shortest, self.cover, self.gap = list(templates), shortest, cover, gap
        rows = [tokens(x) for x in templates.values()]
        spoken = [tokens(x) for x in phrases]
        known = {w: None for row in [*rows, *spoken] for w in row}
        flat = np.frombuffer(b"".join(known), np.uint8)
        ends = np.cumsum([len(w) for w in known])
        hashes = A.span_hashes(flat, np.r_[0, ends[:-1]], ends)
        self.hashes = np.sort(hashes)
        number = dict(zip(known, np.argsort(np.argsort(hashes)).tolist(), strict=True))
        self.rows = [[number[w] for w in row] for row in rows]
        self.phrases = [([number[w] for w in row], label) for row, label in zip(spoken, phrases.values(), strict=True)]
        self.automaton = Automaton(self.rows)
        self.least = min([shortest, *[len(row) for row in self.rows if row]])
        self.near = np.unique([a * len(known) + b for row in self.rows for a, b in zip(row, row[1:], strict=False)] or [-1])
        self.single = np.zeros(len(known) + 1, bool)  # words that are a template by themselves
        self.single[[row[0] for row in self.rows if len(row) == 1]] = True

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = A.span_hashes(data, starts, ends)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == h, at, len(self.hashes))

    def spans(self, ids: np.ndarray, row: np.ndarray) -> dict[int, list[tuple[int, int, int, int]]]:
        """Matches (file start, template start, length, template) by row of the slice."""
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        if not len(ids):
            return found
        n = len(self.hashes)
        known = ids < n
        pair = np.zeros(len(ids), bool)  # with the next word
        pair[:-1] = known[:-1] & known[1:] & (row[1:] == row[:-1])
        at = np.flatnonzero(pair)
        code = ids[at].astype(np.int64) * n + ids[at + 1]
        place = np.searchsorted(self.near, code)
        pair[at] = self.near[np.minimum(place, len(self.near) - 1)] == code
        joined = pair.copy()
        joined[1:] |= pair[:-1]
        first = np.flatnonzero((pair & ~np.r_[False, pair[:-1]]) | (~joined & self.single[ids]))
        last = np.flatnonzero((~pair & np.r_[False, pair[:-1]]) | (~joined & self.single[ids]))
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a + 1 < self.least:
                continue
            for end, size, t, stop in self.automaton.places(ids[a : b + 1].tolist(), self.least):
                if size >= min(self.shortest, len(self.rows[t])):
                    found.setdefault(int(row[a]), []).append((a + end - size, stop + 1 - size, size, t))
        return found

    def chains(self, matches: list[tuple[int, int, int, int]]) -> dict[int, tuple[float, int, int]]:
        """Best chain of each template: share of it that is covered, first and last word of the span."""
        best: dict[int, tuple[float, int, int]] = {}
        for t in {m[3] for m in matches}:
            held: list[list[int]] = []  # covered, file start, file end, template end
            near: list[list[int]] = []  # those that a later match may still go on from
            for at, place, size, _ in sorted(m for m in matches if m[3] == t):
                near = [c for c in near if c[2] + self.gap >= at]
                base = max((c for c in near if c[2] <= at and c[3] <= place), default=None)
                held.append([(base[0] if base else 0) + size, base[1] if base else at, at + size, place + size])
                near.append(held[-1])
            covered, start, end, _ = max(held)
            best[t] = (covered / len(self.rows[t]), start, end - 1)
        return best

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """Per row: words, base places, first and last of them, base labels, labels, score, spans."""
        data = A.LOWER[data]
        starts, ends, row = A.words(data, offsets, A.ALNUM)
        by = np.searchsorted(row, np.arange(len(offsets)))
        ids = self.ids(data, starts, ends)
        n = len(offsets) - 1
        places = np.zeros(n, np.int64)
        low, high = np.full(n, 1 << 62), np.full(n, -1)
        base: list[set[str]] = [set() for _ in range(n)]
        for phrase, label in self.phrases:
            m = len(ids) - len(phrase) + 1
            if m < 1:
                continue
            hit = row[:m] == row[len(phrase) - 1 :]
            for i, word in enumerate(phrase):
                hit &= ids[i : i + m] == word
            at = np.flatnonzero(hit)
            where = row[at]
            np.add.at(places, where, 1)
            np.minimum.at(low, where, at - by[where])
            np.maximum.at(high, where, at - by[where])
            for r in np.unique(where).tolist():
                base[r].add(label)
        labels, score = [set(x) for x in base], np.array([float(bool(x)) for x in base])
        spans: list[list[dict]] = [[] for _ in range(n)]
        for r, matches in self.spans(ids, row).items():
            for t, (share, a, b) in sorted(self.chains(matches).items()):
                if share >= self.cover:
                    labels[r].add(self.names[t])
                    spans[r].append({"template": self.names[t], "first": a - int(by[r]), "last": b - int(by[r]), "covered": share})
                score[r] = max(score[r], min(1.0, share))
        return np.diff(by), places, low, high, base, labels, score, spans


def templates_from(spark: SparkSession, path: str) -> dict[str, str]:
    """Licence texts of a folder, by file name without its ending: a bounded set, held by the driver."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), "value").orderBy("name").collect()
    return {r.name: r.value for r in rows}


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<template: string, first: long, last: long, covered: double>>"


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None,
    shortest: int = 4,
    cover: float = 0.75,
    gap: int = 12,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Labels of every text, with the template spans they come from. No shuffle; the automaton's size is that of the templates."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates, phrases, shortest, cover, gap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        struct = pa.list_(pa.struct([("template", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))
        for batch in batches:
            data, offsets = A.buffer(A.rows(batch, "text"))
            ids = A.rows(batch, "doc_id")
            for i, j in A.slices(offsets):
                n, places, low, high, base, labels, score, spans = scanner.scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                none = places == 0
                names = lambda x: pa.array([",".join(sorted(s)) for s in x], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(places), pa.array(low, mask=none), pa.array(high, mask=none), names(base), names(labels), pa.array(score), pa.array(spans, struct)],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    frame = docs.select(named(id_column).cast("long").alias("doc_id"), named(text).cast("string").alias("text"))
    out = arrow_map(frame, run, SCHEMA)
    return out.withColumnRenamed("doc_id", id_column)
