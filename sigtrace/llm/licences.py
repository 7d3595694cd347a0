"""Licence scans: matching statistics against licence templates, chained into covered spans."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textops import map_arrow, raw, texts

#: Phrases that name a licence outright, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices by label, in the wording their licences prescribe (fixed values).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details. You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
}

#: Everything that is not a digit, a-z (after lower-casing) or beyond ASCII separates words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def licence_words(text: str | None) -> list[bytes]:
    return raw(text).translate(_TABLE).split()


class SuffixAutomaton:
    """All runs of tokens of several sequences, with the places where they end in each."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].setdefault(number, place)
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                own = self.ends[self.link[state]]
                for number, place in self.ends[state].items():
                    own[number] = min(place, own.get(number, place))

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:  # another sequence has been this way
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
        state = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return state

    def statistics(self, tokens: list[int]):
        """At each place the length of the longest run that ends there and occurs in a sequence, and its state."""
        state = size = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            state = self.next[state].get(token, 0)
            size = size + 1 if state else 0
            yield size, state


@dataclass(frozen=True)
class Span:
    """Words first..last of a text cover a share of a template."""

    label: str
    template: int
    first: int
    last: int
    coverage: float


class Scanner:
    """Finds template spans in whole texts."""

    #: Runs below so many words say nothing; gaps between chained runs; the least share of a template, or words of a long one.
    RUN, GAP, SHARE, LONG = 4, 40, 0.6, 25

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.labels = [label for label, own in templates.items() for _ in own]
        own = [licence_words(t) for several in templates.values() for t in several]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in own for w in t}))}
        self.sizes = [len(t) for t in own]
        self.automaton = SuffixAutomaton([[self.vocabulary[w] for w in t] for t in own])
        self.phrases = [([w.encode() for w in p.split()], label) for p, label in phrases.items()]
        self.marks = {p[-1] for p, _ in self.phrases}
        self.hint = re.compile(b"|".join(re.escape(p[-1]) for p, _ in self.phrases))

    def base(self, own: list[bytes]) -> tuple[int, int | None, int | None, list[str]]:
        """(places, first start, last start, labels) of the phrases."""
        starts, labels = [], set()
        at = [i for i, w in enumerate(own) if w in self.marks]
        for phrase, label in self.phrases:
            k = len(phrase)
            found = [i - k + 1 for i in at if i >= k - 1 and own[i - k + 1:i + 1] == phrase]
            starts += found
            if found:
                labels.add(label)
        return len(starts), min(starts, default=None), max(starts, default=None), sorted(labels)

    def spans(self, own: list[bytes]) -> list[Span]:
        """Long matches, chained per template where both sides go forward, if they cover enough of it."""
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in own), np.int64, len(own))
        known = np.concatenate([[False], ids >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
        matches: list[tuple[int, int, int]] = []  # (last word, length, state)
        for start, stop in edges[edges[:, 1] - edges[:, 0] >= self.RUN].tolist():
            before = (0, 0)
            for place, here in enumerate(self.automaton.statistics(ids[start:stop].tolist()), start):
                if before[0] >= self.RUN and here[0] <= before[0]:
                    matches.append((place - 1, *before))
                before = here
            if before[0] >= self.RUN:
                matches.append((stop - 1, *before))
        enough = [min(self.SHARE * n, self.LONG) for n in self.sizes]
        open_chains: dict[int, list[list[int]]] = {}  # template -> [first, last, template end, words covered]
        closed: list[tuple[int, list[int]]] = []
        for last, size, state in matches:
            first = last - size + 1  # never falls from match to match, so a chain too far back is done
            for template, end in self.automaton.ends[state].items():
                live, best = [], None
                for chain in open_chains.get(template, ()):
                    if first - chain[1] > self.GAP:
                        closed.append((template, chain))
                        continue
                    live.append(chain)
                    fresh = min(size, last - chain[1], end - chain[2])
                    if fresh > 0 and (best is None or chain[3] > best[0][3]):
                        best = (chain, fresh)
                if best:
                    chain, fresh = best
                    chain[1:] = [last, end, chain[3] + fresh]
                else:
                    live.append([first, last, end, size])
                open_chains[template] = live
        closed += [(t, c) for t, live in open_chains.items() for c in live]
        order = {t: k for k, t in enumerate(open_chains)}
        found = sorted(((order[t], c[0], t, c) for t, c in closed if c[3] >= enough[t]), key=lambda f: f[:2])
        return [Span(self.labels[t], t, c[0], c[1], min(1.0, c[3] / self.sizes[t])) for _, _, t, c in found]

    def scan(self, text: str | None):
        """(n_words, base figures, spans)."""
        data = raw(text).translate(_TABLE)
        own = data.split()
        base = self.base(own) if self.hint.search(data) else (0, None, None, [])
        return len(own), base, self.spans(own)


def licence_scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", scanner: Scanner | None = None) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) per row.

    ``spans`` holds (label, first, last, coverage) in words from 0; labels join
    the phrases' and the spans'; the score is the best coverage, at least 0.5
    where a phrase stands.  Null and empty texts have no words, labels "" and
    score 0; null ids stay null; repeated rows are scanned one by one; an empty
    table gives no rows; other columns are not read.  The automaton is built
    from the templates alone, so its size does not grow with the data.
    """
    scanner = scanner or Scanner()
    span_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())]))

    def work(batch):
        rows = []
        for t in texts(batch, text_col):
            n, (many, first, last, base), spans = scanner.scan(t)
            labels = sorted({*base, *(s.label for s in spans)})
            score = max([0.5 * bool(many), *(s.coverage for s in spans)])
            rows.append((n, many, first, last, ",".join(base), ",".join(labels), score,
                         [{"label": s.label, "first": s.first, "last": s.last, "coverage": s.coverage} for s in spans]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span_type]
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index(id_col)), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))],
            names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), work,
                     f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                     "score double, spans array<struct<label:string,first:long,last:long,coverage:double>>")
