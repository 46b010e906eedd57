"""Licence scans with a generalised suffix automaton of licence words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Lower-cases A-Z and turns other ASCII than letters and digits into blanks.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: Phrases that give a label wherever their words stand together.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Licence texts or notices by label: fixed values, public texts.
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
     documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
     rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
     persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
     this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
     with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
     applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
     WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
     governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
     License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
     version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
     implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
     details."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
     following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
     conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
     list of conditions and the following disclaimer in the documentation and/or other materials provided with the
     distribution."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
     distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
     granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mit", """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
     WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
     COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
     ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
     INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
     IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
     CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
     PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
     TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
     POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
     WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
     CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
     NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
     Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
     version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
     warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
     Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
     version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
     warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
     use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
     commercial or non-commercial, and by any means."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
     for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
     including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The
     origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
     software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source
     versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be
     removed or altered from any source distribution."""),
    ("cc-by", """This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license,
     visit http://creativecommons.org/licenses/by/4.0/"""),
)


def licence_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class SuffixAutomaton:
    """Generalised: all substrings of several word sequences; a state has the (sequence, end) places of its strings."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for end, symbol in enumerate(sequence):
                last = self.extend(last, symbol)
                self.places[last].add((number, end))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.places[self.link[state]] |= self.places[state]

    def new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.places.append(set())
        return len(self.length) - 1

    def split(self, at: int, symbol: int, state: int) -> int:
        """A copy of ``state`` for its strings that are no longer than those of ``at`` plus the symbol."""
        copy = self.new(self.length[at] + 1, self.link[state], dict(self.next[state]))
        self.link[state] = copy
        while at != -1 and self.next[at].get(symbol) == state:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy

    def extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            state = self.next[last][symbol]
            return state if self.length[state] == self.length[last] + 1 else self.split(last, symbol, state)
        made, at = self.new(self.length[last] + 1, 0, {}), last
        while at != -1 and symbol not in self.next[at]:
            self.next[at][symbol] = made
            at = self.link[at]
        if at != -1:
            state = self.next[at][symbol]
            self.link[made] = state if self.length[state] == self.length[at] + 1 else self.split(at, symbol, state)
        return made


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...], shortest: int, gap: int, share: float):
        self.labels = [label for label, _ in templates]
        self.phrase_labels = [label for _, label in phrases]
        texts = [licence_words(t) for _, t in templates]
        spoken = [licence_words(p) for p, _ in phrases]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts + spoken for w in t))}
        ids = [[self.vocabulary[w] for w in t] for t in texts + spoken]
        self.sizes = [len(t) for t in texts]
        self.automaton = a = SuffixAutomaton(ids)
        self.shortest, self.gap, self.share = shortest, gap, share
        own = defaultdict(list)
        for p, sequence in enumerate(ids[len(texts) :]):
            state = 0
            for symbol in sequence:
                state = a.next[state][symbol]
            own[state].append((p, len(sequence)))
        # phrases that end a match: those of the state and of all that it links to
        self.ending: list[list[tuple[int, int]]] = [[] for _ in a.length]
        for state in sorted(range(1, len(a.length)), key=a.length.__getitem__):
            self.ending[state] = own[state] + self.ending[a.link[state]]

    def __call__(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, first word, words)."""
        found = licence_words(text)
        ids = np.fromiter(map(self.vocabulary.get, found, repeat(-1)), np.int64, len(found))
        places, phrases, matches = [], set(), []
        inside = np.flatnonzero(ids >= 0)
        if len(inside):
            breaks = np.flatnonzero(np.diff(inside) > 1) + 1
            for run in np.split(inside, breaks):
                self.walk(ids[run].tolist(), int(run[0]), places, phrases, matches)
        spans, best = self.chain(matches)
        base = {self.phrase_labels[p] for p in phrases}
        labels = base | {s[0] for s in spans}
        return (len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best, spans)

    def walk(self, run: list[int], start: int, places: list, phrases: set, matches: list) -> None:
        """Matching statistics over a run of known words: at each word the longest match that ends there."""
        a, state, length = self.automaton, 0, 0
        for i, symbol in enumerate(run):
            if symbol not in a.next[state] and length >= self.shortest:
                matches.append((start + i - length, length, state))
            while symbol not in a.next[state]:
                state = a.link[state]
                length = a.length[state]
            state, length = a.next[state][symbol], length + 1
            for p, k in self.ending[state]:
                if k <= length:
                    places.append(start + i - k + 1)
                    phrases.add(p)
        if length >= self.shortest:
            matches.append((start + len(run) - length, length, state))

    def chain(self, matches: list) -> tuple[list[tuple[str, int, int]], float]:
        """Long matches of a template, in order in both text and template and at most ``gap`` words apart, as spans."""
        by_template = defaultdict(list)
        for at, length, state in matches:
            ends: dict[int, int] = {}
            for template, end in self.automaton.places[state]:
                if template < len(self.labels):
                    by_template[template].append((at, length, end - length + 1))
        spans, best = [], 0.0
        for template, found in by_template.items():
            open_chains: list[list] = []  # first word, end in the text, end in the template, words covered
            for at, length, place in sorted(set(found)):
                fit = None
                for c in open_chains:
                    if at + self.gap >= c[1] and at <= c[1] + self.gap and place >= c[2] - length and at + length > c[1] and place + length > c[2] and (fit is None or c[3] > fit[3]):
                        fit = c
                overlap = max(0, fit[2] - place, fit[1] - at) if fit else 0
                if fit and overlap < length:
                    fit[1], fit[2], fit[3] = at + length, place + length, fit[3] + length - overlap
                else:
                    fit = [at, at + length, place + length, length]
                    open_chains.append(fit)
                best = max(best, min(1.0, fit[3] / self.sizes[template]))  # before expired chains are dropped
                open_chains = [c for c in open_chains if c[1] + self.gap >= at] + [c for c in open_chains if c[1] + self.gap < at and c[3] >= self.share * self.sizes[template]]
            for first, end, _, covered in open_chains:
                if min(1.0, covered / self.sizes[template]) >= self.share:
                    spans.append((self.labels[template], first, end - first))
        return sorted(spans, key=lambda s: s[1:]), best


FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,words:long>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, shortest: int = 6, gap: int = 8, share: float = 0.6) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for each whole text.

    Texts stream through the automaton of all templates and phrases (some thousand words, so it is sent to every
    task). n_base counts the places of phrases, first_word and last_word are their least and greatest starts. Matches
    of ``shortest`` words or more are chained into spans; a template of which a chain covers ``share`` adds its label.
    score is the largest share of a template that a chain covers. Null and empty texts have no words and labels "". Very long
    texts are scanned whole; an empty table gives no rows.
    Each row is scanned for itself, so repeated rows, null ids and other columns don't matter.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, shortest, gap, share)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())]))]
        for part in slices(batches):
            rows = [scanner(t) for t in part.column(1).to_pylist()]
            columns = [[r[i] for r in rows] for i in range(8)]
            columns[7] = [[{"label": x, "first_word": y, "words": z} for x, y, z in spans] for spans in columns[7]]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", *(f.split()[0] for f in FOUND.split(", "))])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(scanned, f"doc_id long, {FOUND}")
