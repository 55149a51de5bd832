"""Licence scans: matching statistics of texts against a generalised suffix automaton of licence templates.

The automaton holds every substring of every template, as words. Streaming a text through it gives at each word the
longest substring of any template that ends there. Matches that can't be extended and are long enough are put on each
template they occur in, and matches that follow each other in both text and template, with small gaps, are chained to
spans, so that as much as possible of the template is covered. A span names its template's licence if it covers enough of
it, has the words without which the licence would be another, and has none of a sister's; of spans that overlap the one that
explains most words counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.shared import bounded_batches, hold, texts_of

#: Words of a text whose A-Z are lower-cased: digits, small letters and whatever isn't ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Phrases of which every place counts, and their labels (fixed values).
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Words that tell licences of a family apart: a template without such a word doesn't explain a text that has it (fixed values).
MARKS = frozenset("lesser library affero sharealike noncommercial noderivatives noderivs sa nc nd".split())

#: Licence notices and terms (fixed values, public licence texts): label, words that must be found, text. Whole texts of long licences lie in licence_texts/.
NOTICES = (
    ("mit", "mit", "Released under the MIT License."),
    ("mit", "mit", "Licensed under the MIT License."),
    ("mit", "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd-2-clause", "", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-3-clause", "neither endorse", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("apache-2.0", "apache", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mpl-2.0", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org"),
    ("cc0-1.0", "public domain", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide. This work is distributed without any warranty."),
)

#: GNU licences by label: name, short name, version (fixed values).
GNU = {"gpl-2.0": ("", "GPL", "2"), "gpl-3.0": ("", "GPL", "3"), "lgpl-2.1": ("Lesser ", "LGPL", "2.1"), "lgpl-3.0": ("Lesser ", "LGPL", "3"), "agpl-3.0": ("Affero ", "AGPL", "3")}
#: Creative Commons licences: what their name adds to Attribution, by what their label adds to cc-by, and their versions (fixed values).
COMMONS = {"": "", "-sa": "-ShareAlike", "-nc": "-NonCommercial", "-nd": "-NoDerivatives", "-nc-sa": "-NonCommercial-ShareAlike", "-nc-nd": "-NonCommercial-NoDerivatives"}
COMMONS_VERSIONS = {"3.0": "Unported", "4.0": "International"}
WHOLE = ("apache-2.0", "mpl-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "cc0-1.0")


def _templates() -> tuple[tuple[str, str, str], ...]:
    """(label, words that must be found, text) of all notices, and of the whole texts."""
    out = list(NOTICES)
    out += [(label, needs, text[: text.index("THE SOFTWARE IS")]) for label, needs, text in NOTICES if label in ("mit", "isc") and "THE SOFTWARE IS" in text]  # often quoted without the warranty
    for label, (kind, short, version) in GNU.items():
        name, kind_word, number = f"GNU {kind}General Public License", kind.strip().lower(), version.replace(".", " ")
        out += [(label, f"general {kind_word} {number}", f"This work is licensed under the {name}, version {version}."), (label, f"general {kind_word} {number}", f"Licensed under the {name} v{version}".replace(" v", " version "))]
        out.append((label, f"{short.lower()} v{number}", f"Licensed under the GNU {short} v{version}."))
        program, mark = ("library", ";") if version == "2.1" else ("program", ";" if version == "2" else ":")
        out.append((label, f"general {kind_word} {number}", f"This {program} is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."))
        out.append((label, f"general {kind_word} {number}", f"you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."))
    for version, where in COMMONS_VERSIONS.items():
        for short, name in COMMONS.items():
            label, number = f"cc-by{short}-{version}", version.replace(".", " ")
            out.append((label, f"cc by {short.replace('-', ' ')} {number}", f"Licensed under CC BY{short.upper()} {version}."))
            out.append((label, f"commons attribution {name.replace('-', ' ').lower()} {number}", f"This work is licensed under a Creative Commons Attribution{name} {version} {where} License."))
    for label in WHOLE:
        out.append((label, "", (Path(__file__).parent / "licence_texts" / f"{label}.txt").read_text(encoding="utf-8")))
    return tuple(out)


TEMPLATES = _templates()


@dataclass(frozen=True)
class Scan:
    """least: words of a match that counts. gap: words between chained matches, in text and template. cover: part of a template that names its licence."""

    least: int = 3
    gap: int = 4
    cover: float = 0.6


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # of bytes lower() changes A-Z alone


class Automaton:
    """Generalised suffix automaton of sequences of positive ints; ends[s] lists (sequence, end) of all places of state s."""

    def __init__(self, sequences: list[list[int]], least: int = 1):
        self.length, self.link = [0], [-1]
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for end, symbol in enumerate(sequence, 1):
                last = self._extend(last, symbol)
                self.ends[last].add((number, end))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for state in reversed(order):
            self.ends[self.link[state]] |= self.ends[state]
        #: Of each state every place at which a suffix of it of the least length ends, and the longest such suffix.
        self.places: list[dict[tuple[int, int], int]] = [{}] * len(self.length)
        for state in order:
            if self.length[state] >= least:
                self.places[state] = self.places[self.link[state]] | dict.fromkeys(self.ends[state], self.length[state])

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """The target of state's move, cloned if it also stands for longer strings than state's and one."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state != -1 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        known = self.next[last].get(symbol)
        if known is not None:  # an earlier sequence has it
            return self._split(last, symbol, known)
        new, state = self._state(self.length[last] + 1, 0, {}), last
        while state != -1 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state != -1:
            self.link[new] = self._split(state, symbol, self.next[state][symbol])
        return new

    def statistics(self, symbols: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest known string that ends at each symbol."""
        state = length = 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            yield state, length


class Scanner:
    """The templates' automaton and vocabulary, and what it finds in a text."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, scan: Scan = Scan(), marks=MARKS):
        self.scan = scan
        own = [words_of(text.encode()) for *_, text in templates]
        self.labels, self.sizes = [label for label, *_ in templates], [len(x) for x in own]
        self.phrases = [(words_of(p.encode()), label) for p, label in phrases]
        marks = {w.encode() for w in marks}
        everything = sorted({w for x in own for w in x} | {w for p, _ in self.phrases for w in p} | marks)
        self.symbol = {w: k for k, w in enumerate(everything, 1)}
        self.automaton = Automaton([[self.symbol[w] for w in x] for x in own], scan.least)
        self.base = [([self.symbol[w] for w in p], label) for p, label in self.phrases]
        #: Of each template the places of each word that must be found, and the marks that it doesn't have.
        self.needs = [[(place, 1 << bit) for bit, word in enumerate(words_of(needs.encode())) for place, w in enumerate(x) if w == word] for (_, needs, _), x in zip(templates, own, strict=True)]
        self.all = [(1 << len(words_of(needs.encode()))) - 1 for _, needs, _ in templates]
        self.foreign = [np.array(sorted(self.symbol[w] for w in marks - set(x)), np.int32) for x in own]

    def found(self, template: int, begin: int, end: int) -> int:
        """Which words that must be found lie in a part of the template."""
        out = 0
        for place, bit in self.needs[template]:
            if begin <= place < end:
                out |= bit
        return out

    def matches(self, symbols: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(end, template, end in the template, length) of matches of at least the least length that can't be extended there; runs of unknown words are skipped."""
        known = np.flatnonzero(symbols)
        if len(known) < self.scan.least:
            return
        cuts = np.flatnonzero(np.diff(known) > 1) + 1
        starts, ends = known[np.concatenate([[0], cuts])], known[np.concatenate([cuts - 1, [len(known) - 1]])] + 1
        long = ends - starts >= self.scan.least
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            places, most = {}, 0
            for k, (state, length) in enumerate([*self.automaton.statistics(symbols[a:b].tolist()), (0, 0)]):
                after = self.automaton.places[state]
                if most >= self.scan.least:
                    for (template, at), own in places.items():
                        if min(own, most) >= self.scan.least and (template, at + 1) not in after:
                            yield a + k, template, at, min(own, most)
                places, most = after, length

    def chains(self, symbols: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(start, end, template, words covered, words found of those that must be) of the fullest chains of matches; a template's don't overlap.

        A chain goes on with a match that begins after its end by scan.gap words at most, in text and template, or overlaps it; of the ways to
        go on to a match the one that covers most counts.
        """
        gap = self.scan.gap
        open_: dict[int, list[list]] = {}  # template: [start, end, end in the template, covered, found, is a chain's end]
        every: dict[int, list[list]] = {}
        for end, template, at, length in sorted(self.matches(symbols), key=lambda m: (m[0] - m[3], m)):  # by where they begin
            begin, first = end - length, at - length
            waiting = [c for c in open_.get(template, ()) if begin - c[1] <= gap]
            own, before = [begin, end, at, length, self.found(template, first, at), True], None
            for chain in waiting:
                start, upto, reached, covered, found, _ = chain
                fresh = min(length, at - reached, end - upto)  # words that neither end has seen
                if fresh > 0 and first - reached <= gap and covered + fresh > own[3]:
                    own, before = [start, end, at, covered + fresh, found | self.found(template, at - fresh, at), True], chain
            if before:
                before[5] = False
            open_[template] = [*waiting, own]
            every.setdefault(template, []).append(own)
        out = []
        for template, own in every.items():
            taken: list[tuple[int, int]] = []
            for start, end, _, covered, found, _ in sorted((c for c in own if c[5]), key=lambda c: (-c[3], c[0], c[1])):
                if all(end <= a or start >= b for a, b in taken):
                    taken.append((start, end))
                    out.append((start, end, template, covered, found))
        return out

    def spans(self, symbols: np.ndarray) -> tuple[list[tuple[int, int, int, float]], float]:
        """(start, end, template, part of the template that is covered) of the chains that name a licence, which don't overlap, and the largest part that any chain covers."""
        part = lambda c: min(1.0, c[3] / self.sizes[c[2]])
        chains = self.chains(symbols)
        named = [c for c in chains if part(c) >= self.scan.cover and c[4] == self.all[c[2]] and not np.isin(symbols[c[0] : c[1]], self.foreign[c[2]]).any()]
        out: list[tuple[int, int, int, float]] = []
        for c in sorted(named, key=lambda c: (-c[3], -part(c), c)):
            if all(c[1] <= a or c[0] >= b for a, b, *_ in out):
                out.append((*c[:3], part(c)))
        return sorted(out), max(map(part, chains), default=0.0)

    def scan_text(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
        words = words_of(text)
        symbols = np.fromiter(map(self.symbol.get, words, repeat(0)), np.int32, len(words))
        places, base = [], set()
        for phrase, label in self.base:
            n = len(symbols) - len(phrase) + 1
            if n > 0:
                hit = symbols[:n] == phrase[0]
                if hit.any():
                    for j, x in enumerate(phrase[1:], 1):
                        hit &= symbols[j : j + n] == x
                    at = np.flatnonzero(hit)
                    if len(at):
                        places.append(at)
                        base.add(label)
        spans, score = self.spans(symbols)
        labels = base | {self.labels[t] for _, _, t, _ in spans}
        flat = np.concatenate(places) if places else np.zeros(0, np.int64)
        first, last = (int(flat.min()), int(flat.max())) if len(flat) else (None, None)
        return len(words), len(flat), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 6), spans


def scan_licences(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, scan: Scan = Scan(), id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score[, spans]): one row per row of docs.

    n_base counts all places of the phrases; first_word and last_word are their smallest and largest start, null if there is
    none. labels adds those of the spans that name a licence; score is the largest covered part of any template, whether or not it names one.
    Labels are distinct, sorted and comma-joined, empty if there is none. A null text counts as empty (no words, score 0); a
    null doc_id stays null, repeated rows are scanned each, other columns are left alone, an empty table gives an empty one. A very long text
    is scanned whole; its words are held at once. with_spans adds (first_word, end_word, label, part) of each span. Nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64()]
    span = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("part", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = hold(("licences", templates, phrases, scan), lambda: Scanner(templates, phrases, scan))
        for batch in batches:
            found = [scanner.scan_text(text) for text in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = [batch.column(0), *(pa.array([x[i] for x in found], kinds[i + 1]) for i in range(7))]
            if with_spans:
                columns.append(pa.array([[{"first_word": a, "end_word": b, "label": scanner.labels[t], "part": p} for a, b, t, p in x[7]] for x in found], span))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *(["spans"] if with_spans else [])])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    schema += ", spans array<struct<first_word: long, end_word: long, label: string, part: double>>" if with_spans else ""
    return texts_of(docs, id_col, text_col).mapInArrow(run, schema)
