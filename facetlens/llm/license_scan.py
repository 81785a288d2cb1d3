"""License scans: licence texts with template markup, compiled to token automata.

A template is a wording with markup: ``<<beginOptional>> ... <<endOptional>>`` may be absent (and be
nested), ``<<var;words="2-30">>`` stands for so many words of any kind, ``<<var;match="a b|c">>`` for one
of the listed wordings. Everything else is mandatory. ``compile_template`` builds the automaton of such a
wording over words; its states are followed as sets that are made on first use. A text has the label of
each template whose automaton accepts a stretch of its words, so all mandatory words must stand there, in
order and without others in between. Where several ends are possible from one start, the longest
counts; stretches of one template don't overlap.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Templates take spellings of
``VARIANTS`` as equal; the phrases of ``PHRASES`` are matched word by word as they are.

A task cuts texts into words array-wise, finds the places of phrases and the pairs of words that can begin
a template, and follows automata from those places only. No shuffle, nothing is sent but the templates.
A start is left as soon as no state remains; gaps are bounded, so it costs at most a template's length.

Null and empty texts and texts without words have no place and score 0. Repeated rows count each, a null
doc_id stays null, extra columns are not read, an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from facetlens.llm.common import _LOWER, binary_array, flat, ids_and_text, text_slices

#: Phrases of the base scan with their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Spellings that templates take as one (fixed values).
VARIANTS = {"licence": "license", "licenced": "licensed", "licences": "licenses", "sublicence": "sublicense", "organisation": "organization", "favour": "favor", "copyrights": "copyright"}

#: The end of the warranty clauses that several permissive licences share, with the holder replaceable.
_NO_LIABILITY = (
    'IN NO EVENT SHALL <<var;words="1-12">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, '
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "<<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "<<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY <<var;words="1-12">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. " + _NO_LIABILITY
)

#: Licence wordings with their labels (fixed values): whole short licences, notices, and one-line statements.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
        'PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;words="1-12">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, '
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")),
    ("mit", '<<var;match="Released|Licensed|Distributed|Available">> under <<beginOptional>>the terms of<<endOptional>> the <<beginOptional>>permissive<<endOptional>> MIT license'),
    ("isc", (
        'Permission to use, copy, modify, and <<var;match="distribute|or distribute">> this software for any purpose with or without fee is hereby granted, provided that the above copyright '
        'notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;words="1-8">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.")),
    ("bsd-2-clause", _BSD + _BSD_END),
    ("bsd-3-clause", _BSD + (
        '<<beginOptional>>3.<<endOptional>> Neither the name of <<var;words="1-12">> nor the names of its contributors may be used to endorse or promote products derived from this software without '
        "specific prior written permission. ") + _BSD_END),
    ("apache-2", (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        '<<var;words="3-10">> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.")),
    ("apache-2", '<<var;match="Released|Licensed|Distributed|Available">> under <<beginOptional>>the terms of<<endOptional>> the Apache <<beginOptional>>Software<<endOptional>> License <<beginOptional>>Version<<endOptional>> 2<<beginOptional>>.0<<endOptional>>'),
    ("gpl", 'licensed under <<beginOptional>>the terms of<<endOptional>> the <<beginOptional>>GNU<<endOptional>> General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<var;match="version|v">> <<var;match="2|3">>'),
    ("gpl", (
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version '
        '<<var;words="1-2">> of the License, or (at your option) any later version.')),
    ("lgpl", 'under the terms of the GNU <<var;match="Lesser|Library">> General Public License as published by the Free Software Foundation'),
    ("mpl-2", 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<var;words="2-8">> MPL 2.0'),
    ("cc-by-nc", 'licensed under <<beginOptional>>a<<endOptional>> <<var;match="CC BY NC|Creative Commons Attribution NonCommercial|Creative Commons Attribution Non Commercial">> <<beginOptional>>4.0<<endOptional>> <<beginOptional>>International License<<endOptional>>'),
    ("cc-by", 'licensed under a Creative Commons Attribution <<var;match="1.0|2.0|2.5|3.0|4.0">> <<beginOptional>>International<<endOptional>> <<beginOptional>>Unported<<endOptional>> License'),
    ("cc0", 'To the extent possible under law, <<var;words="1-20">> waived all copyright and related or neighboring rights to <<var;words="1-20">> work'),
    ("unlicense", (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.")),
    ("zlib", (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "<<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software.")),
]

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split_words(text: str) -> list[str]:
    lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    return [w.decode() for w in _WORD.findall(lowered)]


# ---- templates -----------------------------------------------------------------
_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")


def parse(markup: str) -> list:
    """The template as a nested list of ("word", w), ("optional", parts), ("any", least, most), ("one of", wordings)."""
    stack: list[list] = [[]]
    plain = lambda text: [("word", VARIANTS.get(w, w)) for w in split_words(text)]
    at = 0
    for mark in _MARK.finditer(markup):
        stack[-1] += plain(markup[at:mark.start()])
        at, kind = mark.end(), mark.group(1)
        if kind == "beginOptional":
            stack.append([])
        elif kind == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        else:
            said = dict(re.findall(r'(\w+)="([^"]*)"', kind))
            if "match" in said:
                stack[-1].append(("one of", [plain(x) for x in said["match"].split("|")]))
            else:
                least, most = (int(x) for x in said["words"].split("-"))
                if not 0 <= least <= most:
                    raise ValueError(f"words from {least} to {most}")
                stack[-1].append(("any", least, most))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0] + plain(markup[at:])


ANY = -1


class Automaton:
    """States with moves on words, on any word, and without a word; followed as sets of states."""

    def __init__(self, markup: str):
        self.moves: list[dict[str | int, set[int]]] = [{}]
        self.free: list[set[int]] = [set()]
        self.accepting = self._add(parse(markup), 0)
        self.sets: dict[frozenset[int], int] = {}
        self.members: list[frozenset[int]] = []
        self.steps: list[dict[str, int]] = []
        self.begin = self._known(self._closure({0}))
        if self.accepting in self.members[self.begin]:
            raise ValueError("a template must have mandatory words")

    def _state(self) -> int:
        self.moves.append({})
        self.free.append(set())
        return len(self.moves) - 1

    def _move(self, state: int, word: str | int) -> int:
        to = self._state()
        self.moves[state].setdefault(word, set()).add(to)
        return to

    def _add(self, parts: list, state: int) -> int:
        for part in parts:
            if part[0] == "word":
                state = self._move(state, part[1])
            elif part[0] == "optional":
                end = self._add(part[1], state)
                joined = self._state()
                self.free[end].add(joined)
                self.free[state].add(joined)
                state = joined
            elif part[0] == "one of":
                ends = [self._add(wording, state) for wording in part[1]]
                state = self._state()
                for end in ends:
                    self.free[end].add(state)
            else:
                for _ in range(part[1]):
                    state = self._move(state, ANY)
                ends = [state]
                for _ in range(part[2] - part[1]):
                    ends.append(self._move(ends[-1], ANY))
                state = self._state()
                for end in ends:
                    self.free[end].add(state)
        return state

    def _closure(self, states: set[int]) -> frozenset[int]:
        seen, left = set(states), list(states)
        while left:
            for to in self.free[left.pop()] - seen:
                seen.add(to)
                left.append(to)
        return frozenset(seen)

    def _known(self, states: frozenset[int]) -> int:
        if states not in self.sets:
            self.sets[states] = len(self.members)
            self.members.append(states)
            self.steps.append({})
        return self.sets[states]

    def step(self, at: int, word: str) -> int:
        """The set reached by ``word``; the empty set ends a run."""
        to = self.steps[at].get(word)
        if to is None:
            reached = set()
            for s in self.members[at]:
                reached |= self.moves[s].get(word, set()) | self.moves[s].get(ANY, set())
            to = self._known(self._closure(reached))
            if any(word in self.moves[s] for s in self.members[at]):
                self.steps[at][word] = to
        return to

    def first_pairs(self) -> set[tuple[str | int, str | int]]:
        """The pairs of words (or ANY) with which an accepted stretch begins; a lone word pairs with ANY."""
        pairs = set()
        for s in self.members[self.begin]:
            for word, reached in self.moves[s].items():
                after = self._closure(reached)
                pairs |= {(word, other) for t in after for other in self.moves[t]}
                if self.accepting in after:
                    pairs.add((word, ANY))
        return pairs

    def longest(self, words, start: int, end: int) -> int:
        """Where the longest accepted stretch from ``start`` ends, or ``start``."""
        at, found = self.begin, start
        for k in range(start, end):
            at = self.step(at, words(k))
            if not self.members[at]:
                break
            if self.accepting in self.members[at]:
                found = k + 1
        return found


class Scanner:
    """Phrases and templates, made ready once a task."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        self.phrases = [(split_words(p), label) for p, label in phrases.items()]
        self.labels = [label for label, _ in templates]
        self.automata = [Automaton(markup) for _, markup in templates]
        self.pairs = [a.first_pairs() for a in self.automata]
        for pairs in self.pairs:
            if any(ANY == a for a, _ in pairs):
                raise ValueError("a template must not begin with replaceable words")
        self.asked = {w for p, _ in self.phrases for w in p} | {w for pairs in self.pairs for pair in pairs for w in pair if w != ANY}

    def scan(self, texts: pa.Array) -> dict[str, list]:
        raw, byte_off = flat(texts)
        raw = _LOWER[raw]
        inside = ~_SEPARATOR[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[byte_off] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        off = np.searchsorted(start, byte_off)
        n = len(start)
        owner = np.repeat(np.arange(len(texts)), np.diff(off))
        found = binary_array(raw[inside], np.concatenate([[0], np.cumsum(end - start)])).dictionary_encode()
        codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        said = [v.decode("utf-8", "replace") for v in found.dictionary.to_pylist()]
        exact = {w: k for k, w in enumerate(said) if w in self.asked}

        base = [[] for _ in texts]  # (place, label)
        for phrase, label in self.phrases:
            if n >= len(phrase) and all(w in exact for w in phrase):
                hit = owner[: n - len(phrase) + 1] == owner[len(phrase) - 1:]
                for j, w in enumerate(phrase):
                    hit = hit & (codes[j: n - len(phrase) + 1 + j] == exact[w])
                for at in np.flatnonzero(hit):
                    base[owner[at]].append((int(at), label, int(at) + len(phrase)))

        spelled = [VARIANTS.get(w, w) for w in said]
        ids: dict[str, list[int]] = {}
        for k, w in enumerate(spelled):
            if w in self.asked:
                ids.setdefault(w, []).append(k)
        # One small number a distinct asked word; pairs that occur in no template are left out array-wise.
        small = np.zeros(len(said), np.int64)
        numbers = {w: i + 1 for i, w in enumerate(sorted(ids))}
        for w, known in ids.items():
            small[known] = numbers[w]
        here = small[codes]
        after = np.zeros(n, np.int64)
        if n:
            after[:-1] = np.where(owner[1:] == owner[:-1], here[1:], 0)
        places = np.flatnonzero(here)
        key = here[places] * (len(numbers) + 1) + after[places]
        spans = [[] for _ in texts]  # (start, label, end)
        word = lambda k: spelled[codes[k]]
        for label, automaton, pairs in zip(self.labels, self.automata, self.pairs):
            fixed = [numbers[a] * (len(numbers) + 1) + numbers[b] for a, b in pairs if a in numbers and b in numbers]
            loose = [numbers[a] for a, b in pairs if a in numbers and b == ANY]
            upto = 0
            for at in places[np.isin(key, fixed) | np.isin(here[places], loose)]:
                if at >= upto:
                    to = automaton.longest(word, int(at), int(off[owner[at] + 1]))
                    if to > at:
                        spans[owner[at]].append((int(at), label, to))
                        upto = to
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for k in range(len(texts)):
            own, count = sorted(base[k]), int(off[k + 1] - off[k])
            out["n_words"].append(count)
            out["n_base"].append(len(own))
            out["first_word"].append(own[0][0] - int(off[k]) if own else None)
            out["last_word"].append(own[-1][0] - int(off[k]) if own else None)
            out["base_labels"].append(",".join(sorted({label for _, label, _ in own})))
            out["labels"].append(",".join(sorted({label for _, label, _ in own + spans[k]})))
            covered, upto = 0, 0
            for a, _, b in sorted(own + spans[k]):
                covered += max(0, b - max(a, upto))
                upto = max(upto, b)
            out["score"].append(covered / count if count else 0.0)
            out["spans"].append([{"label": label, "start": a - int(off[k]), "end": b - int(off[k])} for a, label, b in sorted(spans[k])])
        return out


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_TYPES = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": _SPANS}


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every text.

    n_base counts all places of phrases; first_word and last_word are the smallest and largest start of
    them (null without any). labels joins those of phrases and of accepted templates. score is the share
    of the text's words that phrases and accepted stretches cover; spans are those stretches in words.
    """

    def run(batches):
        scanner = Scanner(phrases, templates)
        for batch in text_slices(batches):
            found = scanner.scan(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[k], t) for k, t in _TYPES.items()]], ["doc_id", *_TYPES])

    return ids_and_text(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long>>")
