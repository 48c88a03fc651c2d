"""License scans with a generalised suffix automaton of license phrases and texts.

The automaton holds all templates at once, over word numbers. A file is streamed through it word by word: the state after
each word gives the longest run of words ending there that occurs in some template, and where. Long runs are chained
into spans of one template, and a template is named if its chained spans cover enough of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import bound_batches

#: Phrases that always count, with their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Public license texts, and passages and notices of them that stand alone, by label.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
)

#: Words a run needs before it is chained, and the share of a template that spans must cover.
LEAST_RUN = 3
COVER = 0.8
#: Words that may be skipped between two runs of a chain, in the file.
GAP = 8
_SPACED = bytes(32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z and non-ASCII bytes, A-Z folded."""
    return (text or "").encode("utf-8", "replace").translate(_SPACED).split()


class SuffixAutomaton:
    """Suffix automaton of several word sequences, each ended by a number of its own that no text has."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[int], template: int) -> None:
        last = 0
        for word in [*words, -2 - template]:
            last = self._extend(last, word)

    def _split(self, at: int, word: int, old: int) -> int:
        """A copy of ``old`` for its strings no longer than that of ``at`` with ``word``."""
        copy = len(self.next)
        self.next.append(dict(self.next[old]))
        self.link.append(self.link[old])
        self.length.append(self.length[at] + 1)
        self.link[old] = copy
        while at >= 0 and self.next[at].get(word) == old:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # another template has this run
            old = self.next[last][word]
            return old if self.length[old] == self.length[last] + 1 else self._split(last, word, old)
        state = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            old = self.next[at][word]
            self.link[state] = old if self.length[old] == self.length[at] + 1 else self._split(at, word, old)
        return state

    def ends(self, texts: list[list[int]]) -> list[list[tuple[int, int]]]:
        """For each state all ``(text, place of its last word)`` of the texts at which its strings end."""
        out: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for t, words in enumerate(texts):
            state = 0
            for place, word in enumerate(words):
                state = self.next[state][word]
                out[state].append((t, place))
        for state in sorted(range(1, len(out)), key=lambda x: -self.length[x]):
            out[self.link[state]] += out[state]
        out[0] = []
        return out

    def stream(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state and the length of the longest run ending there that a template has."""
        state = size = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                size += 1
            yield state, size


@dataclass
class Scanner:
    """Templates, their automaton, and for each state the base phrases and templates that it stands for."""

    base: tuple[tuple[str, str], ...] = BASE
    templates: tuple[tuple[str, str], ...] = TEMPLATES

    def __post_init__(self) -> None:
        self.vocab: dict[bytes, int] = {}
        number = lambda text: [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]
        self.phrases = [(number(text), label) for text, label in self.base]
        self.texts = [(number(text), label) for label, text in self.templates]
        self.machine = SuffixAutomaton()
        for i, (words, _) in enumerate([*self.phrases, *self.texts]):
            self.machine.add(words, i)
        self.phrase_ends: list[list[int]] = []  # by state: base phrases that are suffixes of all its strings long enough
        of_state: dict[int, list[int]] = {}
        for i, (words, _) in enumerate(self.phrases):
            state = 0
            for word in words:
                state = self.machine.next[state][word]
            of_state.setdefault(state, []).append(i)
        for state in range(len(self.machine.next)):
            found, at = [], state
            while at > 0:
                found += of_state.get(at, [])
                at = self.machine.link[at]
            self.phrase_ends.append(found)
        self.ends = self.machine.ends([words for words, _ in self.texts])

    def matches(self, part: list[int], states: list[int], sizes: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """All runs ``(template, start in the part, start in the template, words)`` of at least LEAST_RUN that neither side prolongs.

        The state after a word stands for its longest suffix in any template, and its suffix links for the shorter ones: each
        place is met first with the longest suffix that ends there.
        """
        link, length = self.machine.link, self.machine.length
        for i, (state, size) in enumerate(zip(states, sizes, strict=True)):
            seen: set[tuple[int, int]] = set()
            while size >= LEAST_RUN:
                for t, place in self.ends[state]:
                    if (t, place) in seen:
                        continue
                    seen.add((t, place))
                    template = self.texts[t][0]
                    if i + 1 < len(part) and place + 1 < len(template) and template[place + 1] == part[i + 1]:
                        continue
                    yield t, i - size + 1, place - size + 1, size
                state = link[state]
                size = length[state]

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        get = self.vocab.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        out = {"n_words": len(words), "n_base": 0, "first": None, "last": None, "base": set(), "labels": set(), "score": 0.0, "spans": []}
        known = np.flatnonzero(codes >= 0)
        if not len(known):
            return out
        cuts = np.flatnonzero(np.diff(known) > 1) + 1
        runs: list[tuple[int, int, int]] = []  # (template, start in the file, start in the template, words)
        lows, highs = known[np.concatenate(([0], cuts))], known[np.concatenate((cuts - 1, [len(known) - 1]))] + 1
        for low, high in zip(lows.tolist(), highs.tolist(), strict=True):
            if high - low < 2:
                continue
            part = codes[low:high].tolist()
            states, sizes = [], []
            for i, (state, size) in enumerate(self.machine.stream(part)):
                states.append(state)
                sizes.append(size)
                for p in self.phrase_ends[state]:
                    phrase, label = self.phrases[p]
                    if size >= len(phrase):
                        at = low + i - len(phrase) + 1
                        out["n_base"] += 1
                        out["first"] = at if out["first"] is None else min(out["first"], at)
                        out["last"] = at if out["last"] is None else max(out["last"], at)
                        out["base"].add(label)
            if max(sizes) >= LEAST_RUN:
                runs += [(t, low + a, j, n) for t, a, j, n in self.matches(part, states, sizes)]
        for t, spans in chained(runs).items():
            template, label = self.texts[t]
            out["score"] = max(out["score"], max(c for _, _, c in spans) / len(template))
            for a, b, c in spans:
                if c >= COVER * len(template):
                    out["labels"].add(label)
                    out["spans"].append((label, a, b, c / len(template)))
        if out["base"]:
            out["score"] = 1.0
        return out


def chained(runs: list[tuple[int, int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
    """By template: spans ``(first word, end, template words covered)`` of the best chains of runs.

    A chain goes up in the file and in the template, with at most GAP words of the file between runs; of a run that overlaps
    the one before on either side only the rest counts. For each run the chain of most words that ends with it is kept, over
    all runs near enough to come before, so a stray run never breaks a chain. Chains that overlap a better one in the file are
    left out.
    """
    by_template: dict[int, list[tuple[int, int, int]]] = {}
    for t, start, j, size in sorted(set(runs), key=lambda r: (r[1], r[2], r[3])):
        by_template.setdefault(t, []).append((start, j, size))
    spans: dict[int, list[tuple[int, int, int]]] = {}
    for t, own in by_template.items():
        longest = max(size for _, _, size in own)
        covers, firsts, low = [], [], 0
        for i, (start, j, size) in enumerate(own):
            cover, first = size, start
            while own[low][0] + longest + GAP < start:
                low += 1
            for k in range(low, i):
                a, b, n = own[k]
                rest = size - max(0, a + n - start, b + n - j)
                if a < start and start - (a + n) <= GAP and 0 < rest <= size and b < j and covers[k] + rest > cover:
                    cover, first = covers[k] + rest, firsts[k]
            covers.append(cover)
            firsts.append(first)
        taken: list[tuple[int, int, int]] = []
        free = None
        for i in sorted(range(len(own)), key=lambda i: (-covers[i], firsts[i])):
            a, b = firsts[i], own[i][0] + own[i][2]
            if free is None:
                free = np.ones(max(s + n for s, _, n in own) - own[0][0], bool)
            if free[a - own[0][0] : b - own[0][0]].all():
                free[a - own[0][0] : b - own[0][0]] = False
                taken.append((a, b, covers[i]))
        spans[t] = sorted(taken)
    return spans


_SCANNER: list[Scanner] = []


_SPAN = T.StructType().add("label", T.StringType()).add("first", T.LongType()).add("end", T.LongType()).add("cover", T.DoubleType())
_FOUND = (
    T.StructType().add("n_words", T.LongType()).add("n_base", T.LongType()).add("first_word", T.LongType()).add("last_word", T.LongType())
    .add("base_labels", T.StringType()).add("labels", T.StringType()).add("score", T.DoubleType()).add("spans", T.ArrayType(_SPAN))
)


@F.pandas_udf(_FOUND)
def _scan(texts: pd.Series) -> pd.DataFrame:
    """Scans of whole texts, each on its own; null and empty texts have no words, empty labels and score 0."""
    if not _SCANNER:
        _SCANNER.append(Scanner())
    rows = []
    for text in texts:
        s = _SCANNER[0].scan(text)
        rows.append((s["n_words"], s["n_base"], s["first"], s["last"], ",".join(sorted(s["base"])), ",".join(sorted(s["base"] | s["labels"])), s["score"], [{"label": a, "first": b, "end": c, "cover": d} for a, b, c, d in s["spans"]]))
    out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
    return out.astype({"first_word": "Int64", "last_word": "Int64"})


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` as struct ``d`` and their scan as struct ``s``.

    Whole texts are scanned, each row on its own, without a shuffle. ``n_base`` counts every place of a base phrase,
    ``first_word`` and ``last_word`` are the smallest and largest start (null without one), ``spans`` are the covered template
    spans in words, ``score`` is 1 with a base phrase and else the largest share of a template covered. Null and empty
    texts have no words and empty labels. Repeated rows get equal scans, rows with a null id and columns of any name pass through, and an
    empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    return docs.select(F.struct("*").alias("d"), _scan(F.col(text)).alias("s"))
