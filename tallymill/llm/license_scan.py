"""License scans with a generalised suffix automaton over the words of licence templates.

Files are streamed through the automaton word by word. The state and the match length are the matching statistics: the
longest piece of any template that ends at this word. Phrases are templates too, so a phrase occurs where its state is on
the suffix path of the current state. Matches of `LEAST_MATCH` words or more are anchors; anchors of one template that
follow each other in file and template are chained, each to the chain before it that covers most of the template, and a
chain that covers enough of its template is a found licence. Templates are single sentences, as files state their licence,
and whole licences, so that a span may be a page.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import FOLD, Texts, struct_of, text_or_empty, tuned

# The phrases of the contract and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Sentences of public licences, with a label each.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]
# Whole licences, from their first line to the last, as published.
TEMPLATES += [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
]
# Names of the longer licences' files, as systems keep them, with a label each.
LICENSE_FILES = {
    "Apache-2.0": "apache", "Artistic": "artistic", "CC0-1.0": "cc0", "GFDL-1.3": "gfdl", "GPL-2": "gpl", "GPL-3": "gpl", "LGPL-2.1": "lgpl",
    "LGPL-3": "lgpl", "MPL-1.1": "mpl", "MPL-2.0": "mpl",
}
#: The driver's folder of those files; it reads the ones that are there.
LICENSE_FOLDER = "/usr/share/common-licenses"
#: Shortest match that anchors a chain, words between anchors of a chain, and the share of a template that counts as found.
LEAST_MATCH, MOST_GAP, LEAST_COVER = 4, 20, 0.8

_FOUND = "struct<n_words:bigint,phrases:array<struct<start:bigint,phrase:string>>,spans:array<struct<label:string,first:bigint,last:bigint,cover:double>>>"


def templates_of(folder: str | None = LICENSE_FOLDER) -> list[tuple[str, str]]:
    """TEMPLATES and the whole licences in the folder."""
    found = list(TEMPLATES)
    for name, label in LICENSE_FILES.items():
        path = os.path.join(folder or "", name)
        if folder and os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as file:
                found.append((label, file.read()))
    return found


class SuffixAutomaton:
    """Every piece of every added sequence leads to one state; a state knows one place where its longest piece ends."""

    def __init__(self):
        self.next, self.link, self.length, self.ends = [{}], [-1], [0], [[]]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        twin = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = twin
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = twin
            state = self.link[state]
        return twin

    def add(self, sequence: list[int], owner: int) -> None:
        last = 0
        for k, word in enumerate(sequence):
            target = self.next[last].get(word)
            if target is not None:
                last = target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
            else:
                new, state = self._state(self.length[last] + 1, {}, 0), last
                while state >= 0 and word not in self.next[state]:
                    self.next[state][word] = new
                    state = self.link[state]
                if state >= 0:
                    target = self.next[state][word]
                    fits = self.length[target] == self.length[state] + 1
                    self.link[new] = target if fits else self._split(state, word, target)
                last = new
            self.ends[last].append((owner, k))

    def spread(self, least: int = 1) -> None:
        """A state's places are those of all states below it on the suffix paths, too; asked for matches of `least` words."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0 and self.length[self.link[state]] >= least:
                self.ends[self.link[state]] = sorted({*self.ends[self.link[state]], *self.ends[state]})


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, least_match=LEAST_MATCH, most_gap=MOST_GAP, least_cover=LEAST_COVER):
        self.least_match, self.most_gap, self.least_cover = least_match, most_gap, least_cover
        sequences = [(label, text.encode().translate(FOLD).split()) for label, text in templates]
        phrase_words = [(phrase, phrase.encode().translate(FOLD).split()) for phrase in phrases]
        self.ids = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for _, s in [*sequences, *phrase_words] for w in s))}
        self.labels = [label for label, _ in sequences]
        self.sizes = [len(s) for _, s in sequences]
        self.automaton = SuffixAutomaton()
        for k, (_, words) in enumerate(sequences):
            self.automaton.add([self.ids[w] for w in words], k)
        for _, words in phrase_words:
            self.automaton.add([self.ids[w] for w in words], -1)
        self.automaton.spread(least_match)
        at_state: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for phrase, words in phrase_words:
            state = 0
            for w in words:
                state = self.automaton.next[state][self.ids[w]]
            at_state[state].append((phrase, len(words)))
        # What ends at a state: its own phrases, if the match is long enough, and those of its suffix path.
        self.phrases: list[list[tuple[str, int]]] = []
        for state in range(len(self.automaton.next)):
            on_path, at = [], state
            while at > 0:
                on_path += at_state.get(at, [])
                at = self.automaton.link[at]
            self.phrases.append(on_path)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        words = text.translate(FOLD).split()
        ids = np.fromiter((self.ids.get(w, 0) for w in words), np.int32, len(words))
        known = np.flatnonzero(ids)
        if not len(known):
            return len(words), [], []
        moves, link, length, ends = self.automaton.next, self.automaton.link, self.automaton.length, self.automaton.ends
        phrases, anchors = [], defaultdict(list)
        # A run of words that templates have is streamed; any other word ends every match. Single words match nothing.
        edges = np.flatnonzero(np.diff(known) > 1)
        for a, b in zip(known[np.concatenate(([0], edges + 1))].tolist(), known[np.concatenate((edges, [len(known) - 1]))].tolist()):
            if a == b and self.least_match > 1 and not self.phrases[moves[0][int(ids[a])]]:
                continue
            state, size = 0, 0
            for at, word in enumerate(ids[a:b + 1].tolist(), a):
                before, held = state, size
                while state and word not in moves[state]:
                    state = link[state]
                    size = length[state]
                state, size = (moves[state][word], size + 1) if word in moves[state] else (0, 0)
                if held >= self.least_match and size <= held:
                    self._anchor(anchors, ends[before], at - 1, held)
                phrases += [(at - n + 1, p) for p, n in self.phrases[state] if n <= size]
            if size >= self.least_match:
                self._anchor(anchors, ends[state], b, size)
        return len(words), sorted(phrases), self._spans(anchors)

    def _anchor(self, anchors, places, last: int, size: int) -> None:
        for owner, end in places:
            if owner >= 0:
                anchors[owner].append((last - size + 1, last, end - size + 1, end))

    def _spans(self, anchors) -> list[tuple[str, int, int, float]]:
        spans = []
        for owner, found in anchors.items():
            taken: list[tuple[int, int]] = []
            for covered, first, last in chains(found, self.most_gap):
                share = covered / self.sizes[owner]
                if share < self.least_cover:
                    break
                if all(last < a or first > b for a, b in taken):
                    taken.append((first, last))
                    spans.append((self.labels[owner], first, last, min(share, 1.0)))
        return sorted(set(spans), key=lambda s: (s[1], s[2], s[0]))


def chains(anchors: list[tuple[int, int, int, int]], most_gap: int) -> list[tuple[int, int, int]]:
    """(words covered, first, last) of the best chain that ends at each anchor, best first.

    Anchors are places in the file and in the template (first, last each). In a chain both go on from anchor to anchor, by
    `most_gap` words of the file at most; it covers the template's words that one of them has. What each anchor adds to the
    best chain before it is looked up among those that end within reach.
    """
    found = sorted(set(anchors), key=lambda x: (x[1], x[3]))
    ends = [x[1] for x in found]
    best: list[tuple[int, int]] = []
    for first, last, t_first, t_last in found:
        most, start = t_last - t_first + 1, first
        for k in range(bisect_left(ends, first - most_gap), bisect_left(ends, last)):
            before = found[k]
            if before[3] < t_last and before[0] <= first:
                covered = best[k][0] + t_last - max(t_first, before[3] + 1) + 1
                if covered > most:
                    most, start = covered, best[k][1]
        best.append((most, start))
    return sorted(((n, start, x[1]) for (n, start), x in zip(best, found)), key=lambda c: (-c[0], c[1], c[2]))


@lru_cache(maxsize=2)
def _scanner(options: tuple) -> Scanner:
    """One per worker, for all batches that it is given."""
    return Scanner(**dict(options))


def licenses(text: Column, **options) -> Column:
    """n_words, phrases (start, phrase) and spans (label, first and last word, share of the template) of each text."""

    options.setdefault("templates", templates_of())
    fixed = tuple(sorted((k, tuple(v.items()) if isinstance(v, dict) else tuple(v) if isinstance(v, list) else v) for k, v in options.items()))

    @F.arrow_udf(_FOUND)
    def scan(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = _scanner(fixed)
        phrase = pa.struct([("start", pa.int64()), ("phrase", pa.string())])
        span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())])
        for column in columns:
            texts, counts, phrases, spans = Texts(column), [], [], []
            for i in range(len(texts)):
                n, starts, chains = scanner.scan(texts[i])
                counts.append(n)
                phrases.append([{"start": s, "phrase": p} for s, p in starts])
                spans.append([{"label": x, "first": a, "last": b, "cover": c} for x, a, b, c in chains])
            yield struct_of({"n_words": pa.array(counts, pa.int64()), "phrases": pa.array(phrases, pa.list_(phrase)), "spans": pa.array(spans, pa.list_(span))})

    return scan(text)


def scan_licenses(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row per row of df: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    score is the largest share of a template that a chain covers, and at least 0.5 where a phrase stands alone. Null texts
    have no words: counts 0, places null, labels empty, score 0. Repeated rows and null ids keep their rows; further
    columns are ignored; an empty table gives an empty one.
    """
    tuned(df.sparkSession)
    rows = df.select(F.col(f"`{id_column}`").alias("_id"), licenses(text_or_empty(text_column), **options).alias("f"))
    phrases, spans = F.col("f.phrases"), F.col("f.spans")
    label_of = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    base = F.array_distinct(F.transform(phrases["phrase"], lambda p: label_of[p]))
    best = F.coalesce(F.array_max(spans["cover"]), F.lit(0.0))
    return rows.select(
        F.col("_id").alias(id_column), F.col("f.n_words").alias("n_words"), F.size(phrases).cast("long").alias("n_base"),
        F.array_min(phrases["start"]).alias("first_word"), F.array_max(phrases["start"]).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, spans["label"])), ",").alias("labels"),
        F.greatest(best, F.when(F.size(phrases) > 0, 0.5).otherwise(0.0)).alias("score"), spans.alias("spans"),
    )
