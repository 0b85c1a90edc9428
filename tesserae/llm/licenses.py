"""Licence scan by a generalised suffix automaton.

The automaton recognises every substring of the licence templates, in words. Streaming a file's words through it yields matching
statistics: how long a match ends at each word. Where it is min_match words or more, the suffix links lead to the state of its last min_match words, and that state's
subtree to every place in a template where they stand; neighbouring ones on one diagonal make up the matches (file place, template place, length) of each template, as long as they go.
The best chain of each template is found by dynamic programming: matches that follow each other in the file and in the template, at most `gap` words apart in the file, and
count the template's words that they cover; where two overlap, the later one loses its head. A chain covers a span of the file and a share of the template, and gives a label if the share is large enough.
Only runs of words whose every neighbouring pair occurs in a template are streamed, since elsewhere no match exceeds one word.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import textvec
from tesserae.llm.common import trimmed

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Wording of common licences (grants, conditions, warranty paragraphs) and of their notices, and the labels that the scan adds.
TEMPLATES = (
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-text", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "licensed under the mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0-text", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("apache-1.1", "products derived from this software may not be called apache nor may apache appear in their name without prior written permission of the apache software foundation"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program"),
    ("gpl-2.0-text", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users"),
    ("gpl-3.0-text", "the gnu general public license is a free copyleft license for software and other kinds of works the licenses for most software and other practical works are designed to take away your freedom to share and change the works"),
    ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details"),
    ("lgpl-3.0-text", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below"),
    ("agpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0-text", "if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network if your version supports such interaction an opportunity to receive the corresponding source of your version"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation with no invariant sections no front cover texts and no back cover texts"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by"),
    ("bsd-warranty", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ncsa", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers neither the names of nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the x consortium"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights and limitations under the license"),
    ("epl-1.0", "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license the license you may not use this file except in compliance with the license"),
    ("eupl-1.2", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl the licence you may not use this work except in compliance with the licence"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license if you do not accept the license do not use the software"),
    ("artistic-2.0", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed the intent is that the copyright holder maintains some artistic control over the development of that package while still keeping the package available as open source and free software"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1 this license is copied below and is also available with a faq at"),
    ("psf", "this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using this software python in source or binary form and its associated documentation"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed do what the fuck you want to public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense-text", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc0-1.0-text", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("all-rights-reserved", "no part of this publication may be reproduced distributed or transmitted in any form or by any means including photocopying recording or other electronic or mechanical methods without the prior written permission of the publisher"),
)

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Automaton:
    """Generalised suffix automaton over word numbers. Its size is linear in the texts: a state keeps the text ends that are its own, and finds the others in its subtree of suffix links."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self._own: list[list[tuple[int, int]]] = [[]]
        for t, words in enumerate(texts):
            last = 0
            for i, c in enumerate(words):
                last = self._extend(last, c)
                self._own[last].append((t, i + 1))
        self._below: list[list[int]] = [[] for _ in self.len]
        for v in range(1, len(self.len)):
            self._below[self.link[v]].append(v)

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.len.append(length)
        self._own.append([])
        return len(self.len) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest string followed by c, which some text before has."""
        q = self.next[p][c]
        if self.len[q] == self.len[p] + 1:
            return q
        clone = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        state = self._new(self.len[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, c)
        return state

    def ends(self, state: int) -> list[tuple[int, int]]:
        """(text, place after the last word) wherever the state's strings stand."""
        out, todo = [], [state]
        while todo:
            v = todo.pop()
            out += self._own[v]
            todo += self._below[v]
        return out

    def suffix(self, state: int, length: int) -> int:
        """The state of the last `length` words of a string of the state."""
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def state(self, words: list[int]) -> int:
        v = 0
        for c in words:
            v = self.next[v][c]
        return v

    def stream(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: after each word, the state and the length of the longest match that ends there."""
        v = n = 0
        for c in words:
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.len[v]
            if c in self.next[v]:
                v, n = self.next[v][c], n + 1
            else:
                v = n = 0
            yield v, n


def best_chains(matches: list[tuple[int, int, int]], gap: int, least: float) -> list[tuple[int, int, int]]:
    """(first file word, last, template words covered) of chains of matches (file place, template place, length) of one template: the best one, then the best of what
    doesn't touch its span in the file, as long as one covers `least` words. The first is given whatever it covers."""
    left, out = sorted(matches, key=lambda m: (m[0] + m[2], m[1])), []
    while left:
        value, before = [], []
        for j, (a, b, n) in enumerate(left):
            best, via = n, -1
            for i in range(j - 1, -1, -1):
                x, y, m = left[i]
                if x + m < a - gap:  # and so end all before it
                    break
                if x + m < a + n and y + m < b + n:
                    cut = max(0, x + m - a, y + m - b)
                    if cut < n and value[i] + n - cut > best:
                        best, via = value[i] + n - cut, i
            value.append(best)
            before.append(via)
        # a chain that touches nothing taken is worth the same without it, so several are taken in one pass
        taken: list[tuple[int, int]] = []

        def touched(first: int, last: int) -> bool:
            at = bisect.bisect_right(taken, (last, last))
            return at > 0 and taken[at - 1][1] >= first

        for top in sorted(range(len(left)), key=lambda j: (-value[j], j)):
            if out and value[top] < least:
                return out
            if touched(left[top][0], left[top][0] + left[top][2] - 1):
                continue
            head = top
            while before[head] >= 0:
                head = before[head]
            first, last = left[head][0], left[top][0] + left[top][2] - 1
            if touched(first, last):
                break
            bisect.insort(taken, (first, last))
            out.append((first, last, value[top]))
        left = [m for m in left if not touched(m[0], m[0] + m[2] - 1)]
    return out


class Scanner:
    def __init__(self, templates=TEMPLATES, base=BASE, min_match: int = 4, share: float = 0.6, gap: int = 16):
        self.labels = [x for _, x in base] + [x for x, _ in templates]
        self.n_base, self.min_match, self.share, self.gap = len(base), min_match, share, gap
        texts = [t.split() for t, _ in base] + [t.split() for _, t in templates]
        vocab = sorted({w for t in texts for w in t})
        raw = [w.encode() for w in vocab]
        ends = np.cumsum([len(w) for w in raw])
        hashes = textvec.Hasher(np.frombuffer(b"".join(raw), np.uint8))(ends - [len(w) for w in raw], ends)
        order = np.argsort(hashes)
        self._hashes, number = hashes[order], {vocab[i]: n for n, i in enumerate(order.tolist())}
        self.texts = [[number[w] for w in t] for t in texts]
        self.sam = Automaton(self.texts)
        self._v = len(vocab)
        # neighbouring words of templates, and those that end a base phrase, as numbers in order
        self._pairs = np.unique([a * self._v + b for t in self.texts for a, b in zip(t, t[1:])])
        self._keys = np.unique([t[-2] * self._v + t[-1] for t in self.texts[: self.n_base]])
        # by state, the base phrases that end where its longer matches end
        own = {self.sam.state(t): (i, len(t)) for i, t in enumerate(self.texts[: self.n_base])}
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.sam.len]
        for s in range(len(self.sam.len)):
            u = s
            while u > 0:
                if u in own:
                    self.phrases[s].append(own[u])
                u = self.sam.link[u]
        self._ends: dict[int, list[tuple[int, int]]] = {}

    def runs(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Word numbers (-1: in no template), first word by text, and the (first, last) words of the runs to stream."""
        buf = textvec.LOWER[buf]
        start, end, first = textvec.spans(buf, offs, WORD)
        if len(start) < 2:
            return np.full(len(start), -1), first, []
        h = textvec.Hasher(buf)(start, end)
        at = np.minimum(np.searchsorted(self._hashes, h), len(self._hashes) - 1)
        number = np.where(self._hashes[at] == h, at, -1)
        both = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0))
        code = number[both] * self._v + number[both + 1]
        pair, key = np.zeros(len(number) - 1, bool), np.zeros(len(number) - 1, bool)
        pair[both], key[both] = (known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code for known in (self._pairs, self._keys))
        edge = first[(first > 0) & (first < len(number))]
        pair[edge - 1] = False
        step = np.diff(np.concatenate([[0], pair.astype(np.int8), [0]]))
        lo, hi = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        keys = np.concatenate([[0], np.cumsum(pair & key)])
        use = (hi - lo >= self.min_match - 1) | (keys[hi] > keys[lo])
        return number, first, list(zip(lo[use].tolist(), hi[use].tolist()))

    def document(self, number: np.ndarray, runs: list[tuple[int, int]]) -> tuple:
        """(places and labels of base phrases, chained spans as (label, first word, last word, share), the largest share); runs count from the document."""
        places: list[int] = []
        base: set[str] = set()
        seeds: dict[tuple[int, int], list[int]] = {}  # (template, template place less file place) -> file places where min_match words stand
        for lo, hi in runs:
            for i, (v, n) in enumerate(self.sam.stream(number[lo : hi + 1].tolist()), lo):
                for phrase, size in self.phrases[v]:
                    if n >= size:
                        places.append(i - size + 1)
                        base.add(self.labels[phrase])
                if n >= self.min_match:
                    u = self.sam.suffix(v, self.min_match)
                    if u not in self._ends:
                        self._ends[u] = self.sam.ends(u)
                    for t, end in self._ends[u]:
                        if t >= self.n_base:
                            seeds.setdefault((t, end - 1 - i), []).append(i - self.min_match + 1)
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for (t, shift), at in seeds.items():
            begin = 0
            for k in range(1, len(at) + 1):
                if k == len(at) or at[k] != at[k - 1] + 1:
                    matches.setdefault(t, []).append((at[begin], at[begin] + shift, k - begin + self.min_match - 1))
                    begin = k
        chains = [(t, *c) for t, found in matches.items() for c in best_chains(found, self.gap, self.share * len(self.texts[t]))]
        spans = {(self.labels[t], first, last, covered / len(self.texts[t])) for t, first, last, covered in self.prevailing(chains)}
        return places, base, sorted(spans), max((covered / len(self.texts[t]) for t, _, _, covered in chains), default=0.0)

    def prevailing(self, chains: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Chains (template, first, last, covered) that cover share of their template, without those inside the span of one that covers more words and no smaller share of its own: of
        two wordings that differ in a word it is the one that stands there."""
        full = sorted((c for c in chains if c[3] >= self.share * len(self.texts[c[0]])), key=lambda c: (c[1], -c[2], -c[3]))
        out, around = [], []
        for t, first, last, covered in full:
            around = [c for c in around if c[2] >= first]
            part = covered / len(self.texts[t])
            if not any(c[2] >= last and c[3] > covered and c[3] / len(self.texts[c[0]]) >= part for c in around):
                out.append((t, first, last, covered))
            around.append((t, first, last, covered))
        return out


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))),
])


def scan(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: words, base phrases, labels, and the template spans found.

    docs: doc_id and text (null as empty); other columns are ignored, repeated rows are scanned each by itself. score: the largest share of
    a template, or of a base phrase, that the text covers (0 without a match, so for empty texts).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(**options)
        for batch in batches:
            for lo, hi, buf, offs in textvec.chunks(batch.column(1)):
                number, first, runs = scanner.runs(buf, offs)
                by: dict[int, list] = defaultdict(list)
                for (a, b), d in zip(runs, (np.searchsorted(first, [r[0] for r in runs], "right") - 1).tolist()):
                    by[d].append((a - int(first[d]), b - int(first[d])))
                rows = []
                for d, n in enumerate(np.diff(first).tolist()):
                    places, base, spans, share = scanner.document(number[first[d] : first[d + 1]], by[d]) if d in by else ([], set(), [], 0.0)
                    rows.append((n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})), 1.0 if base else min(1.0, share), [dict(zip(("label", "first", "last", "share"), s)) for s in spans]))
                columns = [batch.column(0).slice(lo, hi - lo), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(_SCHEMA)[1:]))]
                yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, last: long, share: double>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run), schema)
