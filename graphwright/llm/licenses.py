"""License scans by patience alignment.

A template is a license text or notice; its coverage by a text is the share of its words that an alignment matches.
*Patience alignment*: match the common words at both ends of the two ranges, anchor on the words that are unique to both,
keep the longest increasing subsequence of the anchors, and align the gaps between them in the same way, where words that
were not unique in the whole may be.  The gaps before the first and after the last anchor reach no farther into the text
than a few times their length in the template.

Where to align: a template can be covered to ``COVERAGE`` only by a stretch of text with as many of its words close
together, so the positions of its words are grouped into regions that are dense enough (an upper bound on coverage, so
nothing is missed within the slack), and every region is aligned.  A region may hold the notice several times, and then has
no unique words or loose alignments: the best alignment, the tightest of those with as many words, is taken, and what is left
of the region is aligned again until nothing is covered.  Of overlapping stretches of several licenses one stays, and the
others' templates are aligned once more with what it leaves.

*Which license.*  Licenses of one family differ in a word or two, so coverage alone doesn't tell them apart.  The words that
name a template's license and version (``DECIDING``) must be matched, and no word that turns it into another one
(``VARIANTS``, and numbers where a number decides) may stand among the matched ones unmatched.  Notices of up to ``SHORT``
words must be there word for word.

Words are runs of letters (ASCII lower-cased), digits and non-ASCII characters, compared by 64-bit hashes.  One pass, no
shuffle; whole texts of any length.  Null and empty texts match nothing.  Repeated rows match alike.  Of equally covered
templates the one with more words is the best, then the first in the text, then by name.  Empty tables give no rows.
Only the named columns are read, so extra ones don't matter, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphwright.llm.words import ALNUM, LOWER, Piece, among, pieces

#: Share of a template's words that must be matched, and how many times a template's length its match may be stretched.
COVERAGE, SLACK = 0.75, 2

#: Templates of so few words must be matched whole and without gaps.
SHORT = 7
#: Words of a text that make another license of a template that they stand in.
VARIANTS = ["lesser", "library", "affero", "nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike", "not", "no", "never", "without"]

#: Notices and opening passages of public licenses, by SPDX identifier.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved.",
}
#: The words of templates that name the license, its variant and its version.
DECIDING = {
    "MIT": ["mit"],
    "Apache-2.0": ["apache", "2", "0"],
    "Apache-2.0-text": ["apache", "2", "0"],
    "GPL-3.0": ["gnu", "general", "3"],
    "GPL-3.0-text": ["gnu", "general", "3"],
    "LGPL-3.0": ["gnu", "lesser", "3"],
    "MPL-2.0": ["mozilla", "2", "0"],
    "CC0-1.0": ["waived", "copyright"],
    "Unlicense": ["unencumbered", "public", "domain"],
}


def _increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tails: list[int] = []
    index: list[int] = []
    back = [-1] * len(places)
    for i, x in enumerate(places):
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
            index.append(i)
        else:
            tails[k], index[k] = x, i
        back[i] = index[k - 1] if k else -1
    out = []
    at = index[-1] if index else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched positions (in template, in text), increasing in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        t0, t1, p0, p1 = todo.pop()
        while t0 < t1 and p0 < p1 and text[t0] == template[p0]:
            found.append((p0, t0))
            t0, p0 = t0 + 1, p0 + 1
        while t0 < t1 and p0 < p1 and text[t1 - 1] == template[p1 - 1]:
            t1, p1 = t1 - 1, p1 - 1
            found.append((p1, t1))
        if t0 >= t1 or p0 >= p1:
            continue
        here, there = Counter(template[p0:p1]), Counter(text[t0:t1])
        at = {w: i for i, w in enumerate(text[t0:t1], t0) if there[w] == 1 and here.get(w) == 1}
        both = [(i, at[w]) for i, w in enumerate(template[p0:p1], p0) if w in at]
        if not both:
            continue
        chain = [both[i] for i in _increasing([t for _, t in both])]
        found += chain
        p, t = p0, t0
        for k, (cp, ct) in enumerate(chain):
            todo.append((max(t, ct - SLACK * (cp - p)) if k == 0 else t, ct, p, cp))
            p, t = cp + 1, ct + 1
        todo.append((t, min(t1, t + SLACK * (p1 - p)), p, p1))
    return sorted(found)


def regions(places: np.ndarray, wanted: int, length: int) -> list[tuple[int, int]]:
    """Disjoint stretches in which wanted of the places lie within SLACK times the length."""
    if len(places) < wanted:
        return []
    reach = SLACK * max(length, 2)
    first = np.flatnonzero(places[wanted - 1 :] - places[: len(places) - wanted + 1] < reach)
    out: list[list[int]] = []
    for i in first:
        a, b = int(places[i]), int(places[i + wanted - 1]) + 1
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: Words that aren't the template's: others, and those that turn it into another license.
OTHER, VARIANT = -1, -2


class Template:
    """A template's words, how many of them a match needs, and which of them."""

    def __init__(self, words: list[int], deciding: set[int] = frozenset()):
        self.words, self.size = words, len(words)
        self.whole = self.size <= SHORT
        self.least = self.size if self.whole else max(1, -(-int(COVERAGE * 100) * self.size // 100))
        self.deciding = {i for i, w in enumerate(words) if w in deciding}

    def match(self, text: list[int], a: int, b: int) -> tuple[int, int, int]:
        """Matched words, first and last position of the alignment from a to b; no words if it isn't this license."""
        found = align(text[a:b], self.words)
        if len(found) < self.least:
            return 0, a, a
        (p, first), (q, last) = ((p, t + a) for p, t in (found[0], found[-1]))
        place = text[max(0, first - p) : last + self.size - q]  # where all of it would be
        if self.whole and last - first + 1 != self.size or not self.deciding <= {p for p, _ in found} or VARIANT in place:
            return 0, a, a
        return len(found), first, last


def _best(text: list[int], known: np.ndarray, t: Template, a: int, b: int) -> list[int] | None:
    """Matched words, first and last position of the best covered alignment from a to b: most words, then the shortest stretch.

    An alignment that is hardly longer than the template is taken as it is; else others are tried from every word on.
    known: the template's words before each position.
    """
    best = t.match(text, a, b)
    if best[0] < t.least or best[2] - best[1] >= t.size + t.size // 4:
        for c in range(a, b):
            if text[c] >= 0:
                for d in (min(b, c + t.size), min(b, c + t.size + t.size // 2)):
                    if known[d] - known[c] >= max(t.least, best[0]):
                        best = max(best, t.match(text, c, d), key=lambda x: (x[0], x[1] - x[2]))
    return list(best) if best[0] >= t.least else None


def matches(text: list[int], t: Template) -> list[list[int]]:
    """Matched words, first and last position of disjoint covered alignments, until nothing between them is covered.

    A long stretch is first cut at covered windows, from left to right, so that the time follows its length.
    """
    out = []
    known = np.concatenate([[0], np.cumsum(np.array(text) >= 0)])
    todo = []
    at = rest = 0
    step, wide = max(1, t.size // 4), t.size + t.size // 2
    while len(text) - rest > 2 * SLACK * max(t.size, 2) and at < len(text):
        end = min(len(text), at + wide)
        if known[end] - known[at] >= t.least and len(align(text[at:end], t.words)) >= t.least:
            found = _best(text, known, t, at, min(len(text), at + SLACK * t.size))
            if found:
                out.append(found)
                todo.append((rest, found[1]))
                at = rest = found[2] + 1
                continue
        at += step
    todo.append((rest, len(text)))
    while todo:
        a, b = todo.pop()
        if known[b] - known[a] >= t.least and (found := _best(text, known, t, a, b)):
            out.append(found)
            todo += [(a, found[1]), (found[2] + 1, b)]
    return sorted(out, key=lambda x: x[1])


class Library:
    """Templates as word hashes, and which words they have."""

    def __init__(self, templates: dict[str, str], deciding: dict[str, list[str]] | None = None, variants: list[str] = VARIANTS):
        self.names = list(templates)
        deciding = {k: x for k, x in (deciding or {}).items() if k in templates}
        p = Piece(pa.array(list(templates.values())), ALNUM, LOWER)
        q = Piece(pa.array([" ".join(deciding.get(k, [])) for k in self.names]), ALNUM, LOWER)
        turns = Piece(pa.array(variants or [""]), ALNUM, LOWER).hash
        numbers = Piece(pa.array([str(i) for i in range(10)]), ALNUM, LOWER).hash
        self.vocabulary = np.unique(np.concatenate([p.hash, turns, numbers]))
        ids = np.searchsorted(self.vocabulary, p.hash)
        self.times = np.zeros((len(self.vocabulary), len(self.names)), np.int64)
        np.add.at(self.times, (ids, p.doc), 1)
        place = lambda x: set(np.searchsorted(self.vocabulary, x).tolist())
        self.templates = [Template(ids[a:b].tolist(), place(q.hash[c:d])) for a, b, c, d in zip(p.first[:-1], p.first[1:], q.first[:-1], q.first[1:], strict=True)]
        self.least = np.array([t.least for t in self.templates])
        #: By template, the words that turn it into another license.
        self.turning = np.zeros(self.times.shape, bool)
        self.turning[list(place(turns))] = True
        for k, t in enumerate(self.templates):
            if {t.words[i] for i in t.deciding} & place(numbers):
                self.turning[list(place(numbers)), k] = True
        self.turning &= self.times == 0

    def _found(self, k: int, text: list[int], base: int) -> list[dict]:
        t = self.templates[k]
        return [{"license": self.names[k], "first_word": a + base, "last_word": b + base, "matched": n, "coverage": n / t.size} for n, a, b in matches(text, t)]

    def scan(self, p: Piece) -> list[list[dict]]:
        """The covered stretches of each text, those of other licenses apart."""
        at = among(p.hash, self.vocabulary)
        word, doc = np.searchsorted(self.vocabulary, p.hash[at]), p.doc[at]
        have = np.zeros((p.n, len(self.vocabulary)), bool)
        have[doc, word] = True
        possible = have.astype(np.int64) @ self.times >= self.least
        edge = np.searchsorted(doc, np.arange(p.n + 1))
        stretches: dict[int, list[tuple[int, int, list[int]]]] = {}
        for d, k in zip(*np.nonzero(possible), strict=True):
            own = slice(edge[d], edge[d + 1])
            mine = self.times[word[own], k] > 0
            place, which = at[own][mine] - p.first[d], word[own][mine]
            turns = at[own][self.turning[word[own], k]] - p.first[d]
            size = self.templates[k].size
            for a, b in regions(place, int(self.least[k]), size):
                a, b = max(0, a - size), min(int(p.counts[d]), b + size)
                text = np.full(b - a, OTHER, np.int64)
                text[turns[slice(*np.searchsorted(turns, [a, b]))] - a] = VARIANT
                inside = slice(*np.searchsorted(place, [a, b]))
                text[place[inside] - a] = which[inside]
                stretches.setdefault(int(d), []).append((int(k), a, text.tolist()))
        out: list[list[dict]] = [[] for _ in range(p.n)]
        for d, parts in stretches.items():
            found = [(x, self._found(k, text, a)) for x in parts for k, a, text in [x]]
            while found:
                spans = [s for _, more in found for s in more]
                out[d] = _apart(out[d] + spans)
                kept = {(s["license"], s["first_word"]) for s in out[d]}
                # a template whose stretch went to another license may be covered between those that stay
                again = [x for x, more in found if any((s["license"], s["first_word"]) not in kept for s in more)]
                found = []
                for k, a, text in again:
                    ends = [a, *(e for s in out[d] for e in (min(max(s["first_word"], a), a + len(text)), min(max(s["last_word"] + 1, a), a + len(text)))), a + len(text)]
                    for c, e in zip(ends[::2], ends[1::2], strict=True):
                        part = text[c - a : e - a]
                        if sum(w >= 0 for w in part) >= self.least[k]:
                            found.append(((k, c, part), self._found(k, part, c)))
                found = [x for x in found if x[1]]
        return out


def _apart(spans: list[dict]) -> list[dict]:
    """Of overlapping stretches, the one with most matched words (a long notice may begin with a short one), then the one that is covered best."""
    out: list[dict] = []
    for x in sorted(spans, key=lambda x: (-x["matched"], -x["coverage"], x["first_word"], x["license"])):
        at = bisect_left(out, x["first_word"], key=lambda y: y["last_word"])
        if at == len(out) or x["last_word"] < out[at]["first_word"]:
            out.insert(at, x)
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("matched", T.LongType()), T.StructField("coverage", T.DoubleType())]))


def scan(df: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("doc_id",), templates: dict[str, str] = TEMPLATES, deciding: dict[str, list[str]] = DECIDING) -> DataFrame:
    """One row per row of df: the keys, n_words, n_matches, the licenses found (sorted, comma-joined), the best one, its coverage, and the spans."""
    library = df.sparkSession.sparkContext.broadcast(Library(templates, deciding))  # as large as the templates
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("n_words", T.LongType()), T.StructField("n_matches", T.LongType()), T.StructField("licenses", T.StringType()), T.StructField("best", T.StringType()), T.StructField("best_coverage", T.DoubleType()), T.StructField("spans", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library.value
        for b in pieces(batches, text_col):
            p = Piece(b.column(text_col), ALNUM, LOWER)
            spans = lib.scan(p)
            best = [min(s, key=lambda x: (-x["coverage"], -x["matched"], x["first_word"], x["license"]), default=None) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keys), pa.array(p.counts.astype(np.int64)), pa.array([len(s) for s in spans], pa.int64()), pa.array([",".join(sorted({x["license"] for x in s})) for s in spans], pa.string())]
                + [pa.array([x and x["license"] for x in best], pa.string()), pa.array([x and x["coverage"] for x in best], pa.float64())]
                + [pa.array(spans, pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())])))],
                names=schema.names,
            )

    return df.select(*dict.fromkeys([*keys, text_col])).mapInArrow(run, schema)
