"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports what is matched."""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, pieces, ragged
from .decontaminate import plain_words
from .rolling import anchors
from .substrings import Words

#: Short public notices by which texts state their licence.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved.",
}

#: Standard headers by which texts refer to a licence, besides those above.
HEADERS: dict[str, str] = {
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

#: Words of a fingerprint, fingerprints of a winnowing window (a shared run of GRAM + WINDOW - 1 words is always seen), least coverage, band of the alignment.
GRAM, WINDOW, COVERAGE, BAND = 3, 2, 0.8, 6
#: Least share of a template's words that a chain of shared runs holds: a match of coverage 0.8 with one change after every third word has less.
CHAINED = 0.2
#: Bytes of templates and words of one, at most: they are sent to every task.
TEMPLATE_BYTES, TEMPLATE_WORDS = 16 << 20, 1 << 18
#: Of alignments that are advanced together, cells of a row and template words, at most.
CELLS, ROWS = 1 << 16, 1 << 21
#: An alignment's cell as one number: score, equal words, first word.
_EQUAL = 1 << 22
_SCORE = _EQUAL << 20


def all_templates() -> dict[str, str]:
    """TEMPLATES, HEADERS and the whole texts of license_texts, named with "-text"."""
    texts = {f"{p.stem}-text": p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    return {**TEMPLATES, **HEADERS, **texts}


@dataclass(frozen=True)
class Chain:
    """Shared runs of a text and a template, in order in both: first and last row (template word, end excluded) and diagonal (text word - template word) of each."""

    first: list[int]
    last: list[int]
    shift: list[int]

    def centres(self, size: int) -> np.ndarray:
        """The diagonal in the middle of the band at each of `size` rows; where a run ends and the next begins, halfway between the two."""
        out = np.empty(size, np.int64)
        out[: self.last[0]] = self.shift[0]
        for i in range(1, len(self.shift)):
            out[max(self.last[i - 1] - 1, 0) : self.first[i] + 1] = (self.shift[i - 1] + self.shift[i]) // 2
            out[self.first[i] + 1 : self.last[i]] = self.shift[i]
        out[self.last[-1] :] = self.shift[-1]
        return out

    def half_width(self, band: int) -> int:
        return band + (max((abs(a - b) for a, b in itertools.pairwise(self.shift)), default=0) + 1) // 2

    def anchor(self) -> tuple[int, int]:
        """(row, diagonal) in the middle of the longest run."""
        i = max(range(len(self.shift)), key=lambda k: self.last[k] - self.first[k])
        return (self.first[i] + self.last[i] - 1) // 2, self.shift[i]


def align(text: np.ndarray, template: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(equal words, start, end) of the best local alignment of template in text near the diagonal `shift`; see align_chains."""
    return align_chains([text], [template], [Chain([0], [len(template)], [shift])], band, anchored=False)[0]


def align_chains(texts: list[np.ndarray], templates: list[np.ndarray], chains: list[Chain], band: int = BAND, anchored: bool = True) -> list[tuple[int, int, int]]:
    """(equal words, start, end) of the best local alignment of each template in its text in the band around its chain.

    A match counts 2, a mismatch or gap -1. Of equal scores the one that ends in the earlier template word counts, then that with more equal words, then the
    later start. start and end are places in the text. Anchored: only alignments through the middle of the chain's longest run count, so that
    of copies in a row each chain gives its own. All alignments advance together, a template word at a time.
    """
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(chains)
    half = [c.half_width(band) for c in chains]
    # alike in width, longest templates first; so many that a row has CELLS cells and all have ROWS rows at most
    order = sorted(range(len(chains)), key=lambda i: (half[i].bit_length(), -len(templates[i])))
    at = 0
    while at < len(order):
        end, widest, rows = at + 1, half[order[at]], len(templates[order[at]])
        while end < len(order) and half[order[end]].bit_length() == widest.bit_length():
            wider = max(widest, half[order[end]])
            if (end + 1 - at) * (2 * wider + 1) > CELLS or (end + 1 - at) * rows > ROWS:
                break
            end, widest = end + 1, wider
        some = order[at:end]
        for i, x in zip(some, _aligned([texts[i] for i in some], [templates[i] for i in some], [chains[i] for i in some], widest, anchored), strict=True):
            out[i] = x
        at = end
    return out


def _aligned(texts: list[np.ndarray], templates: list[np.ndarray], chains: list[Chain], half: int, anchored: bool) -> list[tuple[int, int, int]]:
    """align_chains of alignments by falling length of their templates, in bands of one width."""
    size = np.fromiter(map(len, templates), np.int64, len(templates))
    longest = int(size[0])
    centre = np.zeros((len(size), longest + 1), np.int64)
    word = np.zeros((len(size), longest), np.uint64)
    for i, (c, t) in enumerate(zip(chains, templates, strict=True)):
        centre[i, : size[i]] = c.centres(int(size[i]))
        word[i, : size[i]] = t
    # each text from the first place that its band can reach, with words of no template around it
    low = np.fromiter((int((centre[i, : size[i]] + np.arange(size[i])).min()) - half for i in range(len(size))), np.int64, len(size))
    high = np.fromiter((int((centre[i, : size[i]] + np.arange(size[i])).max()) + half + 1 for i in range(len(size))), np.int64, len(size))
    first = np.cumsum(high - low) - (high - low)
    flat, real = np.zeros(int((high - low).sum()), np.uint64), np.zeros(int((high - low).sum()), bool)
    for i, t in enumerate(texts):
        a, z = max(int(low[i]), 0), min(int(high[i]), len(t))
        if a < z:
            to = int(first[i] + a - low[i])
            flat[to : to + z - a], real[to : to + z - a] = t[a:z], True
    fixed: dict[int, list[tuple[int, int]]] = {}
    for i, (row, shift) in enumerate(c.anchor() for c in chains if anchored):
        fixed.setdefault(row, []).append((i, shift))
    moves = np.append(False, np.diff(centre, axis=1).any(axis=0))
    k = np.arange(2 * half + 1)
    cost = k * _SCORE
    cells = np.zeros((len(size), 2 * half + 3), np.int64)  # with a dead cell and one more to the right
    best, where = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    active = len(size)
    for j in range(longest):
        while size[active - 1] <= j:
            active -= 1
        c = centre[:active, j]
        old = cells[:active]
        if moves[j]:
            to = k + (c - centre[:active, j - 1])[:, None]
            old = np.where((to >= 0) & (to <= 2 * half), np.take_along_axis(old, np.clip(to, 0, 2 * half), 1), 0)
            to = to + 1
            up = np.where((to >= 0) & (to <= 2 * half), np.take_along_axis(cells[:active], np.clip(to, 0, 2 * half), 1), 0)
        else:
            old, up = old[:, :-2], old[:, 1:-1]
        place = (c + (j - half) - low[:active])[:, None] + k
        source = place + first[:active, None]
        inside = real[source]
        same = inside & (flat[source] == word[:active, j, None])
        new = np.maximum(np.where(old > 0, old, place) + np.where(same, 2 * _SCORE + _EQUAL, -_SCORE), up - _SCORE)
        new = np.maximum.accumulate(new + cost, axis=1) - cost  # text words without partner
        new[~inside | (new < _SCORE)] = 0
        for i, shift in fixed.get(j, ()):
            own = int(shift - c[i] + half)
            kept = new[i, own]
            new[i], best[i] = 0, 0
            new[i, own] = kept
        cells[:active, :-2] = new
        top = new.argmax(axis=1)
        value = new[np.arange(active), top]
        better = value // _SCORE > best[:active] // _SCORE
        if better.any():
            best[:active][better] = value[better]
            where[:active][better] = place[np.flatnonzero(better), top[better]]
    start = best % _EQUAL + low
    return [(int(b % _SCORE // _EQUAL), int(a), int(z)) if b else (0, 0, 0) for b, a, z in zip(best, start, where + low + 1, strict=True)]


def _chains(x0: np.ndarray, x1: np.ndarray, r0: np.ndarray, words: np.ndarray, size: int, need: float) -> Iterator[Chain]:
    """Chains that hold `need` words or more, of runs of one text and template sorted by x0, r0 (text words x0 to x1 equal template words from r0 on).

    A chain's worth is twice its words, less one for each diagonal between one run and the next; a match of positive score spans
    three times the template at most. The chains of most worth come first, each run is in one chain.
    """
    shift, r1 = x0 - r0, r0 + x1 - x0
    worth, before = 2 * words, np.full(len(x0), -1)
    reach = np.searchsorted(x0, x0 - 3 * size)
    upto = np.searchsorted(x0, x0)
    for i in range(len(x0)):
        a, z = reach[i], upto[i]
        if a == z:
            continue
        over = np.maximum(np.maximum(x1[a:z] - x0[i], r1[a:z] - r0[i]), 0)
        value = worth[a:z] - np.abs(shift[a:z] - shift[i]) - 2 * over
        value[(r0[a:z] >= r0[i]) | (over >= x1[i] - x0[i])] = 0
        k = int(value.argmax())
        if value[k] > 0:
            worth[i] += value[k]
            before[i] = a + k
    used = np.zeros(len(x0), bool)
    for i in np.argsort(-worth, kind="stable").tolist():
        chain, held = [], 0
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            held += int(words[i])
            i = int(before[i])
        if held >= need:
            chain.reverse()
            yield Chain(r0[chain].tolist(), r1[chain].tolist(), shift[chain].tolist())


def _winnow(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and their places: of each window of WINDOW runs of GRAM words the smallest hash."""
    h, ok = w.gram(GRAM)
    i = np.arange(len(h))
    at, _, _ = anchors(h, i + GRAM + WINDOW - 1 <= w.last, WINDOW)
    # texts shorter than a window: all they have
    short = np.flatnonzero(ok & (w.last - w.before[w.text] < GRAM + WINDOW - 1)) if len(h) else i
    at = np.union1d(at, short).astype(np.int64)
    return h[at], at


def _own(w: Words | Templates, i: int) -> np.ndarray:
    """The words of one text."""
    return w.word[w.before[i] : w.before[i] + w.count[i]]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two texts share in any order, repeats counted: no alignment has more equal words."""
    word, n = np.unique(a, return_counts=True)
    other, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(word, other, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


class Templates:
    """Inverted index of template fingerprints: hash -> (template, place)."""

    def __init__(self, templates: Mapping[str, str]) -> None:
        if sum(len(t.encode()) for t in templates.values()) > TEMPLATE_BYTES:
            raise ValueError("templates: more text than may be sent to every task")
        self.names = sorted(templates)
        w = plain_words([templates[n].encode() for n in self.names])
        self.word, self.before, self.count = w.word, w.before, w.count
        if len(self.count) and self.count.max() > TEMPLATE_WORDS:
            raise ValueError("templates: one of more words than an alignment may have")
        # a template's own places are all indexed, so that a fingerprint of a text meets it wherever it was chosen
        h, ok = w.gram(GRAM)
        at = np.flatnonzero(ok)
        order = np.argsort(h[at], kind="stable")
        self.hash, at = h[at][order], at[order]
        #: Fingerprints of templates too short for a winnowing window to be sure; they are looked up everywhere.
        self.short = np.unique(self.hash[self.count[w.text[at]] < GRAM + WINDOW - 1])
        self.template, self.place = w.text[at], at - w.before[w.text[at]]

    def found(self, texts: list[bytes], coverage: float) -> list[tuple[int, str, float, int, int]]:
        """(text, template, coverage, first word, one after the last word) of every match, by text and place."""
        w = plain_words(texts)
        _, at = _winnow(w)
        h, ok = w.gram(GRAM)
        if not len(h) or not len(self.hash):
            return []
        at = np.union1d(at, np.flatnonzero(ok & np.isin(h, self.short))).astype(np.int64)
        h = h[at]
        lo, hi = np.searchsorted(self.hash, h, side="left"), np.searchsorted(self.hash, h, side="right")
        n = hi - lo
        k, at = ragged(lo, n), np.repeat(at, n)
        if not len(k):
            return []
        t, m, x, r = w.text[at], self.template[k], at - w.before[w.text[at]], self.place[k]
        order = np.lexsort((r, m, t))
        t, m, x, r = t[order], m[order], x[order], r[order]
        # a text that shares too few different places of a template is no candidate
        pair = np.cumsum(np.append(0, (np.diff(t) != 0) | (np.diff(m) != 0)))
        other = np.append(True, (np.diff(pair) != 0) | (np.diff(r) != 0))
        many = (np.bincount(pair, other) * GRAM >= CHAINED * self.count[m[np.append(True, np.diff(pair) != 0)]])[pair]
        t, m, x, r, pair = t[many], m[many], x[many], r[many], pair[many]
        if not len(t):
            return []
        # runs: hits on one diagonal with one or two words between at most
        order = np.lexsort((x, x - r, pair))
        t, m, x, r, pair = t[order], m[order], x[order], r[order], pair[order]
        ahead = np.diff(x)
        new = np.append(True, (np.diff(pair) != 0) | (np.diff(x - r) != 0) | (ahead > 2 + GRAM))
        run = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(x)) - 1
        words = np.bincount(run, np.where(new, GRAM, np.minimum(np.append(GRAM, ahead), GRAM))).astype(np.int64)
        t, m, pair, x0, x1, r0 = t[head], m[head], pair[head], x[head], x[tail] + GRAM, r[head]
        order = np.lexsort((r0, x0, pair))
        t, m, pair, x0, x1, r0, words = (v[order] for v in (t, m, pair, x0, x1, r0, words))
        cut = np.flatnonzero(np.append(True, np.diff(pair) != 0))
        found: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
        owner: list[tuple[int, int]] = []
        chains: list[Chain] = []
        for a, z in zip(cut.tolist(), np.append(cut[1:], len(pair)).tolist(), strict=True):
            size = int(self.count[m[a]])
            for chain in _chains(x0[a:z], x1[a:z], r0[a:z], words[a:z], size, max(GRAM, CHAINED * size)):
                key = int(t[a]), int(m[a])
                text, template, at = _own(w, key[0]), _own(self, key[1]), chain.shift[0]
                if len(chain.shift) == 1 and 0 <= at <= len(text) - size and (text[at : at + size] == template).all():
                    found.setdefault(key, set()).add((size, at, at + size))  # no alignment is better
                elif _common(text[max(0, chain.shift[0] + chain.first[0] - 3 * size) : chain.shift[-1] + chain.last[-1] + 3 * size], template) >= coverage * size:
                    owner.append(key)
                    chains.append(chain)
        texts_of, templates_of = [_own(w, t) for t, _ in owner], [_own(self, m) for _, m in owner]
        for (t, m), (equal, start, end) in zip(owner, align_chains(texts_of, templates_of, chains), strict=True):
            if equal >= coverage * self.count[m]:
                found.setdefault((t, m), set()).add((equal, start, end))
        out = []
        for (t, m), spans in found.items():
            taken: list[tuple[int, int]] = []  # by place; of matches that overlap, the one with more words, then the earlier
            for equal, a, e in sorted(spans, key=lambda x: (-x[0], x[1], x[2])):
                i = bisect.bisect_left(taken, (a, e))
                if (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < e):
                    continue
                taken.insert(i, (a, e))
                out.append((t, self.names[m], equal / int(self.count[m]), a, e))
        return sorted(out, key=lambda x: (x[0], x[1], x[3], x[4]))


def license_spans(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per match: doc_id, template, coverage (share of the template's words matched in order), start, end (words of the text, end excluded).

    Words are runs between white space and ASCII punctuation, in lower case. A text's winnowed fingerprints are looked up in the index of the
    templates; runs that they share are chained in order, and each chain is aligned within a band around it, so a match may lack, change or add words, up to the
    coverage, as long as runs of GRAM + WINDOW - 1 equal words hold CHAINED of the template; of one template, all matches that do not overlap are reported. Texts of fewer than GRAM words, null and empty texts match nothing. A template that is part of another is reported
    beside it; one of fewer than GRAM words is never found. The templates are of bounded size and sent to the texts, which are not shuffled.
    """
    index = Templates(templates)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[t], m, c, a, e) for t, m, c, a, e in index.found(byte_values(part.column("text")), coverage)]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "template", "coverage", "start", "end"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, template string, coverage double, start long, end long")
