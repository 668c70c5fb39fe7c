"""License notices in documents: winnowed fingerprints pick candidates, banded alignment confirms them."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The wording of widespread license notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License",
    "MIT grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
}
_WORD = re.compile(rb"[a-z0-9]+")
_NONE = np.iinfo(np.uint64).max


@dataclass(frozen=True)
class Match:
    license: str
    first_word: int
    last_word: int
    matched: int
    coverage: float


@dataclass(frozen=True)
class Plan:
    """How a template is looked for; see ``Index``."""

    gram: int
    window: int
    need: int
    band: int


class Index:
    """Templates by their winnowed fingerprints: of every ``window`` consecutive ``gram``-word hashes the least is kept.

    Both numbers are each template's own, such that a passage that matches ``least`` of its words must share a fingerprint: as many
    words as may be missing, and as many diagonals as the alignment's band has, can cut the matched words into so many
    runs at most, and gram + window - 1 is what the longest of these has at least. Short and medium templates so get runs of one or two words, all of them
    kept. Where all are kept, the runs also tell how many fingerprints a match shares at least (``need``).
    """

    def __init__(self, templates: Mapping[str, str], least: float = 0.8, gram: int = 3, band: int = 8):
        self.least = least
        split = {name: _WORD.findall(text.encode().lower()) for name, text in templates.items()}
        self.words = {w: i for i, w in enumerate(sorted({w for ws in split.values() for w in ws}), 1)}
        self.templates = {name: np.array([self.words[w] for w in ws], np.int64) for name, ws in split.items() if ws}
        self.plans = {name: self._plan(len(ids), gram, band) for name, ids in self.templates.items()}
        self.inverted: dict[int, dict[int, list[tuple[str, int]]]] = {}  # by gram and hash
        for name, ids in self.templates.items():
            plan = self.plans[name]
            hashes = self._grams(ids, plan.gram)
            for at in self._winnow(hashes, plan.window):
                self.inverted.setdefault(plan.gram, {}).setdefault(int(hashes[at]), []).append((name, int(at)))
        self.keys = {g: np.array(sorted(by), np.uint64) for g, by in self.inverted.items()}
        self.places: dict[str, list[list[int]]] = {}  # of each template, where it has each key
        for name, plan in self.plans.items():
            by = self.inverted[plan.gram]
            self.places[name] = [[at for n, at in by[int(k)] if n == name] for k in self.keys[plan.gram]]
        self.members = {name: np.array([bool(at) for at in places]) for name, places in self.places.items()}

    def _plan(self, n: int, gram: int, band: int) -> Plan:
        width, matched = min(band, n // 4), max(1, int(np.ceil(self.least * n - 1e-9)))
        runs = n - matched + 2 * width + 1
        longest = -(-matched // runs)
        gram = min(gram, longest)
        window = longest - gram + 1
        return Plan(gram, window, max(1, matched - (gram - 1) * runs) if window == 1 else 1, width)

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words, 0 for those that no template has."""
        get = self.words.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    @staticmethod
    def _grams(ids: np.ndarray, gram: int) -> np.ndarray:
        """Hashes of all runs of words; the largest number for a run with a word that no template has."""
        n = len(ids) - gram + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h, known = np.zeros(n, np.uint64), np.ones(n, bool)
        for i in range(gram):
            part = ids[i : i + n]
            h = (h * np.uint64(0x100000001B3)) ^ (part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            known &= part > 0
        h ^= h >> np.uint64(29)
        return np.where(known, h, _NONE)

    @staticmethod
    def _winnow(h: np.ndarray, window: int) -> np.ndarray:
        if not len(h):
            return np.zeros(0, np.int64)
        if window > 1:
            views = np.lib.stride_tricks.sliding_window_view(h, min(window, len(h)))
            at = np.unique(views.argmin(axis=1) + np.arange(len(views)))
            return at[h[at] != _NONE]
        return np.flatnonzero(h != _NONE)

    def find(self, ids: np.ndarray) -> list[Match]:
        """Matches that cover at least ``least`` of a template's words, in page order; of matches within each other the longer."""
        if not (ids > 0).any():
            return []
        shared: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}  # places of fingerprints that any template has, and their keys
        found = []
        for name, plan in self.plans.items():
            if (plan.gram, plan.window) not in shared:
                hashes, keys = self._grams(ids, plan.gram), self.keys[plan.gram]
                at = self._winnow(hashes, plan.window)
                key = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
                same = keys[key] == hashes[at]
                shared[plan.gram, plan.window] = at[same], key[same]
            at, key = shared[plan.gram, plan.window]
            own = self.members[name][key]
            matches = [self._align(name, self.templates[name], ids, start, plan.band) for start in self._starts(name, at[own], key[own])]
            found += [m for m in dict.fromkeys(matches) if m is not None and m.coverage >= self.least]
        found.sort(key=lambda m: (-m.matched, m.first_word, m.license))
        kept: list[Match] = []
        for m in found:
            if not any(k.first_word <= m.first_word and m.last_word <= k.last_word for k in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: (m.first_word, m.license))

    def _starts(self, name: str, at: np.ndarray, key: np.ndarray) -> list[int]:
        """The diagonals within whose band a template shares ``need`` fingerprints, from the places of those it shares at all."""
        plan, n = self.plans[name], len(self.templates[name])
        if len(at) < plan.need:
            return []
        # first by distance alone: so many places in a stretch as long as a match can be
        tight = np.flatnonzero(at[plan.need - 1 :] - at[: len(at) - plan.need + 1] < n + 2 * plan.band)
        near = np.unique((tight[:, None] + np.arange(plan.need)).ravel())
        places = self.places[name]
        diagonals = np.sort(np.array([int(at[i]) - place for i in near for place in places[key[i]]], np.int64))
        if not len(diagonals):
            return []
        starts = np.unique((np.unique(diagonals)[:, None] + np.arange(-plan.band, plan.band + 1)).ravel())
        votes = np.searchsorted(diagonals, starts + plan.band, "right") - np.searchsorted(diagonals, starts - plan.band, "left")
        return starts[votes >= plan.need].tolist()

    def _align(self, name: str, template: np.ndarray, ids: np.ndarray, start: int, band: int) -> Match | None:
        """Local alignment within ``band`` diagonals of the anchor (a quarter of the template at most): a word matched scores 2, one replaced, left out or put in -1."""
        t, doc = template.tolist(), ids
        width = 2 * band + 1
        before = [(0, -1, -1, 0)] * (width + 1)  # score, first word, last word, words matched
        best = (0, -1, -1, 0)
        for i, word in enumerate(t):
            row, left = [], (0, -1, -1, 0)
            for j in range(width):
                at = start - band + i + j
                cell = (0, -1, -1, 0)
                if 0 <= at < len(doc):
                    s, first, last, n = before[j]
                    if doc[at] == word:
                        cell = (s + 2, first if first >= 0 else at, at, n + 1)
                    elif s > 1:
                        cell = (s - 1, first, last, n)
                    if before[j + 1][0] - 1 > cell[0]:
                        s, *rest = before[j + 1]
                        cell = (s - 1, *rest)
                    if left[0] - 1 > cell[0]:
                        s, *rest = left
                        cell = (s - 1, *rest)
                row.append(cell)
                left = cell
                if cell[0] > best[0]:
                    best = cell
            before = [*row, (0, -1, -1, 0)]
        _, first, last, n = best
        return Match(name, first, last, n, n / len(t)) if n else None


def scan(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Mapping[str, str] = NOTICES,
    min_coverage: float = 0.8,
) -> DataFrame:
    """Rows (id, license, start, end, matched_words, template_words, coverage), one for each notice in each whole text.

    Words are runs of ASCII letters and digits, case apart; start and end are character positions, end exclusive. The index of
    the templates is broadcast (its size is that of ``templates``); nothing is shuffled. A null or empty text has no matches,
    repeated rows have theirs each, rows with a null id too. A notice that recurs is reported each time.
    """
    shared = df.sparkSession.sparkContext.broadcast(Index(templates, min_coverage))

    @F.pandas_udf("array<struct<license:string,start:int,end:int,matched_words:int,template_words:int,coverage:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        for texts in batches:
            yield pd.Series([_rows(index, t) for t in texts], dtype="object")

    found = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col), F.explode(run(F.col(text_col))).alias("_m"))
    return found.select(id_col, "_m.*")


def _rows(index: Index, text: str) -> list[dict]:
    data = text.encode("utf-8", "replace").lower()
    matches = index.find(index.ids(_WORD.findall(data)))
    if not matches:
        return []
    spans = [m.span() for m in _WORD.finditer(data)]
    chars = lambda at: len(data[:at].decode())
    return [
        {"license": m.license, "start": chars(spans[m.first_word][0]), "end": chars(spans[m.last_word][1]), "matched_words": m.matched, "template_words": len(index.templates[m.license]), "coverage": m.coverage}
        for m in matches
    ]
