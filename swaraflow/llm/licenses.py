"""License notices found by MinHash bands over overlapping windows.

Templates of n shingles (five words each) are grouped into classes by the next
power of two L >= n.  Texts' shingles are cut into blocks of L, and every three
neighbouring blocks form a window of 3L, so any run of 2L + 1 shingles lies within
one window: a notice may be stretched by insertions to twice its length.  A window
that holds 80 % of a template, k = ceil(0.8 n) shingles, is similar to it by
J >= k / (3L + n - k).  Each class gets so many bands of one circulant MinHash
coordinate that (1 - J) ** bands <= 1e-9 for its templates, so windows that matter
share a band with their template but for one in a thousand million.  What is
retrieved is verified exactly, within one text: the share of the template's
shingles that the window holds.

A template of fewer than five words is one shingle of as many words, and every
place where a text has these words is looked up exactly.

The texts of a batch are laid end to end, so that NumPy works on long arrays; a
window over the seam of two texts is verified for each of them.

Words are runs of letters, digits and bytes beyond ASCII, lower-cased, so that
punctuation and line breaks don't matter.

Defined results: null and empty texts give no rows; a text gives one row for each
occurrence of a template, in order of their first words; of verified windows whose
occurrences overlap the one with the higher containment counts (ties: the first);
occurrences that lie in one window are told apart where the template's order
starts again, and one whose order is mixed up counts as a whole; a template
without words never matches; repeated rows give repeated results; the columns of
the input other than id and text are ignored; an empty table, or no templates,
gives an empty table.
"""

from __future__ import annotations

import math
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER

SHINGLE = 5
MISS = 1e-9
UNIVERSE_BITS = 20
SEED = 47
THRESHOLD = 0.8
#: Blocks of a window.
WINDOW = 3

# fixed values: standard notices of public licenses
TEMPLATES: dict[str, str] = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_BLANK = bytes(x for x in range(128) if not chr(x).isalnum())
_WORDS = bytes.maketrans(_BLANK, b" " * len(_BLANK))
_MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


@cache
def _memo() -> _Hashes:
    return _Hashes()


@cache
def _slices(width: int) -> np.ndarray:
    """Row x: the coordinates of universe position x, a shift of one permutation."""
    universe = np.random.default_rng(SEED).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
    return sliding_window_view(np.concatenate([universe, universe[: width - 1]]), width)


def word_run(text: bytes | None) -> np.ndarray:
    """The hashes of the text's words, in order."""
    words = (text or b"").translate(LOWER).translate(_WORDS).split()
    return np.array(list(map(_memo().__getitem__, words)), np.uint64)


def grams(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The hashes of all runs of ``n`` words."""
    last = len(h) - n + 1
    if last < 1:
        return np.empty(0, np.uint64)
    out = h[:last].copy()
    for i in range(1, n):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(_MIX1) + h[i : i + last]
    return (out ^ (out >> np.uint64(29))) * np.uint64(_MIX2)


def shingle_run(text: bytes | None) -> np.ndarray:
    """The hashes of the text's shingles, in order."""
    return grams(word_run(text))


def _positions(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)


def bands_needed(n: int, length: int, threshold: float) -> int:
    """Bands that retrieve a window with ``threshold`` of a template's n shingles, but for a chance of ``MISS``."""
    held = math.ceil(threshold * n - 1e-9)
    return math.ceil(math.log(MISS) / math.log1p(-held / (WINDOW * length + n - held)))


class Scanner:
    """The templates' bands and shingle sets, by class."""

    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.names = sorted(templates)
        runs = {n: word_run(templates[n].encode()) for n in self.names}
        #: Of each length below a shingle's: its templates by hash.
        self.short: dict[int, dict[int, str]] = defaultdict(dict)
        for n, words in runs.items():
            if 0 < len(words) < SHINGLE:
                self.short[len(words)].setdefault(int(grams(words, len(words))[0]), n)
        #: Of each template: its shingles in order, and as a set.
        self.orders = [grams(runs[n]) for n in self.names]
        self.sets = [np.unique(x) for x in self.orders]
        classes = defaultdict(list)
        for t, s in enumerate(self.sets):
            if len(s):
                classes[1 << (len(s) - 1).bit_length()].append(t)
        #: Of each class: its templates, their signatures, and a table of marks of the values that any of them has.
        self.classes: dict[int, tuple[list[int], np.ndarray, np.ndarray]] = {}
        for length, members in sorted(classes.items()):
            bands = max(bands_needed(len(self.sets[t]), length, threshold) for t in members)
            signatures = np.stack([_slices(bands)[_positions(self.sets[t])].min(axis=0) for t in members])
            marks = np.zeros(1 << UNIVERSE_BITS, bool)
            marks[signatures.reshape(-1)] = True
            self.classes[length] = (members, signatures, marks)
        self.width = max((s.shape[1] for _, s, _ in self.classes.values()), default=1)

    def retrieved(self, run: np.ndarray, step: int = 8_192) -> Iterator[tuple[int, int, int]]:
        """Template, start and end of each window that shares a band with the template."""
        longest = max(self.classes, default=1)
        step = max(longest, step // longest * longest)
        for base in range(0, len(run) if self.classes else 0, step):
            # the blocks at the base of the next part close this part's last windows
            part = run[base : base + step + (WINDOW - 1) * longest]
            blocks, length = _slices(self.width)[_positions(part)], 1
            while True:
                if length in self.classes:
                    members, signatures, marks = self.classes[length]
                    own = blocks[:, : signatures.shape[1]]
                    windows = own[: step // length].copy()
                    for k in range(1, WINDOW):
                        later = own[k : k + len(windows)]
                        np.minimum(windows[: len(later)], later, out=windows[: len(later)])
                    for w in np.flatnonzero(marks[windows].any(axis=1)).tolist():
                        for t in np.flatnonzero((signatures == windows[w]).any(axis=1)).tolist():
                            start = base + w * length
                            yield members[t], start, min(len(run), start + WINDOW * length)
                if length == longest:
                    break
                odd = blocks[len(blocks) // 2 * 2 :]
                blocks, length = np.concatenate([np.minimum(blocks[0:-1:2], blocks[1::2]), odd]), 2 * length

    def occurrences(self, t: int, part: np.ndarray) -> list[tuple[float, int, int]]:
        """Containment, first shingle and number of words of the occurrences of template ``t`` in a window."""
        wanted, order = self.sets[t], self.orders[t]
        at = np.flatnonzero(np.isin(part, wanted))
        share = lambda i: len(np.unique(part[i])) / len(wanted)
        if not len(at) or share(at) < self.threshold:
            return []
        sort = np.argsort(order, kind="stable")
        places = sort[np.searchsorted(order[sort], part[at])]  # where in the template a shingle stands first
        again = np.flatnonzero(places[1:] <= places[:-1]) + 1
        pieces = [i for i in np.split(at, again) if share(i) >= self.threshold] or [at]
        return [(share(i), int(i[0]), int(i[-1] - i[0]) + SHINGLE) for i in pieces]

    def scan_all(self, texts: Sequence[bytes | None]) -> list[list[tuple[str, float, int, int]]]:
        """Per text the name, containment, first word and number of words of each occurrence of a template."""
        words = [word_run(t) for t in texts]
        runs = [grams(w) for w in words]
        ends = np.cumsum([len(r) for r in runs])
        found: list[set[tuple[str, float, int, int]]] = [set() for _ in texts]
        for t, start, end in self.retrieved(np.concatenate(runs) if runs else np.empty(0, np.uint64)):
            i = int(np.searchsorted(ends, start, side="right"))
            while i < len(runs) and ends[i] - len(runs[i]) < end:
                offset = int(ends[i]) - len(runs[i])
                first = max(start - offset, 0)
                found[i].update((self.names[t], share, first + at, n) for share, at, n in self.occurrences(t, runs[i][first : end - offset]))
                i += 1
        for i, w in enumerate(words):
            for k, names in self.short.items():
                hashes = grams(w, k)
                for at in np.flatnonzero(np.isin(hashes, np.array(list(names), np.uint64))).tolist():
                    found[i].add((names[int(hashes[at])], 1.0, at, k))
        return [disjoint(f) for f in found]

    def scan(self, text: bytes | None) -> list[tuple[str, float, int, int]]:
        return self.scan_all([text])[0]


def disjoint(found: set[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
    """Of overlapping occurrences of one template the one of the highest containment, then the first and shortest."""
    kept: dict[str, list[tuple[int, int, float]]] = defaultdict(list)  # by first word
    for name, share, first, n in sorted(found, key=lambda h: (-h[1], h[2], h[3])):
        i = bisect(kept[name], (first, math.inf))
        clear = (i == 0 or sum(kept[name][i - 1][:2]) <= first) and (i == len(kept[name]) or first + n <= kept[name][i][0])
        if clear:
            kept[name].insert(i, (first, n, share))
    return sorted(((name, share, first, n) for name, hits in kept.items() for first, n, share in hits), key=lambda h: (h[2], h[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id, license, containment, first_word, n_words``; an id column called like one of the others comes as ``<its name>_id``."""
    templates = TEMPLATES if templates is None else templates
    back = f"{id}_id" if id.casefold() in ("license", "containment", "first_word", "n_words") else id
    kind = docs.schema[id].dataType.simpleString()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in (b.slice(i, 64) for b in batches for i in range(0, len(b), 64)):
            found = scanner.scan_all(batch.column(1).to_pylist())
            rows = [(i, *hit) for i, hits in zip(batch.column(0), found, strict=True) for hit in hits]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (batch.schema.field(0).type, pa.string(), pa.float64(), pa.int64(), pa.int64())
            values = [[x.as_py() for x in columns[0]], *columns[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[back, "license", "containment", "first_word", "n_words"])

    return docs.select(F.col(id), F.col(text).cast("binary")).mapInArrow(scanned, f"`{back}` {kind}, license string, containment double, first_word bigint, n_words bigint")
