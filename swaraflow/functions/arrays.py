"""Array expressions of the evaluation metrics. All stay in the JVM unless said."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` and its lambdas use it.

    Without it an array that is itself an expression is computed anew for each
    element that a lambda looks up.
    """
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def unit_vector(a: Column) -> Column:
    """Zero vectors stay as they are."""
    scaled = lambda s: F.transform(s["a"], lambda x: F.when(s["norm"] > 0, x.cast("double") / s["norm"]).otherwise(F.lit(0.0)))
    return let(F.struct(a.alias("a"), F.sqrt(dot(a, a)).alias("norm")), scaled)


def ngrams(tokens: Column, n: int) -> Column:
    # sequence() counts down when the end is below the start
    return F.when(F.size(tokens) < n, F.array().cast("array<array<int>>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.slice(tokens, i, n).cast("array<int>"))
    )


def repetition_rate(tokens: Column, n: int) -> Column:
    """1 - distinct n-grams / n-grams; 0 for fewer than n tokens."""
    rate = lambda grams: F.when(F.size(grams) == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(grams)) / F.greatest(F.size(grams), F.lit(1)))
    return let(tokens, lambda t: let(ngrams(t, n), rate))


def fraction_unique(values: Column) -> Column:
    return F.size(F.array_distinct(values)) / F.greatest(F.size(values), F.lit(1))


def frames(samples: Column, window: int, hop: int) -> Column:
    """Windows of ``window`` samples every ``hop``, the last start before the last full window; at least one."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.size(samples) - window) - 1, F.lit(hop))
    return F.transform(starts, lambda i: F.slice(samples, i + 1, window))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(values)


_DELETED, _REPLACED = 1 << 20, 1 << 40


#: Cells of the alignments that are made together, and words that are held for them.
CELLS, WORDS = 1 << 14, 1 << 16


def _aligned(refs: list[np.ndarray], hyps: list[np.ndarray]) -> np.ndarray:
    """The packed counts of pairs of word numbers, the longest reference first; a row of all pairs' tables at once."""
    lengths, ends = np.array([len(r) for r in refs]), np.array([len(h) for h in hyps])
    width = int(ends.max())
    ref, firsts, hyp = np.concatenate(refs), np.cumsum(lengths) - lengths, np.full((len(hyps), width), -1, np.int32)
    for k, h in enumerate(hyps):
        hyp[k, : len(h)] = h
    across = np.arange(width + 1)
    cost = np.repeat(across[None, :], len(refs), axis=0)
    counts, found = cost.copy(), np.empty(len(refs), np.int64)
    for i in range(int(lengths[0]) + 1):
        left = int(np.searchsorted(-lengths, -i))  # pairs with more than i words; the others of those held are through
        through = np.arange(left, len(cost))
        found[through] = counts[through, ends[through]]
        if not left:
            break
        cost, counts = cost[:left], counts[:left]
        same = hyp[:left] == ref[firsts[:left] + i, None]
        below, slanted = cost + 1, cost[:, :-1] + ~same
        row = below.copy()
        np.minimum(row[:, 1:], slanted, out=row[:, 1:])
        row = np.minimum.accumulate(row - across, axis=1) + across
        made = counts + _DELETED
        inserted = row != below
        diagonal = row[:, 1:] == slanted
        made[:, 1:] = np.where(diagonal, counts[:, :-1] + np.where(same, 0, _REPLACED), made[:, 1:])
        inserted[:, 1:] &= ~diagonal
        # an inserted cell counts on from the last one to its left that isn't
        source = np.maximum.accumulate(np.where(inserted, 0, across), axis=1)
        cost, counts = row, np.take_along_axis(made, source, axis=1) + (across - source)
    return found


def edit_table(pairs: list[tuple[list[str], list[str]]]) -> np.ndarray:
    """Insertions, deletions, substitutions and hits of one minimal alignment of each pair, a row each, in memory of ``CELLS`` or one row of a table.

    Each cell prefers a match to a substitution, that to a deletion, that to an
    insertion; the sum of the edits doesn't depend on it.  The three counts of a
    cell travel packed in one integer, so texts are held below 2^20 words a side.
    Pairs with hypotheses of like length are aligned together.
    """
    if any(max(len(r), len(h)) >= 1 << 20 for r, h in pairs):
        raise ValueError("texts of a million words and more aren't aligned")
    known: dict[str, int] = {}
    number = lambda words: np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
    sides = [(number(r), number(h)) for r, h in pairs]
    packed, by_width, start = np.empty(len(pairs), np.int64), sorted(range(len(pairs)), key=lambda k: len(sides[k][1])), 0
    while start < len(by_width):
        stop = start + 1
        while stop < len(by_width) and (stop + 1 - start) * (len(sides[by_width[stop]][1]) + 1) <= CELLS:
            stop += 1
        own = sorted(by_width[start:stop], key=lambda k: -len(sides[k][0]))
        packed[own], start = _aligned([sides[k][0] for k in own], [sides[k][1] for k in own]), stop
    inserted, deleted, replaced = packed % _DELETED, packed // _DELETED % _DELETED, packed // _REPLACED
    return np.stack([inserted, deleted, replaced, np.array([len(r) for r, _ in pairs], np.int64) - deleted - replaced], axis=1)


def edit_counts(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int, int]:
    """:func:`edit_table` of one pair."""
    return tuple(map(int, edit_table([(reference, hypothesis)])[0]))


def zipped(a: Column, b: Column) -> Column:
    """Pairs of two arrays by position, as far as the shorter one goes: an array of structs ``left, right``."""
    both = lambda s: F.zip_with(F.slice(s["a"], 1, s["n"]), F.slice(s["b"], 1, s["n"]), lambda x, y: F.struct(x.alias("left"), y.alias("right")))
    return let(F.struct(a.alias("a"), b.alias("b"), F.least(F.size(a), F.size(b)).alias("n")), both)


EDITS = StructType([StructField(n, IntegerType()) for n in ("insertions", "deletions", "substitutions", "hits", "ref_words")])


@F.pandas_udf(EDITS)
def word_edits(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Edit counts of two texts, word by word (white space parts words; null is no text)."""
    names = ["insertions", "deletions", "substitutions", "hits"]
    for refs, hyps in pairs:
        tables, held, words = [np.empty((0, 4), np.int64)], [], 0
        for r, h in zip(refs, hyps, strict=True):
            held.append(((r or "").split(), (h or "").split()))
            words += len(held[-1][0]) + len(held[-1][1])
            if words >= WORDS:
                tables.append(edit_table(held))
                held, words = [], 0
        out = pd.DataFrame(np.concatenate([*tables, edit_table(held)] if held else tables), columns=names)
        out["ref_words"] = out["hits"] + out["substitutions"] + out["deletions"]
        yield out


def utterance_wer(edits: Column) -> Column:
    """Edits over reference words; 0 for a blank reference."""
    wrong = edits["insertions"] + edits["deletions"] + edits["substitutions"]
    return F.when(edits["ref_words"] == 0, F.lit(0.0)).otherwise(wrong / F.greatest(edits["ref_words"], F.lit(1)))
