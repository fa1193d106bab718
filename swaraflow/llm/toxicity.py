"""Toxicity by gradient-boosted trees over dense features, isotonically calibrated.

Features of a whole text: densities of a lexicon (a fixed seed list and words
learned from labelled rows), lexicon words near a second-person word, capitals,
exclamation and other punctuation, and words obfuscated by digits or signs.

The lexicon and the trees are learned from a bounded sample of labelled rows
(``labelled.BOUND``); a fifth of it, by hash of the id, is kept from both and
calibrates the trees (all of it teaches and calibrates where one of the parts has
labels of one kind only).  Without two classes of labels every score is the share
of toxic labels (0 where there are none).

Defined results: null texts score as empty ones; equal texts score alike, so ties
stay ties; repeated rows are each scored, and count once among the labelled ones;
further columns pass through, but one with the name of the score gives way; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, Isotonic
from .labelled import BOUND, both_classes, calibrating, training_rows
from .scoring import SLICE, with_score
from .words import LETTERS_ONLY, LOWER, OBFUSCATED

# fixed values: common English insults, and second-person words of the corpus' languages
SEED_WORDS = ("idiot", "moron", "stupid", "dumb", "fool", "loser", "trash", "garbage", "pathetic", "worthless", "disgusting", "scum", "clown", "hate", "ugly", "shut")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "du", "dich", "dein", "ihr", "tu", "toi", "vous", "te", "ti", "usted")
LOOKALIKE = bytes.maketrans(b"013457@$!", b"oieastasi")
NEAR = 5
LEXICON_SIZE = 200

FEATURES = ("log_words", "seed_rate", "learned_rate", "learned_hits", "distinct_hits", "weight_sum", "near_second_person", "second_person_rate", "capital_rate", "shout_rate", "punctuation_rate", "obfuscated_rate", "obfuscated_hits")
_UPPER = bytes(range(65, 91))
_PUNCTUATION = b".,;:!?'\"()-*&%$#@"


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters (any byte beyond ASCII counts as a letter)."""
    return text.translate(LOWER).translate(LETTERS_ONLY).split()


@dataclass(frozen=True)
class Lexicon:
    weights: dict[bytes, float]

    def features(self, text: bytes | None) -> list[float]:
        text = text or b""
        words = plain_words(text)
        n, size = max(1, len(words)), max(1, len(text))
        weights = self.weights
        hits = [w for w in words if w in weights]
        distinct = set(hits)
        you = sum(map(_YOU.__contains__, words))
        near = 0
        if hits and you:
            spots = [(i, w in _YOU) for i, w in enumerate(words) if w in weights or w in _YOU]
            lex = [i for i, is_you in spots if not is_you]
            yous = [i for i, is_you in spots if is_you]
            k = 0
            for i in lex:
                while k < len(yous) and yous[k] < i - NEAR:
                    k += 1
                near += k < len(yous) and yous[k] <= i + NEAR
        odd = OBFUSCATED.findall(text)
        odd_hits = sum(w in weights or w in _SEEDS for w in (x.translate(LOWER).translate(LOOKALIKE).translate(None, b"*._-@$!0123456789") for x in odd))
        return [
            math.log1p(len(words)),
            1000 * sum(map(_SEEDS.__contains__, words)) / n,
            1000 * len(hits) / n,
            len(hits),
            len(distinct),
            sum(weights[w] for w in distinct),
            near,
            1000 * you / n,
            (len(text) - len(text.translate(None, _UPPER))) / size,
            100 * text.count(b"!") / n,
            (len(text) - len(text.translate(None, _PUNCTUATION))) / size,
            100 * len(odd) / n,
            odd_hits,
        ]

    def matrix(self, texts: list[bytes | None]) -> np.ndarray:
        return np.array([self.features(t) for t in texts], float).reshape(-1, len(FEATURES))


_SEEDS = frozenset(w.encode() for w in SEED_WORDS)
_YOU = frozenset(w.encode() for w in SECOND_PERSON)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for y, text in zip(batch.column(0), batch.column(1), strict=True):
            counts[y.as_py() > 0].update(set(plain_words(text.as_py() or b"")))
    words = list(counts[0] | counts[1])
    yield pa.RecordBatch.from_arrays(
        [pa.array(words, pa.binary()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)], names=["word", "clean", "toxic"]
    )


def learn_lexicon(rows: DataFrame, size: int = LEXICON_SIZE) -> Lexicon:
    """The words of toxic rows with the highest smoothed log odds; ties by the word."""
    totals = rows.agg(F.sum(1 - F.signum("y")).alias("clean"), F.sum(F.signum("y")).alias("toxic")).first()
    clean, toxic = totals["clean"] or 0, totals["toxic"] or 0
    counts = rows.select("y", F.col("text").cast("binary")).mapInArrow(_word_counts, "word binary, clean bigint, toxic bigint")
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    found = (
        counts.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter(F.col("toxic") >= max(3, 0.01 * toxic)).withColumn("odds", odds).filter("odds > 1.5")
        .orderBy(F.desc(F.col("toxic") * F.col("odds")), "word").limit(size)
    )
    return Lexicon({bytes(r["word"]): float(r["odds"]) for r in found.collect()})


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    trees: BoostedTrees | None
    calibration: Isotonic | None
    share: float = 0.0

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        return np.clip(self.calibration(self.trees.raw(self.lexicon.matrix(texts))), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", id: str = "doc_id", text: str = "text", bound: int = BOUND) -> ToxicityModel:
    rows = training_rows(docs, labels, target, id, text, bound)
    marked = rows.select(F.col("id").cast("string").alias("id"), "y", calibrating().alias("held")).collect()
    parts = [np.array([r["y"] for r in marked if r["held"] == held]) for held in (False, True)]
    apart = all(map(both_classes, parts))
    lexicon = learn_lexicon(rows.filter(~calibrating()) if apart else rows)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, len(b), SLICE)):
            flat = pa.array(lexicon.matrix(batch.column(3).to_pylist()).reshape(-1))
            offsets = pa.array(np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.ListArray.from_arrays(offsets, flat)], names=["id", "y", "held", "x"])

    columns = rows.select(F.col("id").cast("string"), "y", calibrating().alias("held"), F.col("text").cast("binary"))
    got = columns.mapInArrow(measured, "id string, y int, held boolean, x array<double>").collect()
    got.sort(key=lambda r: r["id"])
    y = np.array([r["y"] > 0 for r in got], float)
    if not both_classes(y):
        return ToxicityModel(lexicon, None, None, float(y.mean()) if len(y) else 0.0)
    x = np.array([r["x"] for r in got], float)
    held = np.array([r["held"] for r in got]) if apart else np.ones(len(y), bool)
    taught = ~held if apart else held
    trees = BoostedTrees().fit(x[taught], y[taught])
    return ToxicityModel(lexicon, trees, Isotonic().fit(trees.raw(x[held]), y[held]))


def with_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score", keep_text: bool = True) -> DataFrame:
    return with_score(docs, model.score, text, name, keep_text)
