"""Document quality by a regularised quadratic discriminant.

Each whole text gives a vector of transformed statistics.  Per class (0 and 1)
the mean and a covariance are fitted; the covariance is shrunk towards the
diagonal of the pooled one, so that a statistic which is constant within a class
can't make it singular.  A score is the difference of the two Mahalanobis
log densities, computed from Cholesky factors inverted once per fit, mapped to
0..1 by a logistic curve.  All is fitted to a bounded sample of labelled rows
(``labelled.BOUND``).  The curve is fitted to ratios that each fifth of the rows,
by hash of the id, gets from densities of the other four, so no row is calibrated
by itself (by itself where a part has fewer than two rows of a class).  With fewer
than two rows of a class in all every score is the share of good labels (1 where
there are none, so that nothing is dropped).

Defined results: null texts score as empty ones; equal texts score alike, so ties
stay ties; repeated rows are each scored, and count once among the labelled ones;
further columns pass through, but one with the name of the score gives way; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .labelled import BOUND, both_classes, calibration_part, training_rows
from .scoring import SLICE, with_score

STATISTICS = ("log_words", "word_length", "symbol_rate", "duplicate_lines", "repeated_runs", "same_as_previous", "distinct_share", "top_share", "capitals", "shouts", "digits", "line_words")
SHRINKAGE = 0.3
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"


def statistics(text: bytes | None) -> list[float]:
    text = text or b""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    without = lambda drop: len(text) - len(text.translate(None, drop))
    return [
        math.log1p(len(words)),
        math.log1p(W.word_chars(text) / n),
        math.log1p(20 * W.symbols(text) / n),
        math.sqrt(W.duplicate_lines(text) / n),
        math.sqrt(W.repeated_words(words) / n),
        math.sqrt(same / n),
        math.log((len(counts) + 1) / (n + 1)) / math.log(n + 2),
        math.sqrt(max(counts.values(), default=0) / n),
        math.sqrt(without(_UPPER) / size),
        math.log1p(20 * text.count(b"!") / n),
        math.sqrt(without(_DIGITS) / size),
        math.log1p(n / (1 + text.count(b"\n"))),
    ]


def matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(STATISTICS))


@dataclass(frozen=True)
class QualityModel:
    means: np.ndarray | None  # of class 0 and 1
    factors: np.ndarray | None  # inverse Cholesky factors of the covariances
    log_dets: np.ndarray | None
    slope: float = 0.0
    offset: float = 0.0
    share: float = 1.0

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        density = [-0.5 * (np.square((x - m) @ f.T).sum(axis=1) + d) for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        return np.clip(density[1] - density[0], -60, 60)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if self.means is None:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-(self.slope * self.log_ratio(matrix(texts)) + self.offset)))


def _logistic(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope (0.01 at least, so that order is kept) and offset by ridged Newton steps."""
    a, b = 0.1, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g = np.array([((p - y) * z).sum() + 0.1 * a, (p - y).sum()])
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum()]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(0.01, a - step[0]), b - step[1]
    return float(a), float(b)


def densities(x: np.ndarray, y: np.ndarray, shrinkage: float = SHRINKAGE) -> QualityModel:
    """The two classes' means, and inverse Cholesky factors and log determinants of their shrunk covariances."""
    parts = [x[y == k] for k in (0, 1)]
    spread = np.maximum(sum(np.cov(p.T, bias=True) * len(p) for p in parts).diagonal() / len(x), 1e-4)
    means, factors, dets = [], [], []
    for p in parts:
        c = (1 - shrinkage) * np.cov(p.T, bias=True) + shrinkage * np.diag(spread)
        low = np.linalg.cholesky(c)
        means.append(p.mean(axis=0))
        factors.append(np.linalg.inv(low))
        dets.append(2 * np.log(low.diagonal()).sum())
    return QualityModel(np.array(means), np.array(factors), np.array(dets))


def fit_matrix(x: np.ndarray, y: np.ndarray, part: np.ndarray, shrinkage: float = SHRINKAGE) -> QualityModel:
    """``part`` numbers the parts of the rows."""
    if not both_classes(y, 2):
        return QualityModel(None, None, None, share=float(y.mean()) if len(y) else 1.0)
    model = densities(x, y, shrinkage)
    ratio = model.log_ratio(x)
    parts = np.unique(part)
    if len(parts) > 1 and all(both_classes(y[part != k], 2) for k in parts):
        for k in parts:
            ratio[part == k] = densities(x[part != k], y[part != k], shrinkage).log_ratio(x[part == k])
    slope, offset = _logistic(ratio, y)
    return replace(model, slope=slope, offset=offset)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, SLICE) for b in batches for i in range(0, len(b), SLICE)):
        flat = pa.array(matrix(batch.column(3).to_pylist()).reshape(-1))
        offsets = pa.array(np.arange(0, len(flat) + 1, len(STATISTICS), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.ListArray.from_arrays(offsets, flat)], names=["id", "y", "part", "x"])


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", id: str = "doc_id", text: str = "text", bound: int = BOUND) -> QualityModel:
    rows = training_rows(docs, labels, target, id, text, bound).select(F.col("id").cast("string"), "y", calibration_part().alias("part"), F.col("text").cast("binary"))
    got = rows.mapInArrow(_measured, "id string, y int, part int, x array<double>").collect()
    got.sort(key=lambda r: r["id"])
    x = np.array([r["x"] for r in got], float).reshape(-1, len(STATISTICS))
    return fit_matrix(x, np.array([r["y"] > 0 for r in got], float), np.array([r["part"] for r in got], int))


def with_quality(docs: DataFrame, model: QualityModel, text: str = "text", name: str = "score", keep_text: bool = True) -> DataFrame:
    return with_score(docs, model.score, text, name, keep_text)
