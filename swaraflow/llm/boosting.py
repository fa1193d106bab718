"""Gradient-boosted trees on binned features, and isotonic calibration, in NumPy.

Small on purpose: fits run on the driver over a bounded sample, the fitted model
is a few arrays that travel with the scoring function.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Logistic-loss boosting with trees of one fixed depth, stored as heaps."""

    trees: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 64
    ridge: float = 1.0
    least_weight: float = 2.0
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    features: np.ndarray = field(default_factory=lambda: np.empty(0))
    cuts: np.ndarray = field(default_factory=lambda: np.empty(0))
    leaves: np.ndarray = field(default_factory=lambda: np.empty(0))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) if n else np.empty(0) for j in range(d)]
        binned = self._binned(x)
        share = (y.sum() + 1.0) / (n + 2.0)
        self.base = float(np.log(share / (1 - share)))
        inner, outer = (1 << self.depth) - 1, 1 << self.depth
        self.features = np.zeros((self.trees, inner), np.int64)
        self.cuts = np.full((self.trees, inner), self.bins, np.int64)
        self.leaves = np.zeros((self.trees, outer))
        score = np.full(n, self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                best = np.zeros(width)
                for j in range(d):
                    at = node * self.bins + binned[:, j]
                    gs = np.bincount(at, g, width * self.bins).reshape(width, -1).cumsum(1)
                    hs = np.bincount(at, h, width * self.bins).reshape(width, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hs < self.least_weight) | (ht - hs < self.least_weight)] = 0
                    cut = gain.argmax(1)
                    top = gain[np.arange(width), cut]
                    for k in np.flatnonzero(top > best + 1e-9):
                        best[k] = top[k]
                        self.features[t, first + k], self.cuts[t, first + k] = j, cut[k]
                heap = first + node
                node = 2 * node + (binned[np.arange(n), self.features[t, heap]] > self.cuts[t, heap])
            gs, hs = np.bincount(node, g, outer), np.bincount(node, h, outer)
            self.leaves[t] = -self.rate * gs / (hs + self.ridge)
            score += self.leaves[t, node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._binned(x), np.arange(len(x))
        score = np.full(len(x), self.base)
        for t in range(len(self.leaves)):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                heap = (1 << level) - 1 + node
                node = 2 * node + (binned[rows, self.features[t, heap]] > self.cuts[t, heap])
            score += self.leaves[t, node]
        return score


@dataclass
class Isotonic:
    """Pool-adjacent-violators fit; values between knots are interpolated."""

    knots: np.ndarray = field(default_factory=lambda: np.zeros(1))
    values: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # weight, sum of labels, sum of scores
        for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([1.0, v, s])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                w, v1, s1 = blocks.pop()
                blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + v1, blocks[-1][2] + s1]
        if blocks:
            self.knots = np.array([s / w for w, _, s in blocks])
            self.values = np.array([v / w for w, v, _ in blocks])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.knots, self.values)
