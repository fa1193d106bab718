"""A probabilistic pitch tracker (after the published pYIN method) for one waveform.

Each frame's cumulative mean normalized difference function has troughs; a threshold
drawn from a beta distribution picks the first trough below it, so a trough's
probability is the mass of the thresholds that pick it.  Viterbi decoding then finds
the likeliest path over pitch states, a tenth of a semitone apart and each voiced or
not, under a limit on how fast pitch moves.
"""

from __future__ import annotations

from functools import cache
from math import comb, log2

import numpy as np

# fixed values: C2 to C7; the method's own constants
LOW, HIGH = 65.40639132514966, 2093.004522404789
BINS_A_SEMITONE, OCTAVES_A_SECOND, SWITCH, NO_TROUGH = 10, 35.92, 0.01, 0.01
BETA = (2, 18)
TINY = 1e-12


def _mass(x: np.ndarray) -> np.ndarray:
    """The beta distribution's mass below x; whole parameters make it a binomial sum."""
    a, b = BETA
    n = a + b - 1
    x = np.clip(x, 0.0, 1.0)
    return 1.0 - sum(comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a))


def differences(frames: np.ndarray, longest: int) -> np.ndarray:
    """Cumulative mean normalized difference of each frame (a row of twice the window) for lags 0 to ``longest``."""
    width = frames.shape[1] // 2
    size = 2 * frames.shape[1]
    cross = np.fft.irfft(np.fft.rfft(frames, size) * np.conj(np.fft.rfft(frames[:, :width], size)), size)[:, : longest + 1]
    energy = np.concatenate([np.zeros((len(frames), 1)), np.cumsum(frames**2, axis=1)], axis=1)
    lags = np.arange(longest + 1)
    d = np.maximum(energy[:, [width]] + energy[:, lags + width] - energy[:, lags] - 2 * cross, 0.0)
    mean = np.cumsum(d[:, 1:], axis=1) / lags[1:]
    out = np.ones_like(d)
    out[:, 1:] = d[:, 1:] / np.maximum(mean, TINY)
    return out


def candidates(d: np.ndarray, shortest: int, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies of one frame's troughs and the probability of each."""
    inner = d[shortest:-1]
    at = np.flatnonzero((inner <= d[shortest - 1 : -2]) & (inner < d[shortest + 1 :])) + shortest
    if not len(at):
        return np.empty(0), np.empty(0)
    depth = np.minimum(d[at], 1.0)
    before = np.minimum.accumulate(np.concatenate([[1.0], depth[:-1]]))
    chances = np.maximum(_mass(before) - _mass(depth), 0.0)
    chances[depth.argmin()] += NO_TROUGH * _mass(depth.min()[None])[0]
    left, mid, right = d[at - 1], d[at], d[at + 1]
    bend = left - 2 * mid + right
    shift = np.where(bend > TINY, 0.5 * (left - right) / np.maximum(bend, TINY), 0.0)
    return rate / (at + np.clip(shift, -1, 1)), chances


@cache
def _moves(width: int) -> np.ndarray:
    """Logarithms of a triangle's chances of moving by up to ``width`` bins."""
    steps = width + 1 - np.abs(np.arange(-width, width + 1))
    return np.log(steps / steps.sum())


def _best_moves(score: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin the best score of a move to it, and where from."""
    padded = np.pad(score, width, constant_values=-np.inf)
    reached = np.lib.stride_tricks.sliding_window_view(padded, 2 * width + 1) + _moves(width)
    step = reached.argmax(axis=1)
    return reached[np.arange(len(score)), step], np.arange(len(score)) + step - width


def decoded(voiced: np.ndarray, width: int) -> np.ndarray:
    """The likeliest bin of each frame (a row of chances of voiced bins), -1 where unvoiced."""
    n = voiced.shape[1]
    unvoiced = (1.0 - np.minimum(voiced.sum(axis=1), 1.0)) / n
    seen = np.log(np.concatenate([voiced, np.repeat(unvoiced[:, None], n, axis=1)], axis=1) + TINY)
    stay, change = np.log(1 - SWITCH), np.log(SWITCH)
    score = seen[0] - np.log(2 * n)
    back = []
    for frame in seen[1:]:
        (a, from_a), (b, from_b) = _best_moves(score[:n], width), _best_moves(score[n:], width)
        to_voiced, to_unvoiced = b + change > a + stay, b + stay > a + change
        best = np.concatenate([np.where(to_voiced, b + change, a + stay), np.where(to_unvoiced, b + stay, a + change)])
        back.append(np.concatenate([np.where(to_voiced, from_b + n, from_a), np.where(to_unvoiced, from_b + n, from_a)]))
        score = best + frame
    state = int(score.argmax())
    path = [state]
    for pointers in reversed(back):
        state = int(pointers[state])
        path.append(state)
    path = np.array(path[::-1])
    return np.where(path < n, path, -1)


def track(samples: np.ndarray, rate: int, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """The pitch of each frame in Hz, NaN where unvoiced."""
    x = np.asarray(samples, np.float64)
    high = min(high, rate / 3)
    longest = int(np.ceil(rate / low))
    width = 1 << max(4, int(np.ceil(log2(2 * longest + 2))))
    hop = max(1, width // 2)
    if not len(x) or high <= low:
        return np.empty(0)
    padded = np.pad(x, width)
    frames = np.lib.stride_tricks.sliding_window_view(padded, 2 * width)[::hop]
    shortest = max(2, int(rate / high))
    n = int(np.floor(12 * BINS_A_SEMITONE * log2(high / low))) + 1
    voiced = np.zeros((len(frames), n))
    for k, d in enumerate(differences(frames, longest + 1)):
        if np.square(frames[k]).mean() < 1e-10:
            continue
        for f, p in zip(*candidates(d, shortest, rate), strict=True):
            at = round(12 * BINS_A_SEMITONE * log2(f / low)) if f > 0 else -1
            if 0 <= at < n:
                voiced[k, at] += p
    bins = decoded(voiced, max(1, round(OCTAVES_A_SECOND * 12 * BINS_A_SEMITONE * hop / rate)))
    return np.where(bins < 0, np.nan, low * 2.0 ** (bins / (12 * BINS_A_SEMITONE)))
