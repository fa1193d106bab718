"""Windows of many rows, brought together to even batches for a model and put back by row.

A model is fast on full batches, but rows have few windows or many.  Each task takes
its rows as they come, cuts them, and hands the model batches of exactly the wanted
number of windows, whichever rows these are of; only the last batch of a task is
shorter.  A row goes on when its last window has come back, so a task holds a batch
and the rows that it touches.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: (windows, rate) -> a vector for each window.
Model = Callable[[Sequence[np.ndarray], int], Sequence[np.ndarray]]


def cut(samples: np.ndarray, width: int, least: int) -> list[np.ndarray]:
    """Windows side by side from the start; what doesn't fill one is left out, but for a row that is shorter than one and not than ``least``."""
    if len(samples) < width:
        return [samples] if len(samples) >= least else []
    return [samples[i : i + width] for i in range(0, len(samples) - width + 1, width)]


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b) / size) if size else 0.0


def _in_batches(rows: Iterator[pd.DataFrame], samples: str, width: int, least: int, batch: int, model: Model, rate: int) -> Iterator[tuple[pd.Series, list[np.ndarray]]]:
    """Each row with its windows' vectors, in order."""
    open_rows: deque[tuple[pd.Series, int, list[np.ndarray]]] = deque()
    waiting: deque[tuple[list[np.ndarray], np.ndarray]] = deque()

    def ask(n: int) -> None:
        asked = [waiting.popleft() for _ in range(n)]
        for (home, _), vector in zip(asked, model([w for _, w in asked], rate), strict=True):
            home.append(np.asarray(vector, np.float64))

    for part in rows:
        for row, x in zip(part.to_dict("records"), part[samples], strict=True):
            windows = [] if x is None else cut(np.asarray(x), width, least)
            home: list[np.ndarray] = []
            open_rows.append((row, len(windows), home))
            waiting.extend((home, w) for w in windows)
            while len(waiting) >= batch:
                ask(batch)
            while open_rows and len(open_rows[0][2]) == open_rows[0][1]:
                row, _, home = open_rows.popleft()
                yield row, home
    if waiting:
        ask(len(waiting))
    for row, _, home in open_rows:
        yield row, home


def similarity_trajectory(
    rows: DataFrame, factory: Callable[[], Model], rate: int, window_s: float = 5.0, least_s: float = 1.0, batch: int = 32, samples: str = "samples", reference: str = "reference", keep_samples: bool = False
) -> DataFrame:
    """``rows`` with ``similarities`` (cosine of each window's vector to the row's reference) and ``similarity_drop`` (first less last, 0 for fewer than two).

    A row without samples or reference has no similarities; a vector of no length is
    alike to nothing (0).  ``factory`` makes the model once for each task.
    """
    width, least = int(rate * window_s), max(1, int(rate * least_s))
    kept = [f for f in rows.schema if keep_samples or f.name != samples]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "similarities array<double>, similarity_drop double"])
    names = [f.name for f in kept]

    def follow(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        columns = [*names, "similarities", "similarity_drop"]
        for row, vectors in _in_batches(parts, samples, width, least, batch, factory(), rate):
            base = None if row[reference] is None else np.asarray(row[reference], np.float64)
            path = [] if base is None else [cosine(v, base) for v in vectors]
            out.append((*(row[n] for n in names), path, path[0] - path[-1] if len(path) > 1 else 0.0))
            if len(out) == 256:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(follow, schema)
