"""Labelled training rows: a bounded, reproducible sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: About so many labelled documents are fitted on; more are thinned by a hash of their id.
BOUND = 20_000
FOLDS = 5


def fold(id: str):
    return F.crc32(F.col(id).cast("string")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, target: str, id: str = "doc_id", text: str = "text", bound: int = BOUND) -> DataFrame:
    """``id, y, text`` of labelled rows outside fold 0, at most about ``bound`` ids.

    An id with several labels takes the greatest, one with several texts the
    least text, so repeated rows can't outgrow the bound; null ids, labels and
    texts don't count.
    """
    rows = labels.select(F.col(id).alias("id"), F.col(target).cast("int").alias("y")).dropna().filter(fold("id") != 0)
    rows = rows.groupBy("id").agg(F.max("y").alias("y"))
    n = rows.count()
    if n > bound:
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(bound / n * (1 << 30))))
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    joined = texts.join(F.broadcast(rows), "id")  # the bound keeps this side to a few hundred kilobytes
    return materialize(joined.groupBy("id", "y").agg(F.min("text").alias("text")), "labelled")


def calibration_part(id: str = "id"):
    """One of five parts of the training rows, by a hash of the id."""
    return (F.crc32(F.concat(F.lit("calibrate"), F.col(id).cast("string"))) % 5).cast("int")


def calibrating(id: str = "id"):
    """The part that calibrates and teaches nothing else."""
    return calibration_part(id) == 0


def both_classes(y: np.ndarray, least: int = 1) -> bool:
    return min((y > 0).sum(), (y <= 0).sum()) >= least
