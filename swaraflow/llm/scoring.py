"""Adds a fitted model's scores to documents, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import trimmed
from .names import giving_way

#: Rows of a slice: a worker holds the texts of one slice as Python objects.
SLICE = 256


def with_score(docs: DataFrame, score: Callable[[list[bytes | None]], np.ndarray], text: str = "text", name: str = "score", keep_text: bool = True) -> DataFrame:
    """``docs``, all its columns kept, with a double column ``name``; an older one of that name, in whatever case, gives way.

    The text crosses to Python once, as bytes, and back only if it is kept.
    """
    stay = giving_way(docs.columns, [name])
    text = next((c for c in docs.columns if c == text), None) or next(c for c in docs.columns if c.casefold() == text.casefold())
    columns = [c for c in docs.columns if c in stay or c == text]
    at = columns.index(text)
    back = [c for c in stay if keep_text or c != text]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, len(b), SLICE)):
            values = score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in back), pa.array(values, pa.float64())], names=[*back, name])

    kinds = {f.name: f.dataType for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {'binary' if c == text else kinds[c].simpleString()}" for c in back), f"`{name}` double"])
    sent = docs.select(*(F.col(f"`{c}`").cast("binary") if c == text else F.col(f"`{c}`") for c in columns)).toDF(*columns)
    found = sent.mapInArrow(trimmed(scored), schema)
    return found.select(*(F.col(f"`{c}`").cast(kinds[c]).alias(c) if c == text else F.col(f"`{c}`") for c in back), F.col(f"`{name}`"))
