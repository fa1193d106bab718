"""Training batches in draw order, padded within the batch, readable one by one.

Draws are grouped by batch and padded to the longest example of their own batch.
Batches are dealt by ranges of their number and written as messages of Arrow's IPC
format, one for each batch, into shards of bounded size.  A table, itself Parquet
sorted by batch, has the shard, offset and length of each message, so any batch is
one ranged read, and a trainer that starts again begins where it left off.

Attempts of a task write shards of their own; the table, which Spark commits, names
those that count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..sources.tables import new_place, written

SHARD_BYTES = 128 << 20
EXAMPLES = pa.schema([("draw_no", pa.int64()), *((n, pa.list_(pa.int32())) for n in ("input_ids", "labels", "attention_mask"))])
INDEX = "batch bigint, shard string, offset bigint, length bigint, rows int, width int"


def collated(drawn: DataFrame, size: int, pad_id: int) -> DataFrame:
    """``batch, width, rows`` from ``draw_no, input_ids, labels``: the draws of each batch in order, all of the batch's width."""
    grouped = drawn.groupBy(F.floor(F.col("draw_no") / size).cast("long").alias("batch")).agg(
        F.max(F.size("input_ids")).alias("width"), F.sort_array(F.collect_list(F.struct(F.col("draw_no").cast("long").alias("draw_no"), "input_ids", "labels"))).alias("examples")
    )

    def filled(e):
        ids = e["input_ids"]
        mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.col("width") - F.size(ids)))
        return F.struct(e["draw_no"].alias("draw_no"), K.padded(ids, F.col("width"), pad_id).alias("input_ids"), K.padded(e["labels"], F.col("width"), K.IGNORED).alias("labels"), mask.alias("attention_mask"))

    return grouped.select("batch", "width", F.transform("examples", filled).alias("rows"))


def write_batches(batches: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards of :func:`collated` and returns their table (``INDEX``).

    ``folder`` must be one that Arrow opens on all executors.
    """
    folder = folder or new_place(batches, "batches")
    dealt = batches.repartitionByRange("batch").sortWithinPartitions("batch")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out = name = None
        offset = 0
        try:
            for part in parts:
                index = []
                for batch, width, rows in zip(*(part.column(i) for i in range(3)), strict=True):
                    if out is None:
                        name, offset = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.arrow", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    values = rows.values
                    message = pa.RecordBatch.from_arrays([values.field(f.name).cast(f.type) for f in EXAMPLES], schema=EXAMPLES).serialize()
                    out.write(message)
                    index.append((batch.as_py(), f"{folder}/{name}", offset, message.size, len(values), width.as_py()))
                    offset += message.size
                    if offset >= shard_bytes:
                        out.close()
                        out = None
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*index, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")]).cast(pa.schema([("batch", pa.int64()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("rows", pa.int32()), ("width", pa.int32())]))
        finally:
            if out is not None:
                out.close()

    return written(dealt.mapInArrow(write, INDEX), "batch-index")


def _message(row) -> pa.RecordBatch:
    store, at = pa.fs.FileSystem.from_uri(row["shard"])
    with store.open_input_file(at) as source:
        return pa.ipc.read_record_batch(pa.py_buffer(source.read_at(row["length"], row["offset"])), EXAMPLES)


def batch(index: DataFrame, number: int) -> pa.RecordBatch | None:
    """One batch by its number: a filter that reaches the table's scan, and one ranged read."""
    row = index.filter(F.col("batch") == number).first()
    return None if row is None else _message(row)


def read_batches(index: DataFrame) -> DataFrame:
    """``batch`` and the examples' columns of all batches that ``index`` (or a part of it) names."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                found = _message(row)
                yield pa.RecordBatch.from_arrays([pa.array([row["batch"]] * len(found), pa.int64()), *found.columns], names=["batch", *EXAMPLES.names])

    kinds = "batch bigint, draw_no bigint, input_ids array<int>, labels array<int>, attention_mask array<int>"
    return index.select("batch", "shard", "offset", "length").mapInArrow(read, kinds)
