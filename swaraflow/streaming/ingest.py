"""Incremental ingest and monitoring on Structured Streaming.

The row operators are plain column transforms, so the batch form and the stream
form share them; a checkpoint gives restarts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import mixture


def ingest(spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Reads new Parquet files in micro-batches, applies ``transform`` and appends Parquet; ends when no file is left."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return transform(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def draw_stream(spark: SparkSession, sizes: Mapping[str, int], weights: Mapping[str, float], batch: int, seed: int = 0, rows_per_second: int = 100) -> DataFrame:
    """An endless stream of draws ``draw_no, window, source, idx``: the rate source's ordinal, permuted."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return mixture.with_draws(ticks.select(F.col("value").alias("draw_no")), sizes, weights, batch, seed)
