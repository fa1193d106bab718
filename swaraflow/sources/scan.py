"""Parquet scans with ordinals, shard paths, and tagged unions of sources.

Row groups, column pruning (into nested fields too), retries and back-off are
Spark's own; paths may lie in any store that Spark reads.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, max_rows: int | None = None) -> DataFrame:
    """The columns asked for (``audio.path`` reads that leaf only) and ``_idx``, a row's place in the shard.

    A shard that is a folder counts on from file to file, in order of their names: the
    rows before each file come from a table with a row for each file, which reads no
    column.  ``max_rows`` is looked at after a row, as in the surveyed system: 0 gives one row.
    """
    rows = spark.read.parquet(path)
    picked = [F.col(c).alias(c.rsplit(".", 1)[-1]) for c in columns] if columns else [F.col(c) for c in rows.columns]
    place = F.col("_metadata.row_index")
    if len(rows.inputFiles()) > 1:
        files = rows.groupBy(F.col("_metadata.file_path").alias("__file")).agg(F.count("*").alias("__n"))
        before = F.coalesce(F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = rows.select(*picked, place.alias("__at"), F.col("_metadata.file_path").alias("__file")).join(F.broadcast(files.select("__file", before.alias("__before"))), "__file")
        out = placed.withColumn("_idx", F.col("__before") + F.col("__at")).drop("__file", "__before", "__at")
    else:
        out = rows.select(*picked, place.alias("_idx"))
    return out if max_rows is None else out.limit(max(1, max_rows))


def shard_path(source: Column, shard: Column, directories: dict[str, str]) -> Column:
    """A shard's path under its source's directory; null for an unknown source."""
    return F.concat(F.element_at(F.create_map(*(F.lit(x) for kv in directories.items() for x in kv)), source), F.lit("/"), shard)


@dataclass(frozen=True)
class Read:
    """One shard of a plan, with what its rows are tagged with."""

    source: str
    language: str
    path: str
    columns: tuple[str, ...]
    pool: str | None = None
    speaker: str | None = None
    limit: int | None = None


def plan_table(spark: SparkSession, plan: Sequence[Read]) -> DataFrame:
    """A plan as a table, a row for each read in order."""
    rows = [(i, r.pool, r.source, r.language, r.path, list(r.columns), r.speaker, r.limit) for i, r in enumerate(plan)]
    return spark.createDataFrame(rows, "nth int, pool string, source string, language string, path string, columns array<string>, speaker string, quota int")


def read_plan(spark: SparkSession, plan: Sequence[Read]) -> DataFrame:
    """All shards of a plan by name, each tagged; columns that a shard lacks are null."""
    out = None
    for r in plan:
        rows = scan(spark, r.path, r.columns, r.limit).withColumns(
            {"source_hf_path": F.lit(r.source), "language_id": F.lit(r.language), "pool": F.lit(r.pool).cast("string"), "forced_speaker": F.lit(r.speaker).cast("string"), "shard": F.lit(r.path.rstrip("/").rsplit("/", 1)[-1])}
        )
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("the plan is empty")
    return out
