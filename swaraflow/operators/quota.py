"""Examples up to a quota, from shards that are opened in growing waves.

Compiling a row is dear (audio is decoded, encoded, gated), so a source is read
only as far as its quota asks: first one shard, then four, then sixteen ..., and no
further once there are enough examples.  A wave is an ordinary distributed job; what
is compiled beyond the need is less than the last wave.

A source also has a cap on *raw* rows, counted in order of shard and row before
anything is rejected, so a source that yields little isn't read to its end.  The cap
is a filter on the order column below the compile function: rows past it are never
decoded.

Rows need a shard number and an order that is unique and not null within a shard.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written

#: Raw rows that are looked at for each example that is wanted; how much larger the next wave is.
SCAN_FACTOR, GROWTH = 8, 4


@dataclass(frozen=True)
class Filled:
    """The examples, how many there are, the raw rows looked at, and the shards opened."""

    examples: DataFrame
    found: int
    scanned: int
    opened: int


@dataclass(frozen=True)
class Shards:
    """``open(first, stop)`` gives the raw rows of shards ``first`` to ``stop - 1``, with their numbers in ``shard``."""

    open: Callable[[int, int], DataFrame]
    count: int
    order: str
    shard: str = "shard"


def files(spark: SparkSession, paths: Sequence[str], reader: Callable[[Sequence[str]], DataFrame] | None = None) -> Shards:
    """Each Parquet file as a shard, in the order given; rows by their place in the file."""
    read = reader or (lambda some: spark.read.parquet(*some))

    def opened(first: int, stop: int) -> DataFrame:
        rows = read(list(paths[first:stop])).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("row_index"))
        numbers = [F.when(F.col("__file").endswith(p), F.lit(k)) for k, p in enumerate(paths[first:stop], first)]
        return rows.withColumn("shard", F.coalesce(*numbers)).drop("__file")

    return Shards(opened, len(paths), "row_index")


def whole(rows: DataFrame, order: str) -> Shards:
    """Rows that aren't in shards, as one."""
    return Shards(lambda first, stop: rows.withColumn("shard", F.lit(0)), 1, order)


def _within(rows: DataFrame, source: Shards, left: int) -> tuple[DataFrame, int]:
    """The first ``left`` of a wave's rows by shard and order, and how many they are."""
    counts = {r[0]: r[1] for r in rows.groupBy(source.shard).agg(F.count("*")).collect()}  # a row for each shard of the wave
    keep, taken = F.lit(False), 0
    for k in sorted(counts):
        if counts[k] <= left - taken:
            keep = keep | (F.col(source.shard) == k)
            taken += counts[k]
            continue
        if left > taken:
            first = rows.filter(F.col(source.shard) == k).select(source.order).orderBy(source.order).limit(left - taken)
            keep = keep | ((F.col(source.shard) == k) & (F.col(source.order) <= first.agg(F.max(source.order)).first()[0]))
            taken = left
        break
    return (rows if taken == sum(counts.values()) else rows.filter(keep)), taken


def first_examples(source: Shards, compile: Callable[[DataFrame], DataFrame], quota: int, longest: int, scan_factor: int = SCAN_FACTOR, growth: int = GROWTH) -> Filled:
    """The first ``quota`` examples of at most ``longest`` ids, out of the first ``quota * scan_factor`` raw rows.

    ``compile`` turns raw rows into examples with ``input_ids``; it keeps the shard and the order column.
    """
    cap, scanned, opened, size, found, parts = quota * scan_factor, 0, 0, 1, 0, []
    while opened < source.count and scanned < cap and found < quota or not parts:
        stop = min(source.count, opened + size)
        rows, taken = _within(source.open(opened, stop), source, cap - scanned)
        part = written(compile(rows).filter(F.size("input_ids") <= longest), "examples")  # compiled once
        parts.append(part)
        found, scanned, opened, size = found + part.count(), scanned + taken, stop, size * growth
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return Filled(out.orderBy(source.shard, source.order).limit(quota), min(found, quota), scanned, opened)


def compile_plan(sources: dict[str, Shards], compile: Callable[[DataFrame], DataFrame], quotas: dict[str, int], longest: int, scan_factor: int = SCAN_FACTOR) -> tuple[DataFrame, DataFrame]:
    """All sources' examples within their quotas, tagged with ``source``; and ``source, n, scanned, opened`` of each."""
    if not sources:
        raise ValueError("the plan is empty")
    out, report = None, []
    for name, source in sources.items():
        filled = first_examples(source, compile, quotas[name], longest, scan_factor)
        one = filled.examples.drop(source.shard).withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        report.append((name, filled.found, filled.scanned, filled.opened))
    return out, out.sparkSession.createDataFrame(report, "source string, n long, scanned long, opened int")
