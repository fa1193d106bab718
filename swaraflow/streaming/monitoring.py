"""A run that watches itself: evaluations as a stream, the baseline as state.

An evaluation is one row ``run, step, buckets, wers``, so it can't be torn apart by
micro-batches.  A run's first due evaluation after step 0 becomes its baseline and
stays in the state store, which the checkpoint brings back after a restart.  Every due
step gives one record; those over the limit also go to the marker.  Nothing is stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVALUATION = "run string, step bigint, buckets array<string>, wers array<double>"
RECORD = EVALUATION + ", changed array<string>, regressions array<double>, worst double, alert boolean"
BASELINE = "step bigint, buckets array<string>, wers array<double>"
LEAST_BASE = 1e-6


def evaluations(series: DataFrame, run: str = "run") -> DataFrame:
    """``run, step, bucket, wer`` as one row for each evaluation."""
    ordered = F.sort_array(F.collect_list(F.struct("bucket", "wer")))
    rows = series.groupBy(F.col(run).alias("run"), F.col("step").cast("long").alias("step")).agg(ordered.alias("of"))
    return rows.select("run", "step", F.col("of.bucket").alias("buckets"), F.col("of.wer").alias("wers"))


def records(stream: DataFrame, every: int, limit: float = 0.15, baseline: dict[str, float] | None = None) -> DataFrame:
    """A record for each due evaluation of a stream; ``baseline`` stands for the first one of every run.

    Evaluations of a run are taken by step within a micro-batch; a step that comes
    again gives a record again.
    """

    def follow(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = sorted((r for p in parts for r in p.itertuples(index=False)), key=lambda r: r.step)
        base = baseline
        if base is None and state.exists:
            _, names, values = state.get
            base = dict(zip(names, values, strict=True))
        out = []
        for r in rows:
            if r.step == 0 or r.step % every:
                continue
            current = dict(zip(r.buckets, r.wers, strict=True))
            if base is None:
                base = current
                state.update((int(r.step), list(base), [float(x) for x in base.values()]))
            changes = {b: (x - base[b]) / max(base[b], LEAST_BASE) for b, x in current.items() if b in base}
            worst = max(0.0, *changes.values()) if changes else 0.0
            out.append((key[0], int(r.step), list(current), [float(x) for x in current.values()], list(changes), [float(x) for x in changes.values()], worst, worst > limit))
        yield pd.DataFrame(out, columns=["run", "step", "buckets", "wers", "changed", "regressions", "worst", "alert"])

    return stream.groupBy("run").applyInPandasWithState(follow, RECORD, BASELINE, "append", GroupStateTimeout.NoTimeout)


def watch(stream: DataFrame, out: str, marker: str, checkpoint: str, every: int, limit: float = 0.15, baseline: dict[str, float] | None = None) -> StreamingQuery:
    """Writes a record of each due evaluation to ``out`` and those that alert to ``marker``, as JSON.

    A micro-batch has folders of its own, which a repeated one overwrites: records are written exactly once.
    """
    json = F.map_from_arrays

    def keep(batch: DataFrame, number: int) -> None:
        rows = batch.select("run", "step", json("buckets", "wers").alias("wer"), json("changed", "regressions").alias("relative_regression"), "worst", "alert")
        rows = rows.persist()
        rows.write.mode("overwrite").json(f"{out}/batch={number}")
        raised = rows.filter("alert")
        if not raised.isEmpty():
            raised.write.mode("overwrite").json(f"{marker}/batch={number}")
        rows.unpersist()

    return records(stream, every, limit, baseline).writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
