"""Step-triggered comparison with a baseline or the first evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hooks
from .clips import first_items
from .metrics import corpus_wer, regressions, with_edits


def changes(series: DataFrame, every: int, baseline: DataFrame | None = None) -> DataFrame:
    """``step, bucket, current, baseline, regression`` of each ``every``-th step of ``step, bucket, wer``; step 0 is never due.

    The baseline (``bucket, wer``) is the first such step if none is given; buckets that it lacks have no change.
    """
    due = series.filter((F.col("step") % every == 0) & (F.col("step") != 0))
    if baseline is None:
        first = due.agg(F.min("step").alias("__first"))
        baseline = due.join(F.broadcast(first), F.col("step") == F.col("__first")).select("bucket", "wer")
    return regressions(due, baseline, keep=["step"])


def alerts(series: DataFrame, every: int, limit: float = 0.15, baseline: DataFrame | None = None) -> DataFrame:
    """``step, worst, alert`` of each step that is due; an improvement everywhere is a worst of 0."""
    found = changes(series, every, baseline).groupBy("step").agg(F.greatest(F.max("regression"), F.lit(0.0)).alias("worst"))
    return found.withColumn("alert", F.col("worst") > limit)


def mark(found: DataFrame, path: str) -> bool:
    """Writes the steps that alert, if any, as the marker of a run; nothing is stopped. Whether there were any."""
    raised = found.filter("alert")
    if raised.isEmpty():
        return False
    raised.write.mode("overwrite").json(path)
    return True


def evaluation(items: DataFrame, synthesizer: Callable, transcriber: Callable, rate: int, most: int | None = 12) -> Callable[[], dict[str, float]]:
    """A function of nothing that gives each bucket's error rate, for a run that watches itself.

    ``items`` holds ``bucket, id, text, text_normalized, speaker``; the first
    ``most`` of each bucket are said and written down.  The language isn't passed on.
    """
    asked = items if most is None else first_items(items, "bucket", "id", most)

    def run() -> dict[str, float]:
        heard = hooks.transcribed(hooks.synthesized(asked, synthesizer), transcriber, rate, forward_language=False)
        pairs = heard.select("bucket", F.col("text_normalized").alias("reference"), "hypothesis")
        return {r["bucket"]: r["wer"] for r in corpus_wer(with_edits(pairs), "bucket").collect()}  # a row per bucket

    return run
