"""The evaluation panel: a row per bucket, as a table, as JSON and as a page."""

from __future__ import annotations

import html
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.text import shown
from ..sources.committed import put
from ..sources.tables import written
from .metrics import bootstrap_ci, corpus_wer, mean_pairwise_similarity, or_nan, split_bootstrap_ci, with_edits
from .routing import LONGFORM

PROSODY = ("mean_f0", "f0_std", "energy_std", "pause_ratio")


def wer_panel(results: DataFrame, catalogue: DataFrame, seed: int = 0, bounded: bool = False) -> DataFrame:
    """Per bucket of ``catalogue``: n, corpus WER, the interval of the mean over utterances, edit counts, hit rate.

    ``results`` holds ``id, bucket, reference, hypothesis, hit``; empty buckets stay,
    with n = 0.  The interval is split over tasks; with ``bounded`` buckets it is
    the one of :func:`metrics.bootstrap`, each bucket in one task.
    """
    # aligned once: what is read again are the counts of each pair, without its texts
    edited = written(with_edits(results.select("id", "bucket", "reference", "hypothesis", "hit")).drop("reference", "hypothesis"), "edits")
    hits = edited.groupBy("bucket").agg(F.avg(F.col("hit").cast("double")).alias("hit_rate"))
    interval = bootstrap_ci if bounded else split_bootstrap_ci
    intervals = interval(edited, "bucket", "utterance_wer", "id", seed=seed).select("bucket", "low", "high")
    found = corpus_wer(edited, "bucket").join(hits, "bucket").join(intervals, "bucket")
    return catalogue.select("bucket").join(found, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def full_panel(results: DataFrame, catalogue: DataFrame, longform: DataFrame | None = None, similarity: DataFrame | None = None, prosody: DataFrame | None = None, **how) -> DataFrame:
    """The WER panel with each bucket's similarity (also by voice), prosody means and long-prompt figures beside it; null where a bucket has none.

    The buckets of long prompts have no WER: their n is that of the long prompts.
    """
    out = wer_panel(results, catalogue, **how)
    if longform is not None:
        long = longform_panel(longform).withColumnsRenamed({"n": "__n", "hit_rate": "__hit"})
        out = out.join(long, "bucket", "left").withColumns({"n": F.coalesce("__n", "n"), "hit_rate": F.coalesce("__hit", "hit_rate")}).drop("__n", "__hit")
    for part in (similarity, prosody):
        if part is not None:
            out = out.join(part, "bucket", "left")
    return out


def longform_panel(results: DataFrame) -> DataFrame:
    """Repetition, frames and hit rate of the long prompts (``bucket, token_ids, hit``)."""
    ids = F.col("token_ids")
    return results.filter(F.col("bucket") == LONGFORM).groupBy("bucket").agg(
        F.count("*").alias("n"),
        F.avg(arrays.repetition_rate(ids, 3)).alias("repetition_rate_3gram"),
        F.avg(arrays.repetition_rate(ids, 5)).alias("repetition_rate_5gram"),
        F.avg(F.col("hit").cast("double")).alias("hit_rate"),
        F.avg(F.floor(F.size(ids) / 7)).alias("mean_frames"),
    )


def voice_breakdown(generated: DataFrame, references: DataFrame) -> DataFrame:
    """``bucket, speaker_similarity, by_voice`` of vectors (``bucket, speaker, vector``); by voice only where there are several."""
    pair = lambda df: df.withColumn("__g", F.concat_ws("\u0001", "bucket", "speaker"))
    whole = mean_pairwise_similarity(generated, references, "bucket", "vector").withColumnRenamed("similarity", "speaker_similarity")
    each = mean_pairwise_similarity(pair(generated), pair(references), "__g", "vector").filter(~F.isnan("similarity"))
    each = each.select(F.split("__g", "\u0001")[0].alias("bucket"), F.split("__g", "\u0001")[1].alias("speaker"), "similarity")
    voices = each.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("speaker", "similarity"))).alias("v"))
    return whole.join(voices, "bucket", "left").select("bucket", "speaker_similarity", F.when(F.size("v") > 1, F.map_from_entries("v")).alias("by_voice"))


def prosody_means(measured: DataFrame, by: str = "bucket") -> DataFrame:
    """Means that skip missing values; NaN where all are missing."""
    return measured.groupBy(by).agg(*(or_nan(F.avg(p)).alias(p) for p in PROSODY))


def prosody_deltas(measured: DataFrame, reference: DataFrame, key: str = "id") -> DataFrame:
    """Generated minus reference of each measure; missing on either side is missing."""
    other = reference.select(key, *(F.col(p).alias(f"ref_{p}") for p in PROSODY))
    return measured.join(other, key).select(key, *((F.col(p) - F.col(f"ref_{p}")).alias(f"delta_{p}") for p in PROSODY))


def trajectory_drop(similarities: Column) -> Column:
    """First less last similarity of a long utterance's windows; 0 with fewer than two."""
    return F.when(F.size(similarities) >= 2, F.get(similarities, 0) - F.element_at(similarities, -1)).otherwise(F.lit(0.0))


def longform_records(results: DataFrame) -> DataFrame:
    """``results`` (``token_ids, hit`` and, where known, ``similarities``) with the figures of each long prompt."""
    ids = F.col("token_ids")
    out = results.withColumns({"n_frames": F.floor(F.size(ids) / 7).cast("int"), "repetition_rate_3gram": arrays.repetition_rate(ids, 3), "repetition_rate_5gram": arrays.repetition_rate(ids, 5)})
    return out.withColumn("similarity_drop", trajectory_drop(F.col("similarities"))) if "similarities" in results.columns else out


def _buckets(panel: DataFrame) -> DataFrame:
    record = F.struct(*(F.col(c) for c in panel.columns if c != "bucket"))
    found = panel.agg(F.map_from_entries(F.collect_list(F.struct("bucket", record.alias("r")))).alias("m"))
    return found.select(F.map_from_entries(F.transform(F.sort_array(F.map_keys("m")), lambda k: F.struct(k.alias("bucket"), F.element_at("m", k).alias("r")))).alias("buckets"))


def write_json(panel: DataFrame, path: str) -> None:
    """One JSON document with a record for each bucket, under ``buckets``; nulls are left out."""
    _buckets(panel).coalesce(1).write.mode("overwrite").json(path)


def as_json(panel: DataFrame) -> DataFrame:
    """The same, pretty-printed, as the one row ``document``."""
    return _buckets(panel).select(F.to_json(F.struct("buckets"), {"pretty": "true"}).alias("document"))


#: Heading -> the number of decimals of a column's cells; columns not named are left out of the page.
WER_COLUMNS = {"bucket": None, "n": None, "wer": 3, "low": 3, "high": 3, "insertions": None, "deletions": None, "substitutions": None, "hit_rate": 2, "speaker_similarity": 3, "by_voice": 3}
LONG_COLUMNS = {"bucket": None, "n": None, "repetition_rate_3gram": 3, "repetition_rate_5gram": 3, "hit_rate": 2, "mean_frames": 1}


def display(table: DataFrame, columns: Mapping[str, int | None]) -> DataFrame:
    """The columns that the table has, as text: numbers with fixed decimals, maps as ``key value`` pairs, a dash for NaN and null."""

    def text(name: str) -> Column:
        kind, digits = table.schema[name].dataType.typeName(), columns[name]
        if kind == "map":
            pairs = F.transform(F.sort_array(F.map_entries(name)), lambda e: F.concat_ws(" ", e["key"], shown(e["value"], digits)))
            return F.coalesce(F.array_join(pairs, ", "), F.lit("—"))
        return shown(F.col(name), digits) if digits is not None else F.coalesce(F.col(name).cast("string"), F.lit("—"))

    return table.select(*(text(c).alias(c) for c in columns if c in table.columns))


def page(title: str, tables: Mapping[str, DataFrame], raw: Mapping[str, DataFrame]) -> str:
    """An HTML page of displayed tables and of others' rows as JSON. Each has a row per bucket, so it is read on the driver."""
    parts = []
    for caption, table in tables.items():
        rows = table.collect()
        if not rows:
            continue
        lines = [table.columns, *rows]
        cells = ("".join(f"<{tag}>{html.escape(str(c))}</{tag}>" for c in line) for tag, line in zip(["th", *["td"] * len(rows)], lines, strict=True))
        parts.append(f"<table><caption>{html.escape(caption)}</caption>" + "".join(f"<tr>{c}</tr>" for c in cells) + "</table>")
    for caption, table in raw.items():
        rows = html.escape("\n".join(r[0] for r in table.select(F.to_json(F.struct("*"))).collect()))
        parts.append(f"<details><summary>{html.escape(caption)}</summary><pre>{rows}</pre></details>")
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{''.join(parts)}</body></html>"


def report(wer: DataFrame, longform: DataFrame | None = None, title: str = "Evaluation panel") -> str:
    """The panel's page: buckets with a WER, long prompts, and all rows as JSON."""
    tables = {"WER by bucket, with the interval over utterances": display(wer.filter(F.col("wer").isNotNull()).orderBy("bucket"), WER_COLUMNS)}
    raw = {"rows": wer}
    if longform is not None:
        tables["Long prompts"] = display(longform.orderBy("bucket"), LONG_COLUMNS)
        raw["long prompts, rows"] = longform
    return page(title, tables, raw)


def write_report(path: str, *args, **how) -> None:
    put(path, report(*args, **how))
