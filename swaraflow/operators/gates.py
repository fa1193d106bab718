"""Row checks: gates that reject or flag clips, and record validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import percentiles
from .voices import speaker_problem


@dataclass(frozen=True)
class Gates:
    """Inclusive bounds of the duration in seconds, and the limits of the flags."""

    shortest: float = 0.5
    longest: float = 20.0
    snr_floor: float = 15.0
    clipping_most: float = 0.01


def hard_reject(license: Column, duration: Column, normalized: Column, gates: Gates = Gates()) -> Column:
    """The first reason to drop a clip, or null."""
    unknown = license.isNull() | F.lower(F.trim(license)).isin("", "unknown")
    return (
        F.when(unknown, F.lit("license_unknown"))
        .when(~F.coalesce((duration >= gates.shortest) & (duration <= gates.longest), F.lit(False)), F.lit(f"duration_out_of_[{gates.shortest},{gates.longest}]"))
        .when(F.trim(F.coalesce(normalized, F.lit(""))) == "", F.lit("empty_normalized_text"))
    )


def soft_flags(snr: Column, clipping: Column, wideband: Column, gates: Gates = Gates()) -> Column:
    """What is doubtful about a clip that is kept all the same."""
    flags = F.array(
        F.when(snr < gates.snr_floor, F.lit(f"snr<{gates.snr_floor}")),
        F.when(clipping > gates.clipping_most, F.lit(f"clip>{gates.clipping_most}")),
        F.when(~wideband, F.lit("narrowband")),
    )
    return F.filter(flags, lambda x: x.isNotNull())


def gated(reject: Column, flags: Column) -> Column:
    return F.struct(reject.isNull().alias("kept"), reject.alias("hard_reject"), flags.alias("soft_flags"))


def clip_problem(rate: Column, duration: Column, clipping: Column, language: Column, script: Column, spans: Column, raw: Column, speaker: Column, gender: Column) -> Column:
    """Why a clip's record is invalid, or null."""
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", F.lit("empty_text"))
        .when(~F.coalesce(rate > 0, F.lit(False)), F.lit("sample_rate"))
        .when(~F.coalesce(duration > 0, F.lit(False)), F.lit("duration"))
        .when(~F.coalesce((clipping >= 0) & (clipping <= 1), F.lit(False)), F.lit("clipping_ratio"))
        .when((language == "en") & (script != "Latn"), F.lit("script_language"))
        .when(~F.forall(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"])), F.lit("span"))
        .otherwise(speaker_problem(speaker, gender))
    )


def split_valid(clips: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and invalid rows with their ``problem``."""
    judged = clips.withColumn("problem", problem)
    return judged.filter(F.col("problem").isNull()).drop("problem"), judged.filter(F.col("problem").isNotNull())


def assert_valid(clips: DataFrame, problem: Column) -> DataFrame:
    """The rows as they are; an invalid one fails the job."""
    return clips.withColumn("__ok", F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("invalid clip: "), problem)).cast("boolean")).otherwise(F.lit(True))).filter("__ok").drop("__ok")


def preflight(quality: DataFrame, source: str = "source", least_snr: float = 20.0, least_wideband: float = 0.9, sample: int | None = None, key: str = "clip_key") -> DataFrame:
    """Per source the median SNR, the wide-band share, and whether a full run may start.

    With ``sample``, of so many clips of each source, drawn by hash of their key; at
    most that many of a source leave a task.  The surveyed system only declares this
    switch; here it works.
    """
    if sample is not None:
        drawn = F.sha2(F.col(key).cast("string"), 256)
        nth = F.row_number().over(Window.partitionBy(source).orderBy(drawn, key))
        quality = quality.withColumn("__nth", nth).filter(F.col("__nth") <= sample).drop("__nth")
    shares = quality.groupBy(F.col(source).alias("__source")).agg(F.avg(F.col("wideband").cast("double")).alias("wideband_fraction"))
    found = shares.join(percentiles(quality, source, "snr_db", (0.5,)), F.col("__source").eqNullSafe(F.col(source)), "left")
    found = found.select(F.col("__source").alias(source), F.col("q")[0].alias("median_snr"), "wideband_fraction")
    return found.withColumn("passes", F.coalesce((F.col("median_snr") >= least_snr) & (F.col("wideband_fraction") >= least_wideband), F.lit(False)))
