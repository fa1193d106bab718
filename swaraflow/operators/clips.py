"""From source rows to routing candidates, to checked clips, and to training examples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal
from ..functions import text as T
from ..functions import tokens as K
from . import gates, voices

HELD_OUT = "eval_holdout"
# fixed values: what counts as white space at the ends of a text
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def candidates(rows: DataFrame, source: Column, language: Column, key: Column, speaker: Column, text: str = "text", duration: str | None = None) -> DataFrame:
    """``rows`` with what routing asks for; texts that are empty, or empty once normalized, are dropped.

    Adds ``source_hf_path, language_id, speaker, text`` (stripped), ``text_normalized,
    num_digits, num_english_words, duration_s`` (0 where unknown) and ``clip_key``.
    """
    stripped = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES))
    seconds = F.coalesce(F.col(duration).cast("double"), F.lit(0.0)) if duration else F.lit(0.0)
    out = rows.withColumns({"source_hf_path": source, "language_id": language, "speaker": speaker, "clip_key": key, "duration_s": seconds})
    out = out.withColumn("text", stripped).filter(F.col("text") != "").withColumn("text_normalized", T.cleaned(F.col("text"), once=True)).filter(F.col("text_normalized") != "")
    return out.withColumns({"num_digits": T.digit_count(F.col("text_normalized")), "num_english_words": T.latin_word_count(F.col("text_normalized"))})


def clips(
    rows: DataFrame, source: str, license: str, language: str, target_rate: int, held_out: DataFrame | None = None, limits: gates.Gates = gates.Gates(),
    assignment: dict[str, dict] = voices.ASSIGNMENT, numbers: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Source rows (``audio`` of ``bytes, path``, ``text``, ``gender``, ``_idx``) as ``clip_key, meta, samples, gate``.

    In this order: rows of held-out keys are set aside before anything is decoded;
    audio is decoded, measured at its own rate and resampled; the voice is looked
    up; the text is normalized; the record is built, checked and gated.  A row that
    isn't kept has no record and no samples; its ``gate`` says why.  ``numbers``
    puts digits of the text through a speller.
    """
    found = rows if "gender" in rows.columns else rows.withColumn("gender", F.lit(None).cast("string"))
    found = found.withColumn("clip_key", T.clip_key(F.lit(source), F.col("audio.path"), F.col("_idx")))
    none = F.array().cast("array<string>")
    aside = None
    if held_out is not None:
        keys = held_out.select("clip_key").distinct()
        aside = found.join(keys, "clip_key", "left_semi").select("clip_key", F.struct(F.lit(False).alias("kept"), F.lit(HELD_OUT).alias("hard_reject"), none.alias("soft_flags")).alias("gate"))
        found = found.join(keys, "clip_key", "left_anti")

    native = found.withColumn("wave", signal.decoded(None)(F.col("audio.bytes")))
    measured = native.withColumn("quality", signal.clip_quality(F.col("wave.samples"), F.col("wave.rate")))
    measured = measured.withColumn("samples", signal.resampled(F.col("wave.samples"), F.col("wave.rate"), F.lit(target_rate)))
    spoken = numbers(F.col("text")) if numbers else F.col("text")
    named = measured.withColumn("normalized", T.normalization_record(T.cleaned(spoken))).withColumn("speaker", voices.assigned(F.lit(source), F.col("gender"), assignment))
    name = F.col("_idx").cast("string") if "filename" not in rows.columns else F.coalesce("filename", F.col("_idx").cast("string"))
    meta = F.struct(
        F.struct(F.concat(F.lit(source + "#"), name).alias("source_id"), F.lit(license).alias("license")).alias("provenance"),
        F.struct(F.lit(target_rate).alias("sample_rate"), F.col("quality.duration_s").alias("duration_s"), F.col("quality.snr_db").alias("snr_estimate"), F.col("quality.clipping_ratio").alias("clipping_ratio")).alias("audio"),
        F.struct(F.col("text").alias("text_raw"), F.col("normalized.text_normalized").alias("text_normalized"), F.col("normalized.normalizer_version").alias("normalizer_version")).alias("transcript"),
        F.struct(F.lit(language).alias("language_id"), *(F.col(f"normalized.{c}").alias(c) for c in ("script", "num_digits", "num_english_words", "code_switch_spans")), F.lit("general").alias("domain")).alias("text"),
        F.struct(F.col("speaker").alias("name"), voices.voice_gender(F.col("speaker")).alias("gender")).alias("speaker"),
        F.struct(T.sha16(F.col("audio.bytes")).alias("audio_hash"), T.sha16(F.col("normalized.text_normalized")).alias("transcript_shingle_hash")).alias("dedup"),
    )
    reject = gates.hard_reject(F.lit(license), F.col("quality.duration_s"), F.col("normalized.text_normalized"), limits)
    flags = F.when(reject.isNull(), gates.soft_flags(F.col("quality.snr_db"), F.col("quality.clipping_ratio"), F.col("quality.wideband"), limits)).otherwise(none)
    gated = named.withColumn("gate", gates.gated(reject, flags))
    kept = F.col("gate.kept")
    out = gated.select("clip_key", F.when(kept, meta).alias("meta"), F.when(kept, F.col("samples")).alias("samples"), "gate")
    return out if aside is None else out.unionByName(aside, allowMissingColumns=True)


def compiled(kept: DataFrame, contract: K.Contract, audio_ids: Column, text_ids: Column, speaker_ids: Column, newline_ids: Column, stop_in_loss: bool = True) -> DataFrame:
    """Each clip as one example (``input_ids, labels, prompt_len``) or, with less than a frame, none."""
    none = F.array().cast("array<int>")
    rows = kept.withColumn("__audio", audio_ids).filter(K.long_enough(F.col("__audio")))
    example = K.prompt_and_audio(text_ids, speaker_ids, none, newline_ids, F.col("__audio"), contract, stop_in_loss)
    # guarded again, as a later filter on the example may be evaluated along with the one above
    rows = rows.withColumn("__example", F.when(K.long_enough(F.col("__audio")), example))
    return rows.select(*kept.columns, "__example.*")


def first_items(items: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The first ``most`` items of each group."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return items.withColumn("__nth", nth).filter(F.col("__nth") <= most).drop("__nth")
