"""Evaluation buckets: priority routing, seeded top-k, numbering and long prompts."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
ANCHOR, PRIMARY = "ai4bharat/Rasa", "SPRINGLab/IndicTTS_Marathi"
STEM_STYLES = ("WIKI", "INDIC")
ADVERSARIAL_STYLES = ("NAMES", "PROPER NOUN", "PROPER_NOUN")
SEED = 1234
LONGFORM = "marathi_longform"
LONGFORM_S, LONGFORM_COUNT, CHARS_PER_SECOND, LONGFORM_LEAST = 45.0, 12, 12.0, 0.6


def styled(style: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.upper(F.trim(style)).isin(*names), F.lit(False))


def catalogue() -> dict[str, tuple[Column, int, bool]]:
    """Bucket -> eligibility, size, whether it watches retention; in order of priority."""
    mr = F.col("language_id") == "mr"
    anchor, style = F.col("source_hf_path") == ANCHOR, F.col("rasa_style")
    digits, english = F.col("num_digits") > 0, F.col("num_english_words") > 0
    return {
        "marathi_adversarial": (mr & (digits | styled(style, ADVERSARIAL_STYLES)), 40, False),
        "marathi_code_switch": (mr & english & ~digits, 30, False),
        "marathi_stem_seen_voice": (anchor & mr & styled(style, STEM_STYLES), 40, False),
        "retention_rasa_marathi": (anchor & mr, 30, True),
        "marathi_general_unseen_domain": (F.col("source_hf_path") == PRIMARY, 40, False),
        "retention_hindi": (F.col("language_id") == "hi", 40, True),
        "retention_english": (F.col("language_id") == "en", 30, True),
    }


def routed() -> Column:
    """The first bucket that a candidate is eligible for, or null."""
    return F.coalesce(*(F.when(eligible, F.lit(name)) for name, (eligible, _, _) in catalogue().items()))


def chosen(candidates: DataFrame, sizes: Mapping[str, int] | None = None, seed: int = SEED) -> DataFrame:
    """At most a bucket's size of its candidates, in an order drawn by hash, with ``pos`` (from 0) and ``id``.

    Order and ties depend on the key alone, so one more candidate moves nobody
    else. ``row_number() <= size`` is pushed below the exchange as a group limit.
    """
    sizes = {n: k for n, (_, k, _) in catalogue().items()} | dict(sizes or {})
    most = F.element_at(F.create_map(*(x for n, k in sizes.items() for x in (F.lit(n), F.lit(k)))), F.col("bucket"))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("clip_key")), 256)
    order = Window.partitionBy("bucket").orderBy(draw, "clip_key")
    ranked = candidates.filter(F.col("bucket").isNotNull()).withColumn("nth", F.row_number().over(order))
    # the constant bound lets Spark keep only so many rows a bucket before the shuffle
    ranked = ranked.filter(F.col("nth") <= max(sizes.values())).withColumn("pos", F.col("nth") - 1).drop("nth").filter(F.col("pos") < most)
    return ranked.withColumn("id", F.format_string("%s_%03d", "bucket", "pos"))


def longform(items: DataFrame, target_s: float = LONGFORM_S, count: int = LONGFORM_COUNT, rate: float = CHARS_PER_SECOND) -> DataFrame:
    """Prompts packed greedily per speaker from texts in order (``speaker, ord, text_normalized``).

    A prompt closes when it holds the target's characters and is kept at 60 % of
    them; ``count`` prompts are kept over all speakers, in order of speaker. The
    state that resets is what a window sum can't express, hence the fold.

    Empty texts don't count. Each other text adds a character at least, so
    ``count`` prompts are full after ``count * target`` texts: no more than these
    leave a task, whatever a speaker has.
    """
    target = target_s * rate
    nth = F.row_number().over(Window.partitionBy("speaker").orderBy("ord", "text_normalized"))
    items = items.select("speaker", "ord", "text_normalized").filter("text_normalized <> ''").withColumn("nth", nth).filter(F.col("nth") <= count * math.ceil(target))
    texts = items.groupBy("speaker").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text_normalized"))), lambda x: x["text_normalized"]).alias("texts"))
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("open"), F.lit(0).alias("chars"), F.array().cast("array<struct<text:string,chars:int>>").alias("closed"))

    def close(acc: Column, opened: Column, chars: Column) -> Column:
        return F.struct(empty.alias("open"), F.lit(0).alias("chars"), F.concat(acc["closed"], F.array(F.struct(F.array_join(opened, " ").alias("text"), chars.alias("chars")))).alias("closed"))

    def step(acc: Column, text: Column) -> Column:
        opened, chars = F.concat(acc["open"], F.array(text)), acc["chars"] + F.length(text)
        return F.when(chars >= target, close(acc, opened, chars)).otherwise(F.struct(opened.alias("open"), chars.alias("chars"), acc["closed"].alias("closed")))

    packed = F.aggregate("texts", start, step, lambda acc: F.when(acc["chars"] >= target * LONGFORM_LEAST, close(acc, acc["open"], acc["chars"])["closed"]).otherwise(acc["closed"]))
    prompts = texts.select("speaker", F.posexplode(packed).alias("nth", "prompt"))
    numbered = prompts.withColumn("pos", F.row_number().over(Window.orderBy("speaker", "nth")) - 1).filter(F.col("pos") < count)
    return numbered.select(
        F.format_string(f"{LONGFORM}_%03d", "pos").alias("id"), F.lit(LONGFORM).alias("bucket"), "speaker", F.col("prompt.text").alias("text"), F.round(F.col("prompt.chars") / rate, 1).alias("target_seconds")
    )


def held_out_keys(items: DataFrame) -> DataFrame:
    return items.select("clip_key").filter(F.col("clip_key").isNotNull()).distinct().orderBy("clip_key")


def summary(items: DataFrame) -> DataFrame:
    """Items per bucket of the catalogue, empty ones included."""
    names = items.sparkSession.createDataFrame([(n,) for n in [*catalogue(), LONGFORM]], "bucket string")
    return names.join(items.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def overlaps(items: DataFrame) -> DataFrame:
    """Keys that several buckets hold; the routing leaves none."""
    return items.groupBy("clip_key").agg(F.count_distinct("bucket").alias("buckets")).filter("buckets > 1")
