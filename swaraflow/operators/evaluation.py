"""An evaluation from locked manifests to the panel, in steps that survive an interruption.

Items are spoken, written down, compared to the voices' references and measured; each
step is a table in the run's folder and isn't done again when the run is started anew,
so what is dear (speech, transcripts, vectors) is made once.  What is published at the
end - the panel as JSON, the page, references and hypotheses - appears as one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal
from ..sources import manifests
from ..sources.committed import publish
from . import hooks, lookups, panel
from .routing import LONGFORM

# fixed values: the buckets whose voices are compared to references
VOICE_BUCKETS = ("marathi_stem_seen_voice", "retention_rasa_marathi")


@dataclass(frozen=True)
class Models:
    """Factories of the model side; without an embedder voices aren't compared."""

    synthesizer: Callable[[], hooks.Synthesizer]
    transcriber: Callable[[], hooks.Transcriber]
    embedder: Callable[[], hooks.Embedder] | None = None


class Run:
    """A folder of steps, each a Parquet table that is complete once its writer has committed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def done(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/steps/{name}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def step(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/steps/{name}"
        if not self.done(name):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def _voices(run: Run, spoken: DataFrame, references: DataFrame, models: Models, rate: int, buckets: tuple[str, ...]) -> DataFrame:
    """``bucket, speaker_similarity, by_voice`` over the items that have a reference."""
    asked = spoken.filter(F.col("bucket").isin(*buckets) & F.col("clip_key").isNotNull())
    clips = references.select("clip_key", F.col("samples").alias("reference_samples"))
    paired = run.step("references", lambda: lookups.with_reference(asked.select("bucket", "id", "speaker", "clip_key"), clips, ["clip_key"], "reference_samples").filter("reference_samples is not null"))
    own = run.step("vectors", lambda: hooks.embedded(asked.join(paired.select("id"), "id", "left_semi").select("bucket", "id", "speaker", "samples"), models.embedder, rate).drop("samples"))
    theirs = run.step("reference-vectors", lambda: hooks.embedded(paired.select("bucket", "id", "speaker", F.col("reference_samples").alias("samples")), models.embedder, rate).drop("samples"))
    return panel.voice_breakdown(own, theirs).filter(~F.isnan("speaker_similarity"))


def evaluate(spark: SparkSession, lock: str, folder: str, models: Models, rate: int = 24_000, references: DataFrame | None = None, voice_buckets: tuple[str, ...] = VOICE_BUCKETS, seed: int = 0) -> DataFrame:
    """The panel of the items of a lock (``manifests.write``), a row for each bucket; also published under ``folder``/published.

    ``references`` holds ``clip_key, samples`` at ``rate``.  Buckets without items stay, with n = 0.
    """
    run = Run(spark, folder)
    items = run.step("items", lambda: manifests.read(spark, lock).withColumnRenamed("manifest", "bucket"))
    spoken = run.step("spoken", lambda: hooks.synthesized(items, models.synthesizer))
    short = spoken.filter(F.col("bucket") != LONGFORM)
    heard = run.step("heard", lambda: hooks.transcribed(short, models.transcriber, rate).drop("samples", "token_ids"))
    results = heard.select("id", "bucket", F.col("text_normalized").alias("reference"), "hypothesis", "hit")
    voiced = short.filter(F.col("bucket").isin(*voice_buckets))
    measured = run.step("prosody", lambda: voiced.select("bucket", "id", signal.prosody(F.col("samples"), F.lit(rate)).alias("p")).select("bucket", "id", "p.*"))
    similarity = None if models.embedder is None or references is None else _voices(run, spoken, references, models, rate, voice_buckets)
    catalogue = manifests.buckets(spark, lock)
    long = spoken.filter(F.col("bucket") == LONGFORM)
    found = run.step("panel", lambda: panel.full_panel(results, catalogue, long, similarity, panel.prosody_means(measured), seed=seed, bounded=True))
    if not run.done("published"):
        whole = panel.as_json(found).select(F.lit("panel.json").alias("path"), F.encode("document", "UTF-8").alias("content"))
        page = spark.createDataFrame([("panel.html", panel.report(found, panel.longform_panel(long)).encode())], "path string, content binary")
        line = F.to_json(F.struct("id", "reference", "hypothesis"), {"ignoreNullFields": "false"})
        audit = results.groupBy("bucket").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))), lambda s: s["line"]), "\n").alias("lines"))  # tens of items a bucket
        audit = audit.select(F.concat(F.lit("audit/"), "bucket", F.lit(".jsonl")).alias("path"), F.encode("lines", "UTF-8").alias("content"))
        publish(whole.unionByName(page).unionByName(audit), f"{run.folder}/published", overwrite=True)
        run.step("published", lambda: spark.range(1))
    return found
