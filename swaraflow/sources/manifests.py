"""Bucket manifests, held-out keys and audit files as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .committed import publish
from .tables import written

# fixed values: names of the files of a lock
KEYS, SUMMARY = "held_out_clip_keys.json", "_summary.json"


def documents(items: DataFrame, header: DataFrame) -> DataFrame:
    """One row per bucket of ``header``: its columns, ``count`` and the items in order of id."""
    rest = [c for c in items.columns if c != "bucket"]
    grouped = items.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("id", *(c for c in rest if c != "id")))).alias("items"))
    kind = grouped.schema["items"].dataType
    return header.join(grouped, "bucket", "left").withColumn("items", F.coalesce("items", F.array().cast(kind))).withColumn("count", F.size("items"))


def write(items: DataFrame, header: DataFrame, path: str, keys: DataFrame | None = None, seed: int = 0, key: str = "clip_key", overwrite: bool = False) -> None:
    """All files of a lock, which appear together or not at all.

    A pretty-printed ``<bucket>.json`` for each bucket, ``held_out_clip_keys.json``
    with the sorted distinct keys (of the items, or ``keys``), and ``_summary.json``
    with the counts and the seed.  A bucket is tens of items.
    """
    pretty = lambda c: F.encode(F.to_json(c, {"pretty": "true", "ignoreNullFields": "false"}), "UTF-8").alias("content")
    items = written(items, "manifest-items")  # read for the buckets, the keys and the counts
    buckets = documents(items, header)
    held = (items if keys is None else keys).filter(F.col(key).isNotNull()).agg(F.sort_array(F.collect_set(key)).alias("keys"))
    counts = buckets.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bucket", "count")))).alias("buckets"))
    summary = counts.crossJoin(held.select(F.size("keys").alias("held_out_clip_keys"))).select(F.struct(F.lit(seed).alias("seed"), "buckets", "held_out_clip_keys").alias("s"))  # a row and a row
    files = buckets.select(F.concat("bucket", F.lit(".json")).alias("path"), pretty(F.struct(*buckets.columns)))
    files = files.unionByName(held.select(F.lit(KEYS).alias("path"), pretty(F.col("keys")))).unionByName(summary.select(F.lit(SUMMARY).alias("path"), pretty(F.col("s"))))
    publish(files, path, overwrite)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """``seed, buckets, held_out_clip_keys`` of a lock: one small document, whose name Spark's own readers pass over."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{SUMMARY}")
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    told = F.from_json(F.lit(text), "seed long, buckets map<string, long>, held_out_clip_keys long")
    return spark.range(1).select(told.alias("s")).select("s.*")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The items of all manifests under a path, one row each; files named ``_*`` or ``held_out*`` and ones without items don't count."""
    found = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    if "items" not in found.columns:
        raise ValueError("no manifest with items")
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    rows = found.filter(~name.startswith("_") & ~name.startswith("held_out") & F.col("items").isNotNull())
    return rows.select(F.col("bucket").alias("manifest"), F.inline("items"))


def buckets(spark: SparkSession, path: str) -> DataFrame:
    """The names of all buckets of a lock, those without items, too."""
    return read_summary(spark, path).select(F.explode(F.map_keys("buckets")).alias("bucket"))


def write_keys(keys: DataFrame, path: str, key: str = "clip_key") -> None:
    """One JSON document: the sorted array of distinct keys. Held-out keys are as many as the evaluation's items."""
    array = keys.filter(F.col(key).isNotNull()).agg(F.to_json(F.sort_array(F.collect_set(key))).alias("value"))
    array.coalesce(1).write.mode("overwrite").text(path)


def read_keys(spark: SparkSession, path: str, key: str = "clip_key") -> DataFrame:
    """The keys of :func:`write_keys`, or of any file that is one JSON array of strings."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "array<string>")).alias(key)).distinct()


def write_audit(results: DataFrame, path: str) -> None:
    """References and hypotheses, a folder per bucket."""
    results.select("bucket", "id", "reference", "hypothesis").write.mode("overwrite").partitionBy("bucket").json(path)


def run_log(drawn: DataFrame, loss: float, accumulation: int) -> DataFrame:
    """One row of a run's figures: draws, unique clips, loss, loss a micro-batch, pools."""
    pools = drawn.groupBy("source").agg(F.count("*").alias("draws"), F.count_distinct("idx").alias("clips"))
    return pools.agg(
        F.sum("draws").alias("draws"), F.sum("clips").alias("unique_clips"), F.lit(loss).alias("loss"), F.lit(loss / accumulation).alias("loss_per_step"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", "clips"))), lambda s: F.concat_ws("=", s["source"], s["clips"].cast("string"))), ", ").alias("pools"),
    )
