"""Sinks that commit, and lookups that skip row groups."""

import os
import re
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from swaraflow.sources import committed, keyed, manifests

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def files(spark, names, content="x"):
    return spark.createDataFrame([(n, f"{content} {n}".encode()) for n in names], "path string, content binary").repartition(3)


def there(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names}


def test_files_appear_and_are_replaced_as_one(spark, tmp_path):
    out = str(tmp_path / "out")
    committed.publish(files(spark, ["a.json", "sub/b.json", "c"]), out)
    assert there(out) == {"a.json", "sub/b.json", "c"} and os.listdir(tmp_path) == ["out"]
    with pytest.raises(Exception, match="there already"):
        committed.publish(files(spark, ["d"]), out)
    committed.publish(files(spark, ["d"], "new"), out, overwrite=True)
    assert there(out) == {"d"} and (tmp_path / "out/d").read_text() == "new d" and os.listdir(tmp_path) == ["out"]
    committed.publish(files(spark, []), out, overwrite=True)
    assert there(out) == set()


def test_a_failed_job_leaves_everything_as_it_was(spark, tmp_path):
    out = str(tmp_path / "out")
    committed.publish(files(spark, ["a"]), out)
    bad = files(spark, ["b", "c", "d"]).withColumn("content", F.when(F.col("path") == "d", F.raise_error(F.lit("broken"))).otherwise(F.col("content")))
    for broken, why in ((bad, "broken"), (files(spark, ["../e"]), "below"), (files(spark, ["f", "f"]), "same path")):
        with pytest.raises(Exception, match=why):
            committed.publish(broken, out, overwrite=True)
        assert there(out) == {"a"} and os.listdir(tmp_path) == ["out"]
    with pytest.raises(Exception, match="broken"):
        committed.publish(bad, str(tmp_path / "none"))
    assert os.listdir(tmp_path) == ["out"]


RETRY = """
import os, sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from swaraflow.sources import committed

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
out, mark = sys.argv[1:]


class FlakyWriter(committed.Writer):
    def write(self, rows):
        def once():
            for i, row in enumerate(rows):
                if i == 3 and not os.path.exists(mark):
                    open(mark, "w").close()
                    raise OSError("lost after three files")
                yield row

        return super().write(once())


class Flaky(committed.CommittedFiles):
    def writer(self, schema, overwrite):
        made = super().writer(schema, overwrite)
        made.__class__ = FlakyWriter
        return made


rows = spark.createDataFrame([(f"f{i}", b"whole" * 1000) for i in range(10)], "path string, content binary").coalesce(1)
committed.publish(rows, out, source=Flaky)
spark.stop()
"""


def test_a_task_that_fails_once_and_is_tried_again_leaves_no_half_file(tmp_path):
    script, out, mark = tmp_path / "retry.py", tmp_path / "out", tmp_path / "mark"
    script.write_text(textwrap.dedent(RETRY))
    run = subprocess.run([sys.executable, str(script), str(out), str(mark)], env={**os.environ, "PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=180)
    assert run.returncode == 0, run.stderr[-2000:]
    assert mark.exists() and there(out) == {f"f{i}" for i in range(10)} and {(out / f).read_bytes() for f in os.listdir(out)} == {b"whole" * 1000}
    assert sorted(os.listdir(tmp_path)) == ["mark", "out", "retry.py"]


def test_lock_has_keys_and_summary(spark, tmp_path):
    items = spark.createDataFrame([("b1", "b1_001", "k2", "मराठी"), ("b1", "b1_000", "k1", None), ("b2", "b2_000", None, "x")], "bucket string, id string, clip_key string, text string")
    header = spark.createDataFrame([("b1", True), ("b2", False), ("b3", False)], "bucket string, is_retention boolean")
    path = str(tmp_path / "lock")
    manifests.write(items, header, path, seed=3)
    assert there(path) == {"b1.json", "b2.json", "b3.json", "held_out_clip_keys.json", "_summary.json"}
    text = (tmp_path / "lock/b1.json").read_text()
    assert "\n" in text and text.index("b1_000") < text.index("b1_001") and "मराठी" in text
    told = manifests.read_summary(spark, path).first()
    assert (told["seed"], told["buckets"], told["held_out_clip_keys"]) == (3, {"b1": 2, "b2": 1, "b3": 0}, 2)
    assert sorted(r["id"] for r in manifests.read(spark, path).collect()) == ["b1_000", "b1_001", "b2_000"]
    assert sorted(r[0] for r in manifests.read_keys(spark, f"{path}/{manifests.KEYS}").collect()) == ["k1", "k2"]


def scanned(df):
    """Rows that the scan of a Parquet table gave, by its metric."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    leaves = [leaves.apply(i) for i in range(leaves.size())]
    leaves = [x.executedPlan().collectLeaves().apply(0) if "Adaptive" in x.nodeName() else x for x in leaves]
    return sum(x.metrics().apply("numOutputRows").value() for x in leaves if "Scan parquet" in x.nodeName())


def test_lookups_read_only_row_groups_with_needed_keys(spark, tmp_path):
    path = str(tmp_path / "keyed")
    rows = spark.range(40_000).select(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16).alias("clip_key"), "id", F.repeat(F.lit("v"), 40).alias("v"))
    keyed.write_keyed(rows.union(spark.sql("select null, -1L, 'n'")), "clip_key", path, row_group_bytes=64 << 10, page_bytes=8 << 10)
    groups = keyed.row_groups(spark, path, "clip_key").collect()
    assert len(groups) > 10 and sum(g["rows"] for g in groups) == 40_000
    ordered = sorted(groups, key=lambda g: g["low"])
    assert all(a["high"] < b["low"] for a, b in zip(ordered, ordered[1:], strict=False))  # ranges don't overlap
    needed = rows.filter("id in (5, 77, 12345)").select("clip_key").union(spark.createDataFrame([("absent",), (None,), ("0000",)], "clip_key string"))
    found = keyed.lookup(spark, path, needed, "clip_key", ["id"])
    assert sorted(r["id"] for r in found.collect()) == [5, 77, 12345]
    keys = [r[0] for r in needed.collect() if r[0]]
    hit = sum(g["rows"] for g in groups if any(g["low"] <= k <= g["high"] for k in keys))
    assert 0 < scanned(found) <= hit < 14_000  # a key that isn't there is stopped by the Bloom filter
    assert re.search(r"PushedFilters: \[.*In\(clip_key", found._jdf.queryExecution().toString())
    many = keyed.lookup(spark, path, rows.filter("id < 300").select("clip_key"), "clip_key", ["id"], most=50)
    assert sorted(r["id"] for r in many.collect()) == list(range(300))
    assert keyed.lookup(spark, path, needed.limit(0), "clip_key", ["id"]).collect() == []
