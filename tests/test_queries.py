"""Every base query against its SQL on the smallest tables."""

import math
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

duckdb = pytest.importorskip("duckdb")

from swaraflow.plans import metric_queries, registry, text_queries  # noqa: E402, F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return repr(round(float(v), 6)) if hasattr(v, "as_tuple") else repr(v)


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.SQL:
        assert got
        return
    want = sql.sql(registry.SQL[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns and got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_loud_clips_equal_their_sql(spark, tmp_path):
    """Events above the scale of the clips' WAV cells, which would be cut there."""
    rng = random.Random(5)
    values = [[rng.uniform(1, 400) for _ in range(60 + u)] for u in range(12)]
    for own in values[::2]:
        own[3], own[17], own[40] = 499.9, 560.2, 1200.0
    rows = [(1000 * u + i, 1_000_000 * i, u, "click", v) for u, own in enumerate(values) for i, v in enumerate(own)]
    spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_micros("ts")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(u, f"text {u}") for u in range(12)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    for t in ("events", "documents"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df = registry.QUERIES["clip_pipeline"](spark, str(tmp_path))
    want = c.sql(registry.SQL["clip_pipeline"])
    at = [want.columns.index(n) for n in df.columns]
    got = sorted(tuple(map(plain, r)) for r in df.collect())
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall()) and sum("True" in r for r in got) == 12


def test_a_stream_is_read_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """A table of many parts reaches the stream in as many files, unshuffled; a small one in four."""
    for parts, want in ((9, 9), (1, 4)):
        place = str(tmp_path / f"t{parts}")
        spark.range(0, 900, 1, parts).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.lit("en").alias("lang"), (F.col("id") + 1).alias("n_chars")).write.parquet(f"{place}/documents.parquet")
        seen = []
        plain_ingest = metric_queries.ingest.ingest
        monkeypatch.setattr(metric_queries.ingest, "ingest", lambda session, source, *rest: seen.append((len(session.read.parquet(source).inputFiles()), rest[-1])) or plain_ingest(session, source, *rest))
        # each file a part of its own, as a large table's are
        spark.conf.set("spark.sql.files.openCostInBytes", "1g")
        try:
            row = metric_queries.stream_ingest_gate(spark, place).first()
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
        monkeypatch.undo()
        assert seen == [(want, math.ceil(want / 4))] and (row["n"], row["chars"]) == (541, sum(range(360, 901)))


def test_the_register_needs_no_session():
    """Queries and their SQL are listed before there is a session."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert told.returncode == 0 and told.stdout.endswith("True\n"), told.stderr[-500:]
