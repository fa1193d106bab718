"""Work that stops early, draws without a sort, and state that outlives a run."""

import io
import re
from contextlib import redirect_stdout

import duckdb
import pytest
from pyspark.sql import functions as F

from swaraflow.functions import tokens
from swaraflow.operators import clips, mixture, monitor, permutation, quota
from swaraflow.streaming import ingest, monitoring

CONTRACT = tokens.Contract()


def frames(n):
    return F.transform(F.sequence(F.lit(1), (7 * n).cast("int")), lambda i: F.lit(CONTRACT.snac_base) + ((i - 1) % 7) * 4096)


# -- quotas ------------------------------------------------------------------------------------------


@pytest.fixture
def sharded(spark, tmp_path):
    """Nine files of ten rows; every third row is short, every fifth too long."""
    for k in range(9):
        spark.range(10 * k, 10 * k + 10).withColumn("n", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 5 == 0, 9).otherwise(1)).coalesce(1).write.parquet(str(tmp_path / f"s{k}"))
    return [str(next((tmp_path / f"s{k}").glob("*.parquet"))) for k in range(9)]


def counting(spark):
    """A compile function whose audio decoder counts the rows that it gets."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def decode(n):
        seen.add(1)
        return n

    none = F.array().cast("array<int>")

    def compile(rows):
        decoded = rows.withColumn("decoded", decode("n"))
        audio = F.when(F.col("decoded") > 0, frames(F.col("decoded"))).otherwise(none)
        return clips.compiled(decoded, CONTRACT, audio, none, none, none)

    return compile, seen


def brute(n, longest_frames, cap, rows=90):
    fit = [i for i in range(min(rows, cap)) if i % 3 and (9 if i % 5 == 0 else 1) <= longest_frames]
    return fit[:n]


def test_shards_past_the_quota_are_not_decoded(spark, sharded):
    compile, seen = counting(spark)
    source = quota.files(spark, sharded)
    filled = quota.first_examples(source, compile, 4, 7 + 7)
    assert [r["id"] for r in filled.examples.collect()] == brute(4, 1, 32) and (filled.found, filled.opened, filled.scanned) == (4, 1, 10)
    assert seen.value <= 2 * 10  # one shard (a filter on the result may evaluate the function a second time)
    compile, seen = counting(spark)
    filled = quota.first_examples(source, compile, 9, 7 + 7)
    assert [r["id"] for r in filled.examples.collect()] == brute(9, 1, 72) and (filled.opened, filled.scanned) == (5, 50) and seen.value <= 2 * 50


def test_cap_counts_raw_rows(spark, sharded):
    """Rejected rows fill the cap, too, and rows past it are never decoded."""
    compile, seen = counting(spark)
    filled = quota.first_examples(quota.files(spark, sharded), compile, 14, 7 + 7, scan_factor=1)
    want = brute(14, 1, 14)
    assert len(want) < 14 and [r["id"] for r in filled.examples.collect()] == want and (filled.found, filled.scanned) == (len(want), 14) and seen.value <= 2 * 14
    more = quota.first_examples(quota.files(spark, sharded), compile, 500, 7 + 7)
    assert more.found == len(brute(500, 1, 4000)) and (more.opened, more.scanned) == (9, 90)


def test_plan_of_several_sources(spark, sharded):
    compile, _ = counting(spark)
    empty = spark.read.parquet(sharded[0]).filter("id < 0")
    sources = {"p": quota.files(spark, sharded), "q": quota.whole(empty, "id"), "r": quota.whole(spark.read.parquet(*sharded), "id")}
    found, report = quota.compile_plan(sources, compile, {"p": 3, "q": 2, "r": 5}, 100)
    assert {r["source"]: (r["n"], r["scanned"]) for r in report.collect()} == {"p": (3, 10), "q": (0, 0), "r": (5, 40)}
    assert sorted(r["id"] for r in found.filter("source = 'r'").collect()) == brute(5, 9, 40) and "shard" not in found.columns
    with pytest.raises(ValueError):
        quota.compile_plan({}, compile, {}, 100)


# -- draws -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 3, 7, 10, 49, 50, 97, 1000])
def test_permutation(spark, size):
    for key in ("a", "b:3"):
        rows = spark.range(size).select("id", permutation.permuted(F.col("id"), size, F.lit(key)).alias("to")).collect()
        assert sorted(r["to"] for r in rows) == list(range(size))
        assert all(r["to"] == permutation.permuted_index(r["id"], size, key) for r in rows)
        told = duckdb.sql(f"select i, {permutation.sql('i', 'n', 'k')} from (select unnest(range({size})) as i, {size} as n, '{key}' as k)").fetchall()
        assert {r["id"]: r["to"] for r in rows} == dict(told)


def test_permutations_differ_and_mix():
    size = 5000
    one, other = ([permutation.permuted_index(i, size, k) for i in range(size)] for k in "xy")
    assert sum(a == b for a, b in zip(one, other, strict=True)) < 20
    steps = [abs(a - b) for a, b in zip(one, one[1:], strict=False)]
    assert abs(sum(steps) / len(steps) - size / 3) < size / 30  # neighbours end up as far apart as at random
    assert permutation.radices(10**12) == (10**6, 10**6) and 0 <= permutation.permuted_index(123456789012, 10**12 + 7, "k") < 10**12 + 7


SIZES = dict(zip(mixture.WEIGHTS, (50, 30, 20, 10), strict=True))


def test_draws(spark):
    drawn = mixture.draws(spark, SIZES, mixture.WEIGHTS, 25, 10, seed=3)
    got = drawn.collect()
    assert sorted(r["draw_no"] for r in got) == list(range(250)) and all(r["window"] == r["draw_no"] // 25 for r in got)
    for w in range(10):
        assert [sum(r["window"] == w and r["source"] == n for r in got) for n in SIZES] == [14, 6, 4, 1]
    for name, n in SIZES.items():
        used = [r["idx"] for r in sorted(got, key=lambda r: r["draw_no"]) if r["source"] == name]
        counts = [used.count(i) for i in range(n)]
        assert max(counts) - min(counts) <= 1  # nothing comes again before all have come
    again, other = (mixture.draws(spark, SIZES, mixture.WEIGHTS, 25, 10, seed=s).collect() for s in (3, 4))
    assert sorted(map(tuple, again)) == sorted(map(tuple, got)) != sorted(map(tuple, other))
    for bad in ({**SIZES, "rasa_marathi": 0}, {"springlab_marathi": 4}):
        with pytest.raises(ValueError):
            mixture.draws(spark, bad, mixture.WEIGHTS, 25, 1)
    unused = mixture.draws(spark, {**SIZES, "spare": 0}, {**mixture.WEIGHTS, "spare": 0.0}, 25, 2)  # a source that isn't drawn may be empty
    assert unused.filter("source = 'spare'").count() == 0 and unused.count() == 50


def test_draws_need_no_shuffle(spark):
    plan = io.StringIO()
    with redirect_stdout(plan):
        mixture.draws(spark, SIZES, mixture.WEIGHTS, 25, 1000).explain("formatted")
    assert not re.search("Exchange|Sort|Join|Window|Python", plan.getvalue())


def test_endless_draws_equal_the_table(spark, tmp_path):
    stream = ingest.draw_stream(spark, SIZES, mixture.WEIGHTS, 25, 3, rows_per_second=200)
    kept = stream.writeStream.format("memory").queryName("draws").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(40):
            kept.awaitTermination(1)
            if spark.table("draws").count() >= 250:
                break
        got = {tuple(r) for r in spark.table("draws").filter("draw_no < 250").collect()}
    finally:
        kept.stop()
    assert got == {tuple(r) for r in mixture.draws(spark, SIZES, mixture.WEIGHTS, 25, 10, 3).collect()}


# -- monitoring --------------------------------------------------------------------------------------

SERIES = [("r", s, b, w) for s, x, y in ((0, 0.9, 0.9), (5, 9.0, 9.0), (10, 0.2, 0.4), (20, 0.22, 0.3), (30, 0.3, 0.4), (40, 0.1, 0.1)) for b, w in (("a", x), ("b", y))] + [("r", 30, "new", 5.0), ("s", 20, "a", 0.0), ("s", 30, "a", 0.1)]


def test_monitor_keeps_its_baseline_over_restarts(spark, tmp_path):
    series = spark.createDataFrame(SERIES, "run string, step int, bucket string, wer double")
    rows = monitoring.evaluations(series)
    for part in ("step <= 10", "step = 20", "step > 20"):
        rows.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        monitoring.watch(stream, str(tmp_path / "out"), str(tmp_path / "marker"), str(tmp_path / "cp"), 10).awaitTermination()
    kind = "run string, step long, wer map<string, double>, relative_regression map<string, double>, worst double, alert boolean"
    got = {(r["run"], r["step"]): r for r in spark.read.schema(kind).json(str(tmp_path / "out")).collect()}
    assert sorted(got) == [("r", 10), ("r", 20), ("r", 30), ("r", 40), ("s", 20), ("s", 30)]
    batch = monitor.changes(series.filter("run = 'r'"), 10).collect()
    assert {(r["step"], r["bucket"]): pytest.approx(r["regression"]) for r in batch} == {(s, b): x for (run, s), r in got.items() if run == "r" for b, x in r["relative_regression"].items()}
    alerts = {r["step"]: (pytest.approx(r["worst"]), r["alert"]) for r in monitor.alerts(series.filter("run = 'r'"), 10).collect()}
    assert alerts == {s: (r["worst"], r["alert"]) for (run, s), r in got.items() if run == "r"}
    assert got["r", 30]["wer"]["new"] == 5.0 and "new" not in got["r", 30]["relative_regression"]
    assert got["s", 30]["worst"] == pytest.approx(1e5) and got["r", 40]["worst"] == 0.0
    assert {(r["run"], r["step"]) for r in spark.read.schema(kind).json(str(tmp_path / "marker")).collect()} == {("r", 30), ("s", 30)}


def test_monitor_with_a_given_baseline(spark, tmp_path):
    rows = monitoring.evaluations(spark.createDataFrame(SERIES, "run string, step int, bucket string, wer double"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    monitoring.watch(stream, str(tmp_path / "out"), str(tmp_path / "marker"), str(tmp_path / "cp"), 20, baseline={"a": 0.2}).awaitTermination()
    got = {(r["run"], r["step"]): round(r["worst"], 6) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {("r", 20): 0.1, ("r", 40): 0.0, ("s", 20): 0.0}
