"""Windows for a model, collated batches, pitch, resampling, profiles."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from swaraflow.functions import pitch, signal
from swaraflow.operators import batches, profiles, windows
from swaraflow.sources.tables import new_place

# -- windows -----------------------------------------------------------------------------------------

RATE = 10


def model_by(log):
    """A model that writes down the size of each batch."""

    def make():
        def run(found, rate):
            with open(log, "a") as out:
                out.write(f"{len(found)}\n")
            return [np.array([w.sum(), len(w), w[0]]) for w in found]

        return run

    return make


def brute_path(samples, reference, window=20, least=10):
    found = []
    for start in range(0, max(1, len(samples) - window + 1), window):
        w = np.asarray(samples[start : start + window], float)
        if len(w) >= least:
            found.append(windows.cosine(np.array([w.sum(), len(w), w[0]]), np.asarray(reference, float)))
    return found


def test_trajectories_equal_row_by_row_and_batches_are_even(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=n)], [1.0, 2.0, float(i % 3)]) for i, n in enumerate([0, 5, 9, 10, 19, 20, 39, 40, 400, 25, 1, 60] * 3)]
    rows += [(100, None, [1.0, 0.0, 0.0]), (101, [1.0] * 45, None), (102, [0.0] * 40, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, samples array<double>, reference array<double>").coalesce(1)
    log = str(tmp_path / "log")
    got = {r["id"]: r for r in windows.similarity_trajectory(df, model_by(log), RATE, 2.0, 1.0, batch=8).collect()}
    for i, x, r in rows:
        want = [] if x is None or r is None else brute_path(x, r)
        assert got[i]["similarities"] == pytest.approx(want) and got[i]["similarity_drop"] == pytest.approx(want[0] - want[-1] if len(want) > 1 else 0.0)
    assert got[102]["similarities"] == [0.0, 0.0] and "samples" not in got[0].asDict()
    sizes = [int(x) for x in open(log)]
    assert len(sizes) > 5 and set(sizes[:-1]) == {8} and 0 < sizes[-1] <= 8  # a row of twenty windows, rows of one and of none
    assert windows.similarity_trajectory(df.limit(0), model_by(log), RATE).collect() == []


# -- batches -----------------------------------------------------------------------------------------


def test_any_batch_is_read_alone(spark):
    rows = [(d, list(range(d % 5 + 1)), [-100, *range(d % 5)]) for d in range(203)]
    drawn = spark.createDataFrame(rows, "draw_no long, input_ids array<int>, labels array<int>").repartition(5)
    index = batches.write_batches(batches.collated(drawn, 4, 9), shard_bytes=2000)
    entries = {r["batch"]: r for r in index.collect()}
    assert sorted(entries) == list(range(51)) and len({r["shard"] for r in entries.values()}) > 5 and entries[50]["rows"] == 3
    for number in (0, 17, 50):
        found = batches.batch(index, number).to_pylist()
        own = [r for r in rows if r[0] // 4 == number]
        width = max(len(r[1]) for r in own)
        assert entries[number]["width"] == width and [r["draw_no"] for r in found] == [r[0] for r in own]
        for r, (_, ids, labels) in zip(found, own, strict=True):
            pad = width - len(ids)
            assert (r["input_ids"], r["labels"], r["attention_mask"]) == (ids + [9] * pad, labels + [-100] * pad, [1] * len(ids) + [0] * pad)
    assert batches.batch(index, 51) is None
    assert batches.read_batches(index.filter("batch in (3, 4)")).count() == 8 and batches.read_batches(index).count() == 203
    place = entries[17]
    with pa.fs.FileSystem.from_uri(place["shard"])[0].open_input_file(pa.fs.FileSystem.from_uri(place["shard"])[1]) as source:
        assert place["offset"] + place["length"] <= source.size()
    assert batches.write_batches(batches.collated(drawn.limit(0), 4, 9)).collect() == []


# -- pitch -------------------------------------------------------------------------------------------


def cents(a, b):
    return 1200 * math.log2(a / b)


def tone(f, rate, seconds=1.0, harmonics=4):
    t = np.arange(int(rate * seconds)) / rate
    return sum(np.sin(2 * np.pi * f * k * t) / k for k in range(1, harmonics + 1) if f * k < rate / 2)


@pytest.mark.parametrize("rate", [8000, 16000, 24000])
@pytest.mark.parametrize("f", [82.4, 130.0, 220.0, 431.7, 900.0])
def test_tones(rate, f):
    found = pitch.track(0.3 * tone(f, rate), rate)
    inner = found[2:-2]
    assert np.isfinite(inner).mean() > 0.9 and all(abs(cents(x, f)) < 20 for x in inner[np.isfinite(inner)])


def test_sweep_noise_and_silence():
    rate = 16000
    t = np.arange(2 * rate) / rate
    f = 120 * 2 ** (t / 2)  # an octave in two seconds
    found = pitch.track(np.sin(2 * np.pi * np.cumsum(f) / rate) + 0.5 * np.sin(4 * np.pi * np.cumsum(f) / rate), rate)
    at = np.clip((np.arange(len(found)) * len(t) / (len(found) - 1)).astype(int), 0, len(t) - 1)
    good = [abs(cents(x, f[k])) for x, k in zip(found[3:-3], at[3:-3], strict=True) if np.isfinite(x)]
    assert len(good) > 0.9 * (len(found) - 6) and np.median(good) < 20 and max(good) < 60
    assert signal.pitch(np.zeros(rate), rate) == (None, None) and signal.pitch([], rate) == (None, None)
    rng = np.random.default_rng(2)
    assert np.isfinite(pitch.track(rng.normal(size=rate), rate)).mean() < 0.1
    gap = np.concatenate([tone(200, rate), np.zeros(rate), tone(300, rate)])
    found = pitch.track(gap, rate)
    third = len(found) // 3
    assert np.isnan(found[third + 4 : 2 * third - 4]).all() and abs(cents(np.nanmedian(found[:third]), 200)) < 20 and abs(cents(np.nanmedian(found[2 * third :]), 300)) < 20
    mean, spread = signal.pitch(tone(210, rate), rate)
    assert abs(cents(mean, 210)) < 20 and spread < 3


# -- resampling --------------------------------------------------------------------------------------


@pytest.mark.parametrize("rate, target", [(44100, 24000), (16000, 24000), (48000, 16000), (24000, 24000), (22050, 8000)])
def test_resampling_is_band_limited(rate, target):
    n, half = rate, min(rate, target) / 2
    level = lambda x: np.sqrt(np.mean(np.square(x[len(x) // 4 : -len(x) // 4])))
    for share in (0.05, 0.3, 0.6, 0.85):
        x = np.sin(2 * np.pi * share * half * np.arange(n) / rate)
        y = signal.resample(x, rate, target)
        assert len(y) == math.ceil(n * target / rate) and abs(20 * np.log10(level(y) / level(x))) < 0.1
        if rate != target:
            want = np.sin(2 * np.pi * share * half * np.arange(len(y)) / target)
            assert np.abs(y - want)[len(y) // 4 : -len(y) // 4].max() < 0.02  # in phase, too
    if target < rate:
        for share in (1.05, 1.3, 1.7):
            if share * half < rate / 2:
                x = np.sin(2 * np.pi * share * half * np.arange(n) / rate)
                assert 20 * np.log10(level(signal.resample(x, rate, target)) / level(x)) < -80
    assert len(signal.resample(np.ones(7), 3, 2)) == 5 and len(signal.resample(np.empty(0), 3, 2)) == 0


# -- profiles ----------------------------------------------------------------------------------------


def test_profiles_grow_by_shards(spark):
    value = F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id"), F.lit(100_003)).cast("double"))
    rows = spark.range(60_000).select((F.col("id") % 7).cast("string").alias("shard"), (F.col("id") % 3).alias("voice"), value.alias("v"))
    path, k = new_place(spark, "profiles"), 400
    for part in ("shard < '3'", "shard = '3'", "shard > '3'", "shard = '5'"):
        profiles.add(rows.filter(part), path, "shard", "voice", "v", F.col("v") < 1000, k)
    got = {r["voice"]: r for r in profiles.profile(spark, path, "voice", (0.1, 0.5, 0.9)).collect()}
    for voice in range(3):
        own = np.sort([r["v"] for r in rows.filter((F.col("voice") == voice) & F.col("v").isNotNull()).collect()])
        r = got[voice]
        assert (r["n"], r["least"], r["most"]) == (len(own), own[0], own[-1]) and r["mean"] == pytest.approx(own.mean()) and r["flagged"] == pytest.approx((own < 1000).mean())
        for share, value in zip((0.1, 0.5, 0.9), r["q"], strict=True):
            assert abs(np.searchsorted(own, value, side="right") / len(own) - share) <= profiles.rank_error(k)
    # what is added is written beside the old rows, which aren't read
    before = {f: spark.read.parquet(f).count() for f in spark.read.parquet(path).inputFiles() if "shard=2" in f}
    profiles.add(rows.filter("shard = '6'"), path, "shard", "voice", "v", F.col("v") < 1000, k)
    assert before.items() <= {f: spark.read.parquet(f).count() for f in spark.read.parquet(path).inputFiles()}.items()


def test_profiles_are_exact(spark):
    """Groups far larger than a sketch have the quantiles of a sort."""
    rows = spark.range(60_000).select((F.col("id") % 7).cast("string").alias("shard"), F.when(F.col("id") % 3 != 0, F.col("id") % 3).alias("voice"), F.pmod(F.xxhash64("id"), F.lit(40_009)).alias("v"))
    path, shares = new_place(spark, "profiles"), (0.001, 0.1, 0.5, 0.9, 0.999)
    for part in ("shard < '3'", "shard >= '3'", "shard = '5'"):
        profiles.add(rows.filter(part), path, "shard", "voice", "v", F.col("v") < 1000)
    got = {r["voice"]: r for r in profiles.profile(spark, path, "voice", shares).collect()}
    for voice in (None, 1, 2):
        own = np.sort([r["v"] for r in rows.filter(F.col("voice").eqNullSafe(F.lit(voice))).collect()])
        r = got[voice]
        assert r["q"] == [own[math.ceil(share * len(own)) - 1] for share in shares]
        assert (r["n"], r["least"], r["most"]) == (20_000, own[0], own[-1]) and r["mean"] == pytest.approx(own.mean()) and r["flagged"] == pytest.approx((own < 1000).mean())
