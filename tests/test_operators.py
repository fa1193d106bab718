import hashlib
import json
import math
import os
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from swaraflow.functions import signal, tokens
from swaraflow.operators import clips, gates, hooks, lookups, metrics, mixture, monitor, panel, parameters, routing, voices
from swaraflow.sources import config, manifests, plans, scan, shared
from swaraflow.streaming import ingest

CAND = "clip_key string, language_id string, source_hf_path string, rasa_style string, num_digits int, num_english_words int, speaker string, text string"


def candidate(key, language="mr", source=routing.ANCHOR, style=None, digits=0, english=0, speaker="Anagha", text="t"):
    return (key, language, source, style, digits, english, speaker, text)


def test_routing_priority(spark):
    rows = [
        (candidate("h1", digits=2, style="WIKI"), "marathi_adversarial"),
        (candidate("h2", style="PROPER NOUN"), "marathi_adversarial"),
        (candidate("h3", english=3), "marathi_code_switch"),
        (candidate("h4", style="WIKI"), "marathi_stem_seen_voice"),
        (candidate("h5", style="UMANG"), "retention_rasa_marathi"),
        (candidate("h6", source=routing.PRIMARY), "marathi_general_unseen_domain"),
        (candidate("h7", "hi", "x"), "retention_hindi"),
        (candidate("h8", "en", "x"), "retention_english"),
        (candidate("h9", "mr", "x"), None),
        (candidate("h10", style=" proper_noun "), "marathi_adversarial"),
    ]
    got = {r["clip_key"]: r["b"] for r in spark.createDataFrame([r for r, _ in rows], CAND).select("clip_key", routing.routed().alias("b")).collect()}
    assert got == {r[0]: b for r, b in rows}


def test_chosen_is_disjoint_capped_and_stable(spark):
    rows = [candidate(f"{k}{i}", **how) for i in range(60) for k, how in (("a", {"digits": 1}), ("c", {"english": 1}), ("h", {"language": "hi", "source": "x"}))]
    df = spark.createDataFrame(rows, CAND).withColumn("bucket", routing.routed())
    items = routing.chosen(df)
    got = items.collect()
    assert len({r["clip_key"] for r in got}) == len(got) == 40 + 30 + 40
    assert sorted(r["id"] for r in got if r["bucket"] == "marathi_code_switch") == [f"marathi_code_switch_{i:03d}" for i in range(30)]
    assert routing.overlaps(items).count() == 0 and {r[0] for r in routing.held_out_keys(items).collect()} == {r["clip_key"] for r in got}
    assert sorted(map(str, routing.chosen(df.orderBy(F.desc("clip_key"))).select("id", "clip_key").collect())) == sorted(map(str, items.select("id", "clip_key").collect()))
    assert {r["bucket"]: r["n"] for r in routing.summary(items).collect()}["marathi_longform"] == 0
    assert "WindowGroupLimit" in items._jdf.queryExecution().executedPlan().toString()


def test_longform(spark):
    rows = [(s, f"{i:02d}", c * 200) for s, c, n in (("A", "a", 7), ("B", "b", 2)) for i in range(n)]
    got = routing.longform(spark.createDataFrame(rows, "speaker string, ord string, text_normalized string")).orderBy("id").collect()
    assert [(r["speaker"], r["target_seconds"]) for r in got] == [("A", 50.0), ("A", 50.0), ("B", 33.3)]
    assert got[0]["text"] == " ".join(["a" * 200] * 3)
    assert len(routing.longform(spark.createDataFrame(rows, "speaker string, ord string, text_normalized string"), count=1).collect()) == 1


def test_gates(spark):
    rows = [
        ("Unknown", 0.1, "", 5.0, 0.0, True, "license_unknown", []),
        ("CC-BY-4.0", 0.49, "x", 30.0, 0.0, True, "duration_out_of_[0.5,20.0]", []),
        ("CC-BY-4.0", 0.5, "x", 30.0, 0.0, True, None, []),
        ("CC-BY-4.0", 20.0, "x", 30.0, 0.0, True, None, []),
        ("CC-BY-4.0", 3.0, "  ", 30.0, 0.0, True, "empty_normalized_text", []),
        ("CC-BY-4.0", 3.0, "x", 15.0, 0.01, True, None, []),
        ("CC-BY-4.0", 3.0, "x", 14.9, 0.02, False, None, ["snr<15.0", "clip>0.01", "narrowband"]),
        (None, 3.0, "x", 30.0, 0.0, True, "license_unknown", []),
    ]
    df = spark.createDataFrame([(i, *r[:6]) for i, r in enumerate(rows)], "i int, license string, d double, t string, snr double, clip double, wide boolean")
    g = gates.gated(gates.hard_reject(F.col("license"), F.col("d"), F.col("t")), F.when(F.col("snr") < 20, gates.soft_flags(F.col("snr"), F.col("clip"), F.col("wide"))).otherwise(F.array().cast("array<string>")))
    got = df.select("i", g.alias("g")).orderBy("i").collect()
    assert [(r["g"]["hard_reject"], r["g"]["soft_flags"]) for r in got][1:] == [(r[6], r[7]) for r in rows][1:] and got[0]["g"]["hard_reject"] == "license_unknown"
    assert [r["g"]["kept"] for r in got] == [r[6] is None for r in rows]


def test_clip_validation(spark):
    rows = [("ok", 1.0, 0.0, "mr", "Deva", "Anagha", None, None), ("u", 1.0, 0.0, "mr", "Deva", "Nobody", None, "unknown_speaker"), ("g", 1.0, 0.0, "mr", "Deva", "Anagha", "M", "gender_mismatch"), ("d", -1.0, 0.0, "mr", "Deva", "Anagha", None, "duration"), ("c", 1.0, 1.5, "mr", "Deva", "Anagha", None, "clipping_ratio"), ("s", 1.0, 0.0, "en", "Deva", "Amit", None, "script_language")]
    df = spark.createDataFrame([r[:7] for r in rows], "k string, d double, c double, lang string, script string, speaker string, gender string")
    spans = F.array(F.struct(F.lit(2).alias("start"), F.lit(3).alias("end")))
    problem = gates.clip_problem(F.lit(8000), F.col("d"), F.col("c"), F.col("lang"), F.col("script"), spans, F.lit("x"), F.col("speaker"), F.col("gender"))
    good, bad = gates.split_valid(df, problem)
    assert [r["k"] for r in good.collect()] == ["ok"] and {r["k"]: r["problem"] for r in bad.collect()} == {r[0]: r[7] for r in rows[1:]}
    with pytest.raises(Exception, match="invalid clip"):
        gates.assert_valid(df, problem).collect()


def test_voices(spark):
    assert voices.roster(spark).count() == 44 and voices.native_voices("mr") == ["Anagha", "Chinmay"]
    rows = [(routing.PRIMARY, "0", "Anagha"), (routing.PRIMARY, "1", "Chinmay"), (routing.ANCHOR, " female", "Anagha"), (routing.ANCHOR, "MALE", "Chinmay"), ("SPRINGLab/IndicTTS-English", None, "Amit"), ("SPRINGLab/IndicTTS-Hindi", "0", "Kavya")]
    df = spark.createDataFrame([r[:2] for r in rows], "s string, g string")
    got = df.select(voices.assigned(F.col("s"), F.col("g")).alias("v")).select("v", voices.voice_gender(F.col("v")).alias("g"), voices.native_language(F.col("v")).alias("l"))
    assert [r["v"] for r in got.collect()] == [r[2] for r in rows] and got.first()["l"] == "mr"
    with pytest.raises(Exception, match="no voice rule"):
        spark.createDataFrame([("other", "1")], "s string, g string").select(voices.assigned(F.col("s"), F.col("g"))).collect()


def test_lookups(spark):
    keyed = lambda *k: spark.createDataFrame([(x,) for x in k], "clip_key string")
    assert {r[0] for r in lookups.without_held_out(keyed("a", "b", "c"), keyed("b")).collect()} == {"a", "c"}
    locked, added = keyed("a", "b"), keyed("b", "c")
    once = lookups.amended(locked, added)
    assert sorted(r[0] for r in lookups.amended(once, added).collect()) == ["a", "b", "c"] == sorted(r[0] for r in lookups.key_union(locked, added).collect())
    items = spark.createDataFrame([("1", "s", "p", "a"), ("2", "s", "p", None), ("3", "z", "p", "a")], "id string, source_id string, shard string, clip_key string")
    clips = spark.createDataFrame([("s", "p", "a", 7)], "source_id string, shard string, clip_key string, samples int")
    assert {r["id"]: r["samples"] for r in lookups.with_reference(items, clips).collect()} == {"1": 7, "2": None, "3": None}
    assert lookups.unknown_names(keyed("a", "q"), keyed("a"), "clip_key").collect()[0][0] == "q"
    both = lookups.union_sources([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")]).collect()
    assert {tuple(r) for r in both} == {(1, None), (None, 2)}


@pytest.mark.parametrize("size, want", [(100, [56, 24, 15, 5]), (20, [11, 5, 3, 1]), (4, [2, 1, 1, 0]), (25, [14, 6, 4, 1]), (32, [18, 8, 5, 1])])
def test_seats(size, want):
    assert list(mixture.seats(size, mixture.WEIGHTS).values()) == want


def test_quotas(spark):
    plan = spark.createDataFrame([("p", c) for c in "abc"], "pool string, entry string")
    got = mixture.quotas(plan, spark.createDataFrame([("p", 7)], "pool string, target long")).orderBy("entry").collect()
    assert [r["quota"] for r in got] == [3, 3, 1]


VALUES = [0.1, 0.2, 0.05, 0.3, 0.15, 0.25, 0.08, 0.3]


def test_bootstrap(spark):
    point, low, high = metrics.bootstrap(np.array(VALUES), seed=1)
    rng = np.random.default_rng(1)
    means = [np.array(VALUES)[rng.integers(0, 8, 8)].mean() for _ in range(1000)]
    assert point == pytest.approx(np.mean(VALUES)) and (low, high) == (pytest.approx(np.percentile(means, 2.5)), pytest.approx(np.percentile(means, 97.5)))
    assert all(map(math.isnan, metrics.bootstrap(np.array([]))))
    rows = spark.createDataFrame([("b", i, v) for i, v in enumerate(VALUES)], "bucket string, id int, v double")
    got = metrics.bootstrap_ci(rows, "bucket", "v", "id", seed=1).first()
    assert (got["low"], got["high"]) == (pytest.approx(low), pytest.approx(high))
    wide = spark.range(2000).select(F.lit("b").alias("bucket"), "id", (F.col("id") % 10 / 10).alias("v"))
    p = metrics.split_bootstrap_ci(wide, "bucket", "v", "id").first()
    assert p["low"] < p["point"] < p["high"] and p["high"] - p["low"] == pytest.approx(3.92 * 0.287 / math.sqrt(2000), rel=0.15)
    # the same sums by hand, whatever the partitioning
    keys = np.array([int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in range(2000)], np.int64)
    weights, x = metrics._poisson_weights(keys, 1000, 0), np.arange(2000) % 10 / 10
    means = (x @ weights) / weights.sum(axis=0)
    assert (p["low"], p["high"]) == (pytest.approx(np.percentile(means, 2.5)), pytest.approx(np.percentile(means, 97.5))) and abs(weights.mean() - 1) < 0.01
    odd = spark.createDataFrame([(None, 1, 0.5), ("x", 2, None), ("x", 3, 0.25)], "bucket string, id int, v double")
    got = {r["bucket"]: r for r in metrics.split_bootstrap_ci(odd, "bucket", "v", "id").collect()}
    assert got[None]["point"] == 0.5 and got["x"]["point"] == 0.25 and metrics.split_bootstrap_ci(odd.limit(0), "bucket", "v", "id").count() == 0


def test_wer_panel(spark):
    rows = [("1", "a", "the cat on mat", "the dog on", True), ("2", "a", "a b c", "a b c", False), ("3", "b", " ", "x y", False)]
    results = spark.createDataFrame(rows, "id string, bucket string, reference string, hypothesis string, hit boolean")
    got = {r["bucket"]: r for r in panel.wer_panel(results, spark.createDataFrame([("a",), ("b",), ("c",)], "bucket string")).collect()}
    assert (got["a"]["wer"], got["a"]["wer_mean_utterance"], got["a"]["ref_words"], got["a"]["hit_rate"]) == (pytest.approx(2 / 7), 0.25, 7, 0.5)
    assert got["b"]["wer_mean_utterance"] == 0.0 and got["c"]["n"] == 0 and got["c"]["wer"] is None
    page = panel.report(panel.wer_panel(results, results.select("bucket").distinct()), title="<t>")
    assert "&lt;t&gt;" in page and "<td>0.286</td>" in page and "Long prompts" not in page and page.count("<tr>") == 3
    exact = {r["bucket"]: r for r in panel.wer_panel(results, results.select("bucket").distinct(), seed=1, bounded=True).collect()}
    assert (exact["a"]["low"], exact["a"]["high"]) == tuple(pytest.approx(x) for x in metrics.bootstrap(np.array([0.5, 0.0]), seed=1)[1:])


def test_full_panel_and_its_sinks(spark, tmp_path):
    results = spark.createDataFrame([("1", "a", "x y", "x z", True)], "id string, bucket string, reference string, hypothesis string, hit boolean")
    names = spark.createDataFrame([("a",), ("empty",), (routing.LONGFORM,)], "bucket string")
    vectors = spark.createDataFrame([("a", "A", [1.0, 0.0]), ("a", "C", [0.0, 1.0])], "bucket string, speaker string, vector array<double>")
    long = spark.createDataFrame([(routing.LONGFORM, [7] * 14, True), (routing.LONGFORM, [1, 2, 3, 4, 5, 6, 7], False)], "bucket string, token_ids array<int>, hit boolean")
    prosody = spark.createDataFrame([("a", 1.0, None, 2.0, 0.0)], "bucket string, mean_f0 double, f0_std double, energy_std double, pause_ratio double")
    whole = panel.full_panel(results, names, long, panel.voice_breakdown(vectors, vectors), panel.prosody_means(prosody))
    got = {r["bucket"]: r for r in whole.collect()}
    assert (got["a"]["wer"], got["a"]["by_voice"], got["a"]["energy_std"], got["a"]["hit_rate"]) == (0.5, {"A": 1.0, "C": 1.0}, 2.0, 1.0)
    assert (got["empty"]["n"], got[routing.LONGFORM]["n"], got[routing.LONGFORM]["hit_rate"], got[routing.LONGFORM]["mean_frames"]) == (0, 2, 0.5, 1.5)
    panel.write_json(whole, str(tmp_path / "panel"))
    (part,) = (tmp_path / "panel").glob("part-*")
    assert json.loads(part.read_text())["buckets"]["a"]["substitutions"] == 1
    page = panel.report(whole, panel.longform_panel(long))
    assert "A 1.000, C 1.000" in page and "Long prompts" in page and "<th>repetition_rate_3gram</th>" in page
    records = panel.longform_records(long.withColumn("similarities", F.when(F.col("hit"), F.array(F.lit(0.9), F.lit(0.5), F.lit(0.6))).otherwise(F.array(F.lit(0.3))))).collect()
    assert sorted((r["n_frames"], round(r["similarity_drop"], 9)) for r in records) == [(1, 0.0), (2, 0.3)]


def test_similarity_needs_no_pairs(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(7, 4)), rng.normal(size=(5, 4))
    a[0] = 0
    frame = lambda m: spark.createDataFrame([("g", [float(x) for x in v]) for v in m], "g string, v array<double>")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    got = metrics.mean_pairwise_similarity(frame(a), frame(b), "g", "v").first()["similarity"]
    assert got == pytest.approx((unit(a) @ unit(b).T).mean())
    assert math.isnan(metrics.mean_pairwise_similarity(frame(a), frame(b[:0]), "g", "v").first()["similarity"])


def test_voice_breakdown_only_for_several(spark):
    rows = spark.createDataFrame([("m", "A", [1.0, 0.0]), ("m", "C", [0.0, 1.0]), ("s", "A", [1.0, 0.0])], "bucket string, speaker string, vector array<double>")
    got = {r["bucket"]: r for r in panel.voice_breakdown(rows, rows).collect()}
    assert got["m"]["by_voice"] == {"A": 1.0, "C": 1.0} and got["m"]["speaker_similarity"] == pytest.approx(0.5) and got["s"]["by_voice"] is None


def test_regressions(spark, tmp_path):
    frame = lambda d: spark.createDataFrame(list(d.items()), "bucket string, wer double")
    changed = metrics.regressions(frame({"a": 0.3, "b": 0.1, "new": 9.0}), frame({"a": 0.2, "b": 0.2}))
    assert {r["bucket"]: round(r["regression"], 6) for r in changed.collect()} == {"a": 0.5, "b": -0.5}
    assert tuple(metrics.worst(changed).first()) == (pytest.approx(0.5), True) and tuple(metrics.worst(changed.limit(0)).first()) == (0.0, False)
    series = spark.createDataFrame([(s, "a", w) for s, w in ((0, 0.2), (5, 9.0), (10, 0.22), (20, 0.3))], "step int, bucket string, wer double")
    assert {r["step"]: r["alert"] for r in monitor.alerts(series, 10).collect()} == {10: False, 20: True}  # step 0 is never due
    assert monitor.alerts(series.filter("step > 5"), 10).filter("step = 20").first()["worst"] == pytest.approx((0.3 - 0.22) / 0.22)
    given = monitor.alerts(series, 10, baseline=frame({"a": 0.1}))
    assert {r["step"]: round(r["worst"], 6) for r in given.collect()} == {10: 1.2, 20: 2.0}
    marker = str(tmp_path / "marker")
    assert monitor.mark(given, marker) and sorted(r["step"] for r in spark.read.json(marker).collect()) == [10, 20]
    assert not monitor.mark(given.limit(0), str(tmp_path / "none")) and not os.path.exists(tmp_path / "none")


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    data = [("a", float(x)) for x in rng.normal(size=900)] + [("ties", float(x)) for x in rng.integers(0, 4, 500)] + [("one", 7.0), (None, 1.0), (None, 2.0), ("a", None), ("nulls", None)]
    rows = spark.createDataFrame(data, "g string, v double").repartition(5)
    shares = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = {r["g"]: r["q"] for r in metrics.percentiles(rows, "g", "v", shares, cuts=16).collect()}
    assert set(got) == {"a", "ties", "one", None}
    for g, q in got.items():
        assert q == pytest.approx(np.percentile([v for k, v in data if k == g and v is not None], [100 * s for s in shares]).tolist())
    assert metrics.percentiles(rows.limit(0), "g", "v", shares).count() == 0


def test_prosody_skips_missing(spark):
    rows = spark.createDataFrame([("1", "b", 1.0, None, 2.0, 0.0), ("2", "b", None, None, 4.0, 1.0)], "id string, bucket string, mean_f0 double, f0_std double, energy_std double, pause_ratio double")
    got = panel.prosody_means(rows).first()
    assert (got["mean_f0"], got["energy_std"]) == (1.0, 3.0) and math.isnan(got["f0_std"])
    assert [r["delta_mean_f0"] for r in panel.prosody_deltas(rows, rows).orderBy("id").collect()] == [0.0, None]


def test_parameters(spark):
    rows = parameters.targets(spark, 28, (8, 24))
    got = parameters.adapter_parameters(rows, 3072, 24, 8, 128, 8192, 32)
    assert got.agg(F.sum("parameters")).first()[0] == 21_430_272 and len(names := parameters.target_names(rows)) == 2 + 34
    assert {"q_proj", "v_proj", "model.layers.8.mlp.up_proj", "model.layers.24.mlp.gate_proj"} <= set(names)
    table = parameters.frozen(spark.createDataFrame([("a.lora_A", 10), ("b", 90)], "name string, numel long"))
    r = parameters.freeze_report(table).first()
    assert (r["trainable"], r["total"], r["percent"], r["frozen_adapters"], r["trained_base"]) == (10, 100, 10.0, 0, 0)


def test_manifests(spark, tmp_path):
    items = spark.createDataFrame([("b1", "b1_000", "k1"), ("b1", "b1_001", "k2")], "bucket string, id string, clip_key string")
    header = spark.createDataFrame([("b1", False), ("b2", True)], "bucket string, is_retention boolean")
    manifests.write(items, header, str(tmp_path / "m"))
    assert sorted(tuple(r) for r in manifests.read(spark, str(tmp_path / "m")).select("manifest", "id", "clip_key").collect()) == [("b1", "b1_000", "k1"), ("b1", "b1_001", "k2")]
    (tmp_path / "n").mkdir()
    for name in ("x.json", "_summary.json", "held_out_keys.json"):
        (tmp_path / "n" / name).write_text(json.dumps({"bucket": name, "items": [{"id": "1"}]}))
    assert [r["manifest"] for r in manifests.read(spark, str(tmp_path / "n")).collect()] == ["x.json"]
    manifests.write_audit(spark.createDataFrame([("b", "1", "r", "h")], "bucket string, id string, reference string, hypothesis string"), str(tmp_path / "a"))
    assert os.path.isdir(tmp_path / "a" / "bucket=b")
    keys = spark.createDataFrame([("k2",), ("k1",), ("k2",), (None,)], "clip_key string")
    manifests.write_keys(keys, str(tmp_path / "k"))
    (part,) = (tmp_path / "k").glob("part-*")
    assert json.loads(part.read_text()) == ["k1", "k2"] and sorted(r[0] for r in manifests.read_keys(spark, str(tmp_path / "k")).collect()) == ["k1", "k2"]


def test_scan_and_plan(spark, tmp_path):
    spark.range(5).select("id", F.struct(F.lit(b"x").alias("bytes"), F.concat(F.lit("p"), "id").alias("path")).alias("audio"), F.lit("t").alias("text")).coalesce(1).write.parquet(str(tmp_path / "s1"))
    spark.range(2).select(F.col("id").alias("gender"), F.lit("u").alias("text")).coalesce(1).write.parquet(str(tmp_path / "s2"))
    rows = scan.scan(spark, str(tmp_path / "s1"), ["audio.path", "text"])
    assert [tuple(r) for r in rows.orderBy("_idx").collect()][0] == ("p0", "t", 0) and "bytes" not in rows._jdf.queryExecution().executedPlan().toString()
    plan = [scan.Read("a", "mr", str(tmp_path / "s1"), ("audio.path", "text"), "pool1", None, 3), scan.Read("b", "hi", str(tmp_path / "s2"), ("text", "gender"), "pool2", "Amit")]
    got = scan.read_plan(spark, plan)
    assert got.count() == 5 and {tuple(r) for r in got.select("pool", "forced_speaker", "shard").distinct().collect()} == {("pool1", None, "s1"), ("pool2", "Amit", "s2")}
    with pytest.raises(ValueError):
        scan.read_plan(spark, [])


def test_places_in_a_shard_of_several_files(spark, tmp_path):
    """A folder's rows are numbered through, not anew in each file."""
    rows = spark.range(0, 50, 1, 5).select("id", F.struct(F.lit(b"x").alias("bytes"), F.col("id").cast("string").alias("path")).alias("audio"))
    rows.write.parquet(str(tmp_path / "s"))
    found = scan.scan(spark, str(tmp_path / "s"), ["id", "audio.path"])
    assert found.columns == ["id", "path", "_idx"] and sorted(map(tuple, found.collect())) == [(i, str(i), i) for i in range(50)]
    assert "bytes" not in found._jdf.queryExecution().executedPlan().toString()
    got = scan.read_plan(spark, [scan.Read("a", "mr", str(tmp_path / "s"), ("id",)), scan.Read("b", "mr", str(tmp_path / "s"), ("id",), limit=12)])
    assert {(r[0], r[1], r[2]) for r in got.groupBy("source_hf_path").agg(F.count("*"), F.count_distinct("_idx")).collect()} == {("a", 50, 50), ("b", 12, 12)}


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.range(40).select("id", (F.col("id") % 7).alias("v"))
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    gate = lambda df: df.filter("v > 2")
    q = ingest.ingest(spark, str(tmp_path / "in"), docs.schema, gate, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(r["id"] for r in gate(docs).collect())


class Fake:
    def encode(self, text, add_special_tokens=False):
        return [ord(c) % 100 for c in text]

    def transcribe(self, samples, rate, language=None):
        return f"{len(samples)} {language}"


def test_hooks(spark):
    rows = spark.createDataFrame([("ab", "A", "mr")], "text string, speaker string, language_id string")
    said = hooks.synthesized(hooks.tokenized(rows, Fake), lambda: lambda text, speaker: ([0.0] * len(text), [1, 2], False))
    got = hooks.embedded(hooks.transcribed(said, Fake, 8000), lambda: lambda x, rate: x + 1, 8000).first()
    assert (got["text_ids"], got["hypothesis"], got["vector"], got["hit"]) == ([97, 98], "2 mr", [1.0, 1.0], False)
    assert hooks.transcribed(said, Fake, 8000, forward_language=False).first()["hypothesis"] == "2 None"


def test_decoder_pairs(spark):
    rows = spark.createDataFrame([([1, 2, 3],)], "token_ids array<int>")
    pairs = hooks.decoded_pairs(rows, lambda: lambda ids: np.sin(np.arange(4000) / 9) * 2, lambda: lambda ids: np.sin(np.arange(3000) / 9))
    got = pairs.select(F.array_max("samples").alias("top"), signal.decode_comparison("samples", "stock_samples", F.lit(8000)).alias("c")).first()
    assert got["top"] == 1.0 and (got["c"]["first_seconds"], got["c"]["second_seconds"]) == (0.5, 0.375) and 0.3 < got["c"]["mel_correlation"] <= 1
    x = np.random.default_rng(1).normal(size=8000)
    assert signal.mel_correlation(x, x, 8000) == pytest.approx(1.0)


def test_waves_are_written_by_slug(spark, tmp_path):
    rows = spark.createDataFrame([(0, "Hello, World!", [0.0, 0.5], [0.1]), (1, "??", [0.25], None)], "idx int, text string, samples array<double>, stock_samples array<double>")
    signal.write_waves(rows, str(tmp_path / "waves"), 8000)
    assert sorted(os.listdir(tmp_path / "waves")) == ["00_hello_world.wav", "00_hello_world_stock.wav", "01_utt.wav"]
    assert signal.decode((tmp_path / "waves/00_hello_world.wav").read_bytes())[0].tolist() == pytest.approx([0.0, 0.5], abs=1e-4)


def test_candidates_drop_what_is_empty(spark):
    rows = spark.createDataFrame([(1, "  two  words \n", 2.0), (2, " \t ", 1.0), (3, None, 1.0), (4, "\u200b", 1.0), (5, "d 7", None)], "i int, text string, d double")
    got = clips.candidates(rows, F.lit("s"), F.lit("mr"), F.lit("k"), F.lit("Anagha"), duration="d").orderBy("i").collect()
    assert [(r["i"], r["text"], r["text_normalized"], r["duration_s"], r["num_digits"], r["num_english_words"]) for r in got] == [(1, "two  words", "two words", 2.0, 0, 2), (5, "d 7", "d 7", 0.0, 1, 1)]


def test_candidates_are_cleaned_once(spark):
    """The filter on normalized texts takes no second pass, nor a second Python worker for each task."""
    rows = spark.createDataFrame([(1, " a\u200b b ", 2.0)], "i int, text string, d double")
    found = clips.candidates(rows, F.lit("s"), F.lit("mr"), F.lit("k"), F.lit("Anagha"), duration="d").select("i", "num_digits", "text_normalized")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and found.first()["text_normalized"] == "a b"


def test_clip_pipeline(spark):
    tone = lambda seconds, rate=8000: signal.encode(0.5 * np.sin(np.arange(int(seconds * rate)) * 0.2), rate)
    rows = [(0, tone(1.0), "a.wav", "मला  10 words", "Female"), (1, tone(0.1), "b.wav", "short", "male"), (2, tone(1.0), "held.wav", "x", "male"), (3, tone(1.0), None, " ", "male"), (4, b"broken", "e.wav", "x", "male")]
    df = spark.createDataFrame([((b, p), t, g, i) for i, b, p, t, g in rows], "audio struct<bytes: binary, path: string>, text string, gender string, _idx int")
    keyed = lambda p: df.sparkSession.range(1).select(clips.T.clip_key(F.lit(routing.ANCHOR), F.lit(p), F.lit(0)).alias("clip_key"))
    got = {r["gate"]["hard_reject"]: r for r in clips.clips(df, routing.ANCHOR, "CC-BY-4.0", "mr", 16_000, keyed("held.wav")).collect() if r["gate"]["hard_reject"] != "duration_out_of_[0.5,20.0]"}
    assert set(got) == {None, "eval_holdout", "empty_normalized_text"} and got["eval_holdout"]["meta"] is None and got["eval_holdout"]["samples"] is None
    meta = got[None]["meta"]
    assert (meta["speaker"]["name"], meta["speaker"]["gender"], meta["text"]["script"], meta["text"]["num_digits"], meta["transcript"]["text_normalized"]) == ("Anagha", "F", "Deva", 2, "मला 10 words")
    assert (meta["provenance"]["source_id"], meta["audio"]["sample_rate"], meta["audio"]["duration_s"], len(got[None]["samples"])) == (f"{routing.ANCHOR}#0", 16_000, 1.0, 16_000)
    assert got[None]["gate"]["soft_flags"] == ["snr<15.0", "narrowband"]
    rejected = clips.clips(df, routing.ANCHOR, "unknown", "mr", 8000).collect()
    assert len(rejected) == 5 and {r["gate"]["hard_reject"] for r in rejected} == {"license_unknown"}


def test_compiled_examples_and_quotas(spark):
    c = tokens.Contract()
    rows = spark.range(40).select("id", F.transform(F.sequence(F.lit(1), F.when(F.col("id") % 4 == 0, 6).otherwise(7 * (F.col("id") % 3 + 1)).cast("int")), lambda i: F.lit(c.snac_base) + ((i - 1) % 7) * 4096).alias("audio"))
    none, one = F.array().cast("array<int>"), F.array(F.lit(10))
    made = clips.compiled(rows, c, F.col("audio"), none, none, one)
    assert made.count() == 30 and made.filter("size(input_ids) <> size(labels)").count() == 0  # a clip without a whole frame gives no example
    held = tokens.examples(spark, [([1, 2], [-100, 2])]).first()
    assert (held["idx"], held["input_ids"], held["labels"]) == (0, [1, 2], [-100, 2])


def test_codes_out_of_range_are_errors(spark):
    for position, code in ((7, 0), (-1, 0), (0, 4096)):
        with pytest.raises(Exception, match="out of range"):
            spark.range(1).select(tokens.to_token(F.lit(position), F.lit(code), 100)).collect()


def test_places_are_ranked_without_one_task(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), "id", F.sha2(F.col("id").cast("string"), 256).alias("d"))
    got = mixture.ranked(rows, ["g"], "d", ["id"], 16).collect()
    for g in range(3):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["d"])
        assert [r["place"] for r in own] == list(range(1000))


def test_config(tmp_path):
    for name, text in {"base": "root: /r\nmodels: ${root}/m\nsizes: {a: 3, b: '${sizes.a}'}\n", "train": "x: [1, '${y}']\ny: 2.5\n", "data": "sources: {p: {hf_path: s/one}, q: {hf_path: s/two, role: r}}\n", "lora": ""}.items():
        (tmp_path / f"{name}.yaml").write_text(text)
    got = config.composed(str(tmp_path))
    assert got == {"base": {"root": "/r", "models": "/r/m", "sizes": {"a": 3, "b": 3}}, "train": {"x": [1, 2.5], "y": 2.5}, "data": got["data"], "lora": {}}
    assert config.source_config(got["data"]["sources"], "s/two")["role"] == "r"
    with pytest.raises(KeyError):
        config.source_config(got["data"]["sources"], "s/three")
    for bad in ({"a": "${b}"}, {"a": "${a}"}):
        with pytest.raises((KeyError, ValueError)):
            config.resolved(bad, bad)
    config.seed_all(7)
    state = config.captured()
    first = (np.random.rand(), math.floor(np.random.rand() * 100))
    config.restored(state)
    assert (np.random.rand(), math.floor(np.random.rand() * 100)) == first
    config.write_snapshot(got, str(tmp_path / "run"))
    assert json.loads((tmp_path / "run" / "rng_present.json").read_text()) == {"python": True, "numpy": True} and "models: /r/m" in (tmp_path / "run" / "config_snapshot.yaml").read_text()


def test_plans_and_the_row_cap(spark, tmp_path):
    assert (len(plans.EVAL), len(plans.SMOKE), len(plans.FULL)) == (6, 2, 9) and {r.pool for r in plans.FULL} == set(mixture.WEIGHTS)
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "t"))
    assert [scan.scan(spark, str(tmp_path / "t"), max_rows=n).count() for n in (None, 0, 1, 3)] == [5, 1, 1, 3]


def test_the_shared_folder_must_be_set_on_a_cluster(spark):
    assert shared.shared_dir(spark)

    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(dict)
            getCheckpointDir = staticmethod(lambda: None)

        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Elsewhere)


def test_file_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    raw = Tokenizer(WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    raw.pre_tokenizer = Whitespace()
    raw.save(str(tmp_path / "t.json"))
    t = hooks.FileTokenizer(str(tmp_path / "t.json"))
    assert (t.encode("b a c"), t.id_of("b"), t.id_of("zz")) == ([1, 0, 2], 1, None)
    assert {r["token"]: r["id"] for r in t.vocabulary(spark).collect()} == {"a": 0, "b": 1, "?": 2}


def test_command_line(spark, tmp_path, capsys):
    from swaraflow.__main__ import main

    main(["list"])
    assert "route_topk_items (SQL)" in capsys.readouterr().out
    spark.range(3).select(F.col("id").alias("event_id"), F.lit("x").alias("event_type")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    main(["run", "ordinal_scan", str(tmp_path), str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    with pytest.raises(SystemExit):
        main(["run", "nothing", str(tmp_path)])


def test_model_side_hooks(spark):
    c = tokens.Contract()
    prompts = spark.createDataFrame([([1, 2, 3],), ([4],)], "prompt_ids array<int>")
    made = hooks.generated(prompts, lambda: lambda prompt, most: [c.snac_base] * 7 + [c.end_of_speech] if len(prompt) == 3 else [c.snac_base] * most, 9, c.end_of_speech)
    assert [(len(r["token_ids"]), r["hit"]) for r in made.orderBy(F.desc(F.size("prompt_ids"))).collect()] == [(7, False), (9, True)]
    waves = hooks.decoded(made, lambda: lambda ids: np.full(len(ids), 3.0))
    assert {tuple(r["samples"]) for r in waves.collect()} == {(1.0,) * 7, (1.0,) * 9}
    coded = hooks.coded(waves, lambda: lambda x: ([1, 2], [1, 2, 3, 4], list(range(8))))
    ids = coded.select(tokens.interleaved(F.col("c0"), F.col("c1"), F.col("c2"), c.snac_base).alias("ids")).first()["ids"]
    assert len(ids) == 14 and ids[0] == c.snac_base + 1
    assert hooks.loaded("math:sqrt")(4) == 2.0
    with pytest.raises(ValueError):
        hooks.loaded("math")


class Deaf:
    def transcribe(self, samples, rate, language=None):
        return "the cat" if len(samples) == 3 else "nothing"


def test_an_evaluation_of_nothing_but_itself(spark):
    items = spark.createDataFrame([("b", f"{i:02d}", "the cat", "the cat", "A") for i in range(3)] + [("c", "00", "other", "other words", "A")], "bucket string, id string, text string, text_normalized string, speaker string")
    watch = monitor.evaluation(items, lambda: lambda text, speaker: ([0.0] * (3 if text == "the cat" else 5), [1], False), Deaf, 8000, most=2)
    assert watch() == {"b": 0.0, "c": 1.0} == watch()


def test_adapter_settings(spark):
    got = parameters.Adapter().settings(spark, 28)
    assert (got["r"], got["lora_alpha"], len(got["target_modules"])) == (32, 64, 36)


def test_weights_are_drawn_for_few_rows_at_once(spark, monkeypatch):
    """What a worker holds of 10,000 rows x 1,000 resamples is a small part of them."""
    rows = spark.createDataFrame([("a", "1", 0.5)], "bucket string, id string, x double")
    taken, plain = [], type(rows).mapInPandas
    monkeypatch.setattr(type(rows), "mapInPandas", lambda self, f, *how: taken.append(f) or plain(self, f, *how))
    metrics.split_bootstrap_ci(rows, "bucket", "x", "id")
    batch = pd.DataFrame({"g": ["a", "b"] * 5000, "k": np.arange(10_000), "x": np.ones(10_000)})
    tracemalloc.start()
    (sums,) = taken[0](iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20 and sums["w"].map(sum).sum() == pytest.approx(10_000 * 1000, rel=0.01) and [list(a) for a in sums["w"]] == [list(a) for a in sums["wx"]]
