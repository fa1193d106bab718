"""A whole evaluation, interrupted and started again."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from swaraflow.operators import evaluation, panel
from swaraflow.sources import manifests

RATE = 8000
WORDS = {"one two": 220.0, "three": 330.0, "four five six": 440.0, "long words": 150.0}


def speak(log):
    def make():
        def one(text, speaker):
            with open(log, "a") as out:
                out.write(text + "\n")
            t = np.arange(RATE // 2) / RATE
            return 0.4 * np.sin(2 * np.pi * WORDS[text] * t), [1, 2, 3, 4, 5, 6, 7] * len(text), text == "three"

        return one

    return make


class Ears:
    """Hears by the pitch of what it gets; one word wrong."""

    def transcribe(self, samples, rate, language=None):
        f = np.fft.rfftfreq(len(samples), 1 / rate)[np.abs(np.fft.rfft(samples)).argmax()]
        return {220.0: "one two", 330.0: "three", 440.0: "four nine six"}[min((220.0, 330.0, 440.0), key=lambda x: abs(x - f))]


class Broken:
    def transcribe(self, samples, rate, language=None):
        raise RuntimeError("no ears")


def embed():
    return lambda samples, rate: np.array([1.0, float(np.std(samples))])


@pytest.fixture
def lock(spark, tmp_path):
    bucket = "retention_rasa_marathi"
    rows = [(bucket, f"{bucket}_000", "k0", "one two", "Anagha", "mr"), (bucket, f"{bucket}_001", "k1", "three", "Chinmay", "mr"), ("retention_hindi", "retention_hindi_000", None, "four five six", "Amit", "hi"), ("marathi_longform", "marathi_longform_000", None, "long words", "Anagha", "mr")]
    items = spark.createDataFrame(rows, "bucket string, id string, clip_key string, text string, speaker string, language_id string").withColumn("text_normalized", F.col("text"))
    header = spark.createDataFrame([(b, True) for b in (bucket, "retention_hindi", "marathi_longform", "marathi_code_switch")], "bucket string, is_retention boolean")
    manifests.write(items, header, str(tmp_path / "lock"))
    return str(tmp_path / "lock")


def test_evaluation_from_lock_to_page(spark, lock, tmp_path):
    folder, log = str(tmp_path / "run"), str(tmp_path / "log")
    refs = spark.createDataFrame([("k0", [0.1, 0.2] * 100), ("k1", [0.5, -0.5] * 100), ("other", [1.0])], "clip_key string, samples array<float>")
    with pytest.raises(Exception, match="no ears"):
        evaluation.evaluate(spark, lock, folder, evaluation.Models(speak(log), Broken, embed), RATE, refs)
    spoken = open(log).read().split("\n")
    assert not os.path.exists(f"{folder}/published")
    models = evaluation.Models(speak(log), Ears, embed)
    found = {r["bucket"]: r for r in evaluation.evaluate(spark, lock, folder, models, RATE, refs).collect()}
    assert open(log).read().split("\n") == spoken and sorted(filter(None, spoken)) == sorted(WORDS)  # nothing is spoken twice
    assert set(found) == {"retention_rasa_marathi", "retention_hindi", "marathi_longform", "marathi_code_switch"}
    first, hindi, long = found["retention_rasa_marathi"], found["retention_hindi"], found["marathi_longform"]
    assert (first["n"], first["wer"], first["hit_rate"], hindi["wer"], hindi["substitutions"]) == (2, 0.0, 0.5, pytest.approx(1 / 3), 1) and found["marathi_code_switch"]["n"] == 0
    assert set(first["by_voice"]) == {"Anagha", "Chinmay"} and 0 < first["speaker_similarity"] <= 1 and hindi["speaker_similarity"] is None
    assert first["mean_f0"] == pytest.approx(275, rel=0.02) and (long["n"], long["wer"], long["mean_frames"]) == (1, None, 10.0)
    assert {os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(f"{folder}/published") for f in names} == {"published/panel.json", "published/panel.html", "published/audit/retention_rasa_marathi.jsonl", "published/audit/retention_hindi.jsonl"}
    told = json.load(open(f"{folder}/published/panel.json"))["buckets"]
    assert told["retention_hindi"]["wer"] == pytest.approx(1 / 3) and "retention_hindi" in open(f"{folder}/published/panel.html").read()
    lines = [json.loads(x) for x in open(f"{folder}/published/audit/retention_hindi.jsonl")]
    assert lines == [{"id": "retention_hindi_000", "reference": "four five six", "hypothesis": "four nine six"}]
    again = evaluation.evaluate(spark, lock, folder, evaluation.Models(None, None, None), RATE)  # all done: no model is asked for
    assert {r["bucket"]: r["wer"] for r in again.collect()} == {b: r["wer"] for b, r in found.items()} and panel.display(again, panel.WER_COLUMNS).count() == 4
