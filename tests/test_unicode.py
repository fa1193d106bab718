import random
import sys
import time
import unicodedata

from pyspark.sql import functions as F

from swaraflow.functions import text as T

ASSIGNED = [p for p in range(sys.maxunicode + 1) if not 0xD800 <= p < 0xE000 and unicodedata.category(chr(p)) != "Cn"]


def settled(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", (F.col("t").rlike(T.PLAIN) | ~F.col("t").rlike(T.unsettled())).alias("settled"), T.cleaned("t").alias("c")).collect()
    return {r["i"]: (r["settled"], r["c"]) for r in rows}


def test_every_assigned_character(spark):
    texts = [f"a{chr(p)}b" for p in ASSIGNED]
    got = settled(spark, texts)
    assert [got[i][1] for i in range(len(texts))] == [T.clean_text(t) for t in texts]
    stay = sum(s for s, _ in got.values())
    assert stay > 130_000  # most of what is assigned outside of private use doesn't need Python
    for i, t in enumerate(texts):
        if got[i][0]:
            assert unicodedata.normalize("NFC", t) == t


def test_random_mark_sequences(spark):
    rng = random.Random(3)
    marks = [chr(p) for p in ASSIGNED if unicodedata.combining(chr(p))]
    seconds = ["़", "ᅡ", "ᆨ", "́", "̈", "゙"]
    bases = ["a", "é", "क", "ड", "न", "ᄀ", "가", "か", " ", "\n", "  ", "‍", " ", "क़", "़", "्", "॑", "日", "😀"]
    texts = ["".join(rng.choice(rng.choice((bases, marks, seconds, bases))) for _ in range(rng.randrange(0, 9))) for _ in range(20_000)]
    got = settled(spark, texts)
    assert [got[i][1] for i in range(len(texts))] == [T.clean_text(t) for t in texts]


def test_marathi_without_composing_marks_stays_in_the_jvm(spark):
    plain = "मला १० सफरचंद हवे आहेत.\nक्षत्रिय ज्ञान श्रीमंत"
    with_nukta = plain + " ड़"
    got = settled(spark, [plain, with_nukta, "Привет, мир", "日本語の文", "a‍b"])
    assert [got[i][0] for i in range(5)] == [True, False, True, True, False] and got[1][1] == T.clean_text(with_nukta)
    began = time.perf_counter()
    assert not settled(spark, [plain * 2000 + "‍"])[0][0] and time.perf_counter() - began < 20
