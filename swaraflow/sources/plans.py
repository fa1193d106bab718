"""The surveyed system's read plans, as data for ``scan.read_plan``."""

from __future__ import annotations

from .scan import Read

# fixed values: sources, shards and columns of the three plans
MARATHI, ANCHOR, HINDI, ENGLISH = "SPRINGLab/IndicTTS_Marathi", "ai4bharat/Rasa", "SPRINGLab/IndicTTS-Hindi", "SPRINGLab/IndicTTS-English"
MARATHI_SHARD = "datasets/SPRINGLab/IndicTTS_Marathi/data/train-{:05d}-of-00004.parquet"
ANCHOR_SHARD = "datasets/ai4bharat/Rasa/Marathi/test-{:05d}-of-00007.parquet"
HINDI_SHARD = "datasets/SPRINGLab/IndicTTS-Hindi/data/train-{:05d}-of-00010.parquet"
ENGLISH_SHARD = "datasets/SPRINGLab/IndicTTS-English/data/train-{:05d}-of-00028.parquet"
LIGHT, AUDIO = ("audio.path", "text"), ("audio", "text")
ROWS_PER_SHARD = 700

EVAL: tuple[Read, ...] = (
    *(Read(ANCHOR, "mr", ANCHOR_SHARD.format(k), (*LIGHT, "gender", "style", "duration"), limit=ROWS_PER_SHARD) for k in (0, 1)),
    *(Read(MARATHI, "mr", MARATHI_SHARD.format(k), (*LIGHT, "gender"), limit=ROWS_PER_SHARD) for k in (0, 3)),
    Read(HINDI, "hi", HINDI_SHARD.format(0), LIGHT, speaker="Amit", limit=ROWS_PER_SHARD),
    Read(ENGLISH, "en", ENGLISH_SHARD.format(0), LIGHT, speaker="Amit", limit=ROWS_PER_SHARD),
)
SMOKE: tuple[Read, ...] = (
    Read(MARATHI, "mr", MARATHI_SHARD.format(0), (*AUDIO, "gender"), limit=12),
    Read(ANCHOR, "mr", ANCHOR_SHARD.format(0), (*AUDIO, "gender"), limit=8),
)
FULL: tuple[Read, ...] = (
    *(Read(MARATHI, "mr", MARATHI_SHARD.format(k), (*AUDIO, "gender"), pool="springlab_marathi") for k in (0, 3)),
    *(Read(ANCHOR, "mr", ANCHOR_SHARD.format(k), (*AUDIO, "gender"), pool="rasa_marathi") for k in (2, 3, 4, 5)),
    *(Read(HINDI, "hi", HINDI_SHARD.format(k), (*AUDIO, "gender"), pool="hindi_replay") for k in (4, 5)),
    Read(ENGLISH, "en", ENGLISH_SHARD.format(0), AUDIO, pool="english_replay"),
)
