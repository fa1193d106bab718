"""From raw documents to token digests: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``; all but the last return the
columns of ``documents``.

Defined results: null and empty texts score as empty ones, are nobody's copy and
have no words to mix, so the mix leaves them out; rows with null ids are judged by
id and text like all others; of rows that share id and text the near-dedup stage
keeps one; ties of scores are decided by the limits alone, ties of ids by text;
columns besides those of ``documents`` pass through all stages but the last,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swaraflow.llm import bpe, mixing, neardup, quality, toxicity
from swaraflow.llm.names import unlike
from swaraflow.llm.queries import GOOD_FROM, TOXIC_FROM, VOCABULARY, table
from swaraflow.llm.store import materialize, scratch

#: Least similarity of the 5-word shingle sets of near copies; ``op8_minhash_near_dedup`` has its own, 0.85.
NEAR_FROM = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = unlike(docs, "toxic")
    return toxicity.with_toxicity(docs, model, name=score).filter(F.col(score) < TOXIC_FROM).drop(score)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = unlike(docs, "good")
    return quality.with_quality(docs, model, name=score).filter(F.col(score) >= GOOD_FROM).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_near_duplicates(docs, threshold=NEAR_FROM)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands once for each whole copy that the mix takes; a part is cut after its last word."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    return bpe.encode_digests(docs, vocabulary, pattern)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL can't express the fitted models, MinHash or the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"), outlive=True)
    return docs
