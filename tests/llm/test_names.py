"""Columns called like anything that an operator uses or returns, in either case."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from swaraflow.llm import host_rules, licenses, mixing, names, neardup, quality, toxicity, url_rules

INTERNAL = ["__text", "__host", "__mined", "__strata", "__rule", "__path", "__explicit", "__id", "__size", "__taken", "__part", "__texts", "__slot", "__bits", "__near_key", "__toxic", "__good", "key", "kept", "fp", "rows"]


def clashing(df, added, case=str):
    """``df`` with a column for each name that it doesn't have yet, holding that name."""
    there = {c.casefold() for c in df.columns}
    fresh = [case(n) for n in dict.fromkeys([*INTERNAL, *added]) if n.casefold() not in there]
    return df.select(*(F.col(f"`{c}`") for c in df.columns), *(F.lit(n).alias(n) for n in fresh)), fresh


def same_rows(got, want, id):
    pick = lambda df: sorted((tuple(map(str, (r[c] for c in want.columns))) for r in df.select(*(F.col(f"`{c}`") for c in want.columns)).collect()), key=str)
    assert pick(got) == pick(want), id


def holds(got, passed):
    """Each passed column still holds its own name."""
    (row,) = got.agg(*(F.min(F.col(f"`{c}`") == c).alias(f"c{i}") for i, c in enumerate(passed))).collect()
    assert all(v is not False for v in row)


def test_names():
    assert names.unlike(["a", "__X", "__x_"], "x", "y", "Y") == ["__x__", "__y", "__Y_"]
    assert names.giving_way(["a", "Score", "b"], ["score"]) == ["a", "b"]


@pytest.mark.parametrize("case", [str, str.upper])
def test_clashing_names(spark, docs, labels, case):
    small = docs.filter("doc_id between 12 and 60")
    hosts = small.select("doc_id", F.col("source").alias("host"), "text")
    added = [*host_rules.MEASURES, "host_rate", "host_docs", "host_dropped", "failed_rules", "base_failed", "any_failed"]
    rows, fresh = clashing(hosts, added, case)
    want, got = host_rules.judge(hosts), host_rules.judge(rows)
    same_rows(got, want.select("doc_id", *host_rules.MEASURES, "base_failed", "kept"), "host rules")
    holds(got, [c for c in fresh if c.casefold() not in {x.casefold() for x in want.columns}])

    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.example.{'com/en/7' if i % 3 else 'com/de/2'}/p{i % 4}") for i in range(40)], "page_id int, url string")
    rows, fresh = clashing(pages, url_rules.ADDED, case)
    want, got = url_rules.judge(pages), url_rules.judge(rows)
    same_rows(got, want, "url rules")
    holds(got, [c for c in fresh if c.casefold() not in {x.casefold() for x in want.columns}])

    for add, fit in ((toxicity.with_toxicity, toxicity.fit), (quality.with_quality, quality.fit)):
        model = fit(docs, labels)
        rows, fresh = clashing(small, ["score"], case)
        got = add(rows, model)
        same_rows(got, add(small, model).select("doc_id", "text", "score"), "score")
        holds(got, [c for c in fresh if c.casefold() != "score"])

    rows, fresh = clashing(small, [], case)
    same_rows(mixing.mixed_documents(rows), mixing.mixed_documents(small), "mix")
    holds(mixing.mixed_documents(rows), fresh)
    same_rows(neardup.without_near_duplicates(rows), neardup.without_near_duplicates(small), "near")
    holds(neardup.without_near_duplicates(rows), fresh)


@pytest.mark.parametrize("name", ["license", "Containment", "first_word", "n_words"])
def test_license_ids_by_clashing_names(spark, name):
    docs = spark.createDataFrame([(1, "SPDX-License-Identifier: MIT"), (2, next(iter(licenses.TEMPLATES.values())))], f"{name} int, text string")
    found = licenses.scan_licenses(docs, id=name)
    assert found.columns == [f"{name}_id", "license", "containment", "first_word", "n_words"] and {r[0] for r in found.collect()} >= {2}


def test_stages_pass_clashing_names(spark, docs, labels, tmp_path):
    small = docs.filter("doc_id < 80")
    small.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows, fresh = clashing(small, ["score", "Score_", "n_tokens"], str.upper)
    for name, stage in corpus_pipeline.STAGES[:2]:
        got = stage(spark, rows, str(tmp_path))
        assert got.columns == rows.columns, name
        same_rows(got, stage(spark, small, str(tmp_path)), name)
        holds(got, fresh)
