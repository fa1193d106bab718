import os
import subprocess
import sys

import corpus_pipeline
from pyspark.sql import functions as F

from swaraflow.llm import bpe, mixing, neardup, quality, queries, toxicity


def write(folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline(spark, docs, rows, labels, tmp_path):
    folder = write(tmp_path, docs, labels)
    final = corpus_pipeline.run(spark, folder)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "near-dedup", "source mixing", "byte-level BPE"]

    # the same by hand: models as fitted, everything else by brute force on the driver
    texts = {r[0]: r[1] for r in rows}
    tox = toxicity.fit(docs, labels)
    scores = tox.score([(texts[i] or "").encode() for i in sorted(texts)])
    kept = [i for i, s in zip(sorted(texts), scores, strict=True) if s < queries.TOXIC_FROM]
    left = docs.filter(F.col("doc_id").isin(kept))
    good = quality.fit(left, labels).score([(texts[i] or "").encode() for i in kept])
    kept = [i for i, s in zip(kept, good, strict=True) if s >= queries.GOOD_FROM]
    from tests.llm.test_text_operators import brute_components

    kept = [i for i, (_, root) in brute_components({i: texts[i] for i in kept}, 80).items() if i == root]
    mixed = mixing.mixed_documents(docs.filter(F.col("doc_id").isin(kept)))
    vocabulary, pattern = queries.public_tokenizers.path(queries.VOCABULARY), queries.public_tokenizers.PATTERN
    c = bpe.codec(vocabulary, pattern)
    want = sorted((r["doc_id"], *bpe._digest(ids := c.encode(r["text"]), c.decode(ids))) for r in mixed.collect())
    assert sorted(tuple(r) for r in final.collect()) == want and want


def test_stages_keep_the_columns(spark, docs, labels, tmp_path):
    folder = write(tmp_path, docs, labels)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_near_copies_from_four_fifths_on_are_dropped(spark, tmp_path):
    base = [f"w{k}" for k in range(104)]
    edited = lambda *at: " ".join("changed" if k in at else f"w{k}" for k in range(104))
    other = " ".join(f"v{k}" for k in range(100))
    texts = [" ".join(base), edited(30, 60), other, other.replace("v30 ", "x ").replace("v50 ", "x ").replace("v70 ", "x ")]  # 90 of 110; 81 of 111
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 2, 3]


def test_stages_of_odd_tables(spark, docs, labels, tmp_path):
    """Repeated rows, null ids, and columns named as the operators' own: all pass through, decisions are the same."""
    names = ["key", "kept", "id", "score", "rows", "size", "taken", "shard", "draw", "band", "fp", "n_tokens"]
    folder = write(tmp_path, docs, labels)
    odd = docs.union(docs.filter("doc_id < 40")).union(docs.filter("doc_id = 20").withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.withColumns({n: F.lit("mine") for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, odd, folder)
        assert found.columns == odd.columns, name
        assert found.select(*names).distinct().collect() == [("mine",) * len(names)], name
    final = corpus_pipeline.STAGES[-1][1](spark, odd, folder)
    assert final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and final.count() == odd.count()
    once = {(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()}
    twice = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, odd.filter("doc_id is not null"), folder).collect()]
    assert len(twice) == len(set(twice)) and set(twice) == once


def test_tables_of_stages_go(spark, docs, labels, tmp_path):
    from swaraflow.llm.store import shared_dir

    folder = write(tmp_path, docs, labels)
    before = set(os.listdir(f"{shared_dir(spark)}/swaraflow"))
    corpus_pipeline.run(spark, folder).count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(f"{shared_dir(spark)}/swaraflow")) - before}
    assert left == {"stage-" + n.replace(" ", "-") for n, _ in corpus_pipeline.STAGES}


def test_stages_of_an_empty_table(spark, empty, labels, tmp_path):
    folder = write(tmp_path, empty, labels)
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_entry_without_this_subpackage(tmp_path):
    """A copy without the folders that may be deleted still imports and lists the other queries."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    import shutil

    shutil.copytree(f"{root}/swaraflow", tmp_path / "swaraflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=environment, check=True)
    # with the pipeline's file but without the folder, its import fails and is left out too
    shutil.copy(f"{root}/corpus_pipeline.py", tmp_path)
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=environment, check=True)


def test_all_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] and neardup.BANDS * neardup.ROWS <= neardup.COORDINATES
