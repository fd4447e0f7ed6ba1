"""The pipeline's stages, each on its own input, and all of them."""

from pyspark.sql import functions as F

import corpus_pipeline
from corvine.llm import simhash

from .test_documents import brute_components, brute_fingerprint


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, before, sf), name)
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
        ids, old = {r.doc_id for r in docs.collect()}, {r.doc_id: r.text for r in before.collect()}
        if name == "exact_dedup":
            best = {}
            for i, t in old.items():
                key = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
                best[key] = max(i, best.get(key, i))
            assert ids == set(best.values())
        if name == "personal_data":
            assert ids == set(old) and docs.where(F.col("n_chars") != F.length("text")).count() == 0
            assert docs.where(F.col("text").rlike(r"[a-z0-9]@[a-z0-9]+\.[a-z]")).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == docs.count()


def test_run_and_empty_input(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_stages_take_nulls(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "A text", None, None, 6), (3, "a text", "en", None, 6), (3, "a text", "en", None, 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("score", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), name)
    assert docs.count() > 0


def test_one_of_repeated_rows_stays(spark, sf):
    rows = [(1, "One Text here"), (1, "One Text here"), (2, "one text here"), (2, "one text here"), (None, "one text here"), (3, None), (4, ""), (5, "another text of some words"), (None, "alone"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("digest", F.lit("clash"))
    exact = corpus_pipeline.drop_exact_copies(spark, docs, sf)
    assert exact.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in exact.collect()) == [(0, "alone"), (2, "one text here"), (4, ""), (5, "another text of some words")]
    near = corpus_pipeline.drop_near_copies(spark, docs.where("doc_id IS NOT NULL"), sf)
    assert sorted((r.doc_id, r.text) for r in near.collect()) == [(1, "One Text here"), (3, None), (5, "another text of some words")]


def test_fingerprint_function():
    for text in ("", "one", "One two", "a b c d e f", "A\tb\n\nc  d"):
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert brute_components({1: 0, 2: 3, 3: 15}) == {1: 1, 2: 1, 3: 1}
