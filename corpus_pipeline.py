"""Clean a corpus and pack it: the stages of the training-data pipeline in their order.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; each one's result is written as
Parquet and read again as the next one's ``docs``.  All but the last return the columns of
``docs``.  Stages work on every row they are given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm import dedup, packing, pii, simhash, toxicity
from corvine.llm.common import ascii_lower, materialize, table


def _less(docs: DataFrame, gone: DataFrame, twice: DataFrame, keys: dict) -> DataFrame:
    """``docs`` without the rows that ``gone`` names, and one row for each name in ``twice``.

    ``keys``: columns of the two and what they equal in ``docs``, nulls included.  The join is the same at
    every size: both grow with the corpus, so neither is broadcast.
    """
    settled = materialize(gone.withColumn("again", F.lit(False)).unionByName(twice.withColumn("again", F.lit(True))), "settled").hint("merge")
    on = [value.eqNullSafe(settled[name]) for name, value in keys.items()]
    found = docs.join(settled.where("again"), on, "left_semi")
    return docs.join(settled, on, "left_anti").unionByName(found.dropDuplicates(["doc_id", "text"]))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity tagger doesn't reject.

    Null texts are scored as empty, repeated rows alike, and rows with a null id are scored; a score of
    the threshold itself rejects.  Without documents nothing is left; without labels of
    both kinds the tagger rejects what the only kind says.
    """
    tagged = toxicity.tag_documents(docs, table(spark, sf_dir, "labels"), threshold=0.3, carry=docs.columns)
    return tagged.where("predicted = 0").select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the largest id.

    Null and empty texts are equal; null ids lose to all others; of rows that repeat the id and the text
    that stay, one stays.  Nothing comes of nothing.
    """
    found = materialize(dedup.exact_duplicates(docs), "exact").select("doc_id", F.col("text_sha256").alias("digest"), "kept")
    named = found.groupBy("doc_id", "digest").agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    digest = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)
    gone, twice = named.where("NOT kept"), named.where("kept AND n > 1")
    return _less(docs, gone.select("doc_id", "digest"), twice.select("doc_id", "digest"), {"doc_id": docs.doc_id, "digest": digest})


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id.

    Sets of five-word shingles with a Jaccard similarity of 0.8 or more.  Texts without words
    (null and empty ones too) are one group.  A group of null ids only stays as one row per text; of rows
    that repeat an id and a text one stays, and an id stays if any of its rows does.
    """
    found = materialize(simhash.near_copies(docs, similarity=0.8, words_per_shingle=5), "near")
    kept = F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept")
    named = found.groupBy("doc_id").agg(kept, F.count("*").alias("n"))
    return _less(docs, named.where("NOT kept").select("doc_id"), named.where("kept AND n > 1").select("doc_id"), {"doc_id": docs.doc_id})


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` counted anew.

    Null texts become empty ones; every row stays, repeated ones and those without an id too.
    """
    found = pii.find_personal_data(docs, keep_text=True, carry=[c for c in docs.columns if c != "text"])
    new = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("bigint")}
    return found.select(*[new.get(c, F.col(f"in_{c}") if c != "text" else None).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row per piece.

    Null and empty texts are a piece of the end token alone; repeated rows are packed each.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: A chain trained by gradients, fingerprints and token merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
