"""Lanes that test rows where they lie: same rows as the lanes over postings, and no row's tokens are moved."""

import re

import pytest
from pyspark.sql import functions as F

from corvine.operators import lanes, ranking, search

TEXTS = ["a b c a", "b c", None, "c a", "licence token", "license tokens under", "a x b", "tok under licens", "", "Under the license token"]


def _docs(spark, shared):
    ids = [i % 7 if shared else i for i in range(len(TEXTS))]
    ids[-2] = None if shared else ids[-2]
    return spark.createDataFrame(list(zip(ids, TEXTS, strict=True)), "id bigint, text string")


def _terms(spark):
    asked = {1: "a b", 2: "c", 3: "c none", 4: "license token", 5: "under", 6: "a b c x", 7: "tokens under"}
    return spark.createDataFrame([(q, t) for q, text in asked.items() for t in text.split()], "query_id bigint, token string")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("shared", [False, True])
@pytest.mark.parametrize("lane", [search.lexical_lane, search.prefix_lane])
def test_rows_give_what_their_postings_give(spark, lane, shared):
    docs, terms = _docs(spark, shared), _terms(spark)
    found = lane(search.words(docs, "id", F.col("text")), terms, "id")
    expected = lane(search.postings(docs, "id", F.col("text")), terms, "id")
    rows = lambda df: sorted((r.query_id, r.id if r.id is not None else -1, r.matched, round(r.score, 9)) for r in df.select("query_id", "id", "matched", "score").collect())
    assert rows(found) == rows(expected) != []


def test_more_questions_than_are_looked_up_meet_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(search, "LOOKED_UP", 1)
    docs, terms = _docs(spark, False), _terms(spark)
    found = search.lexical_lane(search.words(docs, "id", F.col("text")), terms, "id")
    expected = search.lexical_lane(search.postings(docs, "id", F.col("text")), terms, "id")
    assert sorted(found.collect()) == sorted(expected.collect()) != []


def test_tokens_of_rows_are_not_moved(spark):
    docs, terms = _docs(spark, False), _terms(spark)
    for lane in (search.lexical_lane, search.prefix_lane):
        assert not re.search(r"hashpartitioning\(id#", _plan(lane(search.words(docs, "id", F.col("text")), terms, "id")))
    asked = spark.createDataFrame([(1, "license token"), (2, "under")], "query_id bigint, query string")
    assert not re.search(r"hashpartitioning\(id#", _plan(lanes.text_lane(docs, asked, "id", F.col("text"))))


@pytest.mark.parametrize("shared", [False, True])
@pytest.mark.parametrize("k", [1, 2, 50])
def test_best_rows_of_any_term_are_those_of_the_lane(spark, monkeypatch, shared, k):
    monkeypatch.setattr(search, "CELLS", 16)  # blocks of one or two rows
    docs, terms = _docs(spark, shared), _terms(spark)
    found = search.best_of_any(search.words(docs, "id", F.col("text")), terms, "id", k)
    every = search.lexical_lane(search.postings(docs, "id", F.col("text")), terms, "id", "any").withColumn("score", F.round("score", 9))
    expected = ranking.top_per_group(every, ["query_id"], [F.desc("score"), F.col("id")], k, rank="rank").select("query_id", "id", "score", "rank")
    rows = lambda df: sorted((r["rank"], r.query_id, r.id, r.score) for r in df.select("query_id", "id", "score", "rank").collect())
    assert rows(found) == rows(expected) != []


def test_of_many_equal_rows_a_task_gives_those_of_the_smallest_ids(spark):
    docs = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 1000 == 7, "a a b").otherwise("x a x b").alias("text")).coalesce(1)
    terms = _terms(spark).where("query_id = 1")
    words = search.words(docs, "id", F.col("text"))
    assert search.best_where_they_lie(words, terms, "id", 5).count() <= 10
    assert [r.id for r in search.best_of_any(words, terms, "id", 5).orderBy("rank").collect()] == [7, 1007, 2007, 0, 1]


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_anchors_of_rows_are_those_of_postings(spark, monkeypatch, limit):
    docs = _docs(spark, False)
    asked = [(1, "find 'b c' or \"c a\" abc"), (2, "license token under"), (3, "say 'under the' and 'license token' tokens"), (4, "'none here'"), (5, "'a x' licence")]
    asked = spark.createDataFrame(asked, "query_id bigint, query string")
    run = lambda: [tuple(r) for r in lanes.content_anchors(docs, asked, "id", F.col("text"), limit=limit).select("query_id", "id", "quoted", "matched", "rank").orderBy("query_id", "rank").collect()]
    found = run()
    monkeypatch.setattr(lanes, "fits", lambda terms: False)
    assert found == run() != []
