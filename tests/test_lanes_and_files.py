"""Lanes, typed fusion, and kinds of files on known cases."""

from pyspark.sql import functions as F

from corvine.operators import blocks, lanes
from corvine.plans import preparation
from corvine.sources import files

LANE = "query_id int, id int, rank int, score double, kind string"


def places(df):
    return [(r.id, r.kind) for r in sorted(df.collect(), key=lambda r: r.place)]


def test_a_row_of_both_lanes_wins(spark):
    left = spark.createDataFrame([(0, 1, 1, 0.9, "relevance"), (0, 2, 2, 0.8, None)], LANE)
    right = spark.createDataFrame([(0, 2, 1, 0.1, "relevance")], LANE)
    assert places(lanes.fuse_typed(left, right)) == [(2, "relevance"), (1, "relevance")]


def test_evidence_keeps_its_score_and_kind(spark):
    empty = spark.createDataFrame([], LANE)
    found = lanes.fuse_typed(empty, spark.createDataFrame([(0, 7, 1, 5000.0, "graph_evidence")], LANE), "graph_evidence").first()
    assert (found.score, found.kind) == (5000.0, "graph_evidence")


def test_priorities_identities_and_ties(spark):
    left = [(0, 1, 1, 0.5, "relevance"), (0, 2, 2, 250_000.0, "relevance"), (0, 3, 3, 0.1, "content_anchor"), (0, 4, 4, None, "relevance"), (0, 6, 5, 3.0, "entity_bio"), (1, 9, 1, 1.0, None)]
    right = [(0, 4, 1, 2.0, "relevance"), (0, 5, 2, 9.0, "query_ir_focus"), (0, 6, 3, 7.0, "focused_document"), (0, 1, 4, 0.7, None)]
    found = lanes.fuse_typed(spark.createDataFrame(left, LANE), spark.createDataFrame(right, LANE), "graph_evidence")
    assert places(found.where("query_id = 0")) == [(3, "content_anchor"), (2, "document_identity"), (5, "query_ir_focus"), (6, "entity_bio"), (4, "graph_evidence"), (1, "graph_evidence")]
    assert {r.id: r.score for r in found.collect()}[6] == 7.0 and places(found.where("query_id = 1")) == [(9, "relevance")]


def test_entities_by_lane_and_raw_score(spark):
    schema = "query_id int, node_id string, rank int, score double, node_type string, label string"
    vector = spark.createDataFrame([(0, "a", 1, 0.2, "x", "A"), (0, "b", 2, 0.9, "x", "B")], schema)
    lexical = spark.createDataFrame([(0, "c", 1, 5.0, "x", "C"), (0, "d", 2, None, "x", "D")], schema)
    assert [r.node_id for r in lanes.fuse_entities(vector, lexical, 9).orderBy("place").collect()] == ["c", "a", "d", "b"]
    assert lanes.fuse_entities(vector, lexical, 1).count() == 1


def test_question_terms(spark):
    cases = {
        "The the API_key in src/main of v2": (["the", "api_key", "src/main"], ["src/main"], ["v2"]), "one two six seven eight nine tens": (["one", "two", "six", "seven", "eight", "nine", "tens"], [], []),
        "authentication configuration documents repository webmasters": (["authentication", "configuration", "documents", "repository", "webmasters"], ["authentication", "configuration", "repository", "webmasters"], ["authentication", "configuration", "documents", "repository", "webmasters"]),
        None: ([], [], []), "a b": ([], [], []),
    }
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(cases)], "i int, q string").select("i", lanes.question_terms(F.col("q")).alias("t")).collect()
    assert {r.i: (r.t.terms, r.t.longest, r.t.name) for r in rows} == dict(enumerate(cases.values()))


def test_chunk_lane(spark, monkeypatch):
    monkeypatch.setattr(lanes, "TERM_BYTES", 30)
    documents = spark.createDataFrame([(1, "Alpha guide", "a.md"), (2, "Beta release 2.0", None), (3, None, "misc.txt"), (4, "Gamma", "g.md")], "document_id int, title string, file_name string")
    chunks = [(d * 10 + i, d, i, t, h, s, q) for d, i, t, h, s, q in [
        (1, 0, "intro text", None, None, 1.0), (1, 1, "alpha words here", None, None, 1.0), (1, 2, "more", None, None, None), (2, 0, "beta words", None, None, 0.5), (3, 0, "alpha words again", "Alpha part", "words", 1.0),
        (3, 1, "alpha words thrice", None, None, 1.0), (3, 2, "alpha words", None, None, 1.0), (4, 0, None, None, None, None),
    ]]
    chunks = spark.createDataFrame(chunks, "chunk_id int, document_id int, chunk_index int, text string, heading string, section string, quality double")
    asked = spark.createDataFrame([(1, "alpha words"), (2, "release 2.0"), (3, "alpha"), (4, None), (5, "absent everywhere")], "query_id int, query string")
    found = {}
    for r in lanes.chunk_lane(chunks, documents, asked).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    ids = {q: [c for c, _ in rows] for q, rows in found.items()}
    assert ids[1][:2] == [10, 11]  # nearly named: 50 and 49.999
    assert ids[2] == [20] and found[2][0][1] == 500_000.0 and ids[3][:2] == [10, 11] and found[3][0][1] == 1_000_000.0 and 4 not in ids and 5 not in ids
    best = dict(found[1])
    assert best[30] > 4 * best[31] and all(sum(c // 10 == d for c in row) <= 2 for row in ids.values() for d in (1, 2, 3, 4))


def test_quotations_stand_in_order(spark):
    rows = spark.createDataFrame([(1, "The Red-Fox jumps; the red fox sleeps"), (2, "fox red and red, then fox"), (3, "a a b a a a c"), (4, None), (5, "RED fox")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, 'who is "red fox"?'), (2, "say 'a a a c' now"), (3, '"single" and «the red fox»'), (4, "no quotes red"), (5, None), (6, '"fox \u201cred')], "query_id int, query string")
    phrases = {(r.query_id, r.phrase) for r in lanes.quoted_sequences(asked).collect()}
    assert phrases == {(1, "red fox"), (2, "a a a c"), (3, "the red fox")}
    found = lanes.sequence_hits(lanes.postings(rows, "doc_id", F.col("text")), lanes.quoted_sequences(asked), "doc_id")
    assert sorted((r.query_id, r.doc_id) for r in found.collect()) == [(1, 1), (1, 5), (2, 3), (3, 1)]
    ranked = [(r.query_id, r.doc_id, r.quoted) for r in lanes.content_anchors(rows, asked, "doc_id", F.col("text")).orderBy("query_id", "rank").collect()]
    assert [x for x in ranked if x[0] == 1] == [(1, 1, 1), (1, 5, 1), (1, 2, 0)] and not [x for x in ranked if x[0] in (4, 5)]


def test_kinds(spark):
    rows = [
        ("a.PDF", None, b"x", "pdf"), ("x", "application/pdf; q=1", b"x", "pdf"), ("a.html", "image/PNG", b"x", "image"), ("q.csv", None, b"a,b", "spreadsheet"), ("Dockerfile", None, b"FROM x", "text_like"), (".env", None, b"A=1", "text_like"),
        ("run.sh", "application/octet-stream", b"\\0", "text_like"), ("odd.bin", None, b"plain text", "text_like"), ("odd.bin", "video/mp4", b"plain text", "binary"), ("odd.bin", "binary/octet-stream", b"plain", "text_like"), ("odd", None, b"a\0b", "binary"),
        ("odd", None, b"\xff\xfe\x00", "binary"), ("odd", None, b"\x01\x02ab", "binary"), ("odd", None, b"\x01abcd\n", "text_like"), (None, None, b"", "text_like"), (None, None, None, "binary"), ("a.b/noext", None, b"t", "text_like"), ("deck.pptx", "", b"", "pptx"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, media string, body binary, expected string")
    found = df.select("i", "expected", files.file_kind(F.col("name"), F.col("media"), F.col("body")).alias("kind")).collect()
    assert [(r.i, r.kind) for r in found] == [(r.i, r.expected) for r in found]


def test_lines(spark, sf):
    text = "﻿# Head\r\ntext\r\r\n- item\n```py\n# code\n```\nGET /x\n| a | b |\n1) one\n~~~\nx"
    found = [(r.text, r.hint) for r in files.text_lines(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("line").collect()]
    assert [h for _, h in found] == ["heading", "paragraph", "blank", "list_item", "code_fence", "code_line", "code_fence", "endpoint", "table_row", "list_item", "code_fence", "code_line"] and found[0][0] == "# Head"
    pages = preparation.outlines(spark.read.parquet(f"{sf}/pages.parquet"))
    counts = {(r.page_id, r.hint): r["count"] for r in files.text_lines(pages, "page_id").groupBy("page_id", "hint").count().collect()}
    for r in pages.collect():
        kinds = [b[0] for b in blocks.prepare(r.text)]
        assert counts[r.page_id, "heading"] == kinds.count("heading") and counts[r.page_id, "code_fence"] == 2 * kinds.count("code_block")
