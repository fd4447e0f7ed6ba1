"""Titles, versions, topics, excerpts and column summaries on known cases and against brute force."""

import random

from pyspark.sql import functions as F

from corvine.operators import metadata, search, summaries

# ---- titles


def test_metadata_terms(spark):
    cases = {
        "  Release NOTES, (v1.2) ": (["release notes, (v1.2)", "release", "notes", "v1.2"], ["1.2"]), "1.2": (["1.2"], []), "1.2.3": (["1.2.3"], ["1.2.3"]), "": ([], []), "   ": ([], []),
        "a bb cc dd ee ff gg hh ii jj": (["a bb cc dd ee ff gg hh ii jj", "bb", "cc", "dd", "ee", "ff", "gg", "hh"], []), None: ([], []), "x/y_z-w. ?": (["x/y_z-w. ?", "x/y_z-w."], []),
    }
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(cases)], "i int, q string").select("i", metadata.metadata_terms(F.col("q")).alias("m")).collect()
    assert {r.i: (r.m.generic, r.m.version) for r in rows} == dict(enumerate(cases.values()))


def brute_metadata(documents, generic, version, limit):
    out = []
    for i, title, key in documents:
        t, k = (title or "").lower(), (key or "").lower()
        nt, nk = sum(g in t for g in generic), sum(g in k for g in generic)
        steps = [(t in generic, 1400, title), (k in generic, 1380, key), (any(v in t for v in version), 1320, title), (any(v in k for v in version), 1280, key), (nt, 70 + 80 * min(nt, 4), title), (nk, 65 + 75 * min(nk, 4), key)]
        hit = next(((s, m) for on, s, m in steps if on), None)
        if hit:
            out.append((-hit[0], -i, i, hit[1]))
    return [(i, float(-s), m) for s, _, i, m in sorted(out)[:limit]]


def test_metadata_search_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "release", "notes", "guide"]
    documents = [(i, rng.choice([None, " ".join(rng.choices(words, k=2)).title()]), rng.choice([None, f"{rng.choice(words)}-{rng.choice(words)}.md"])) for i in range(120)]
    questions = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 4)))) for i in range(12)] + [(12, "alpha-beta.md"), (13, ""), (14, None), (15, "none of these x9")]
    monkeypatch.setattr(metadata, "TERM_BYTES", 60)  # several blocks of terms
    df = spark.createDataFrame(documents, "document_id bigint, title string, key string").withColumn("score", F.lit("clash"))
    asked = spark.createDataFrame(questions, "query_id bigint, query string")
    terms = {r.query_id: r.m for r in asked.select("query_id", metadata.metadata_terms(F.col("query")).alias("m")).collect()}
    found = {}
    for r in metadata.metadata_search(df, asked, limit=7).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.document_id, r.score, r.matched))
    for q, _ in questions:
        assert found.get(q, []) == brute_metadata(documents, terms[q].generic, terms[q].version, 7)
    assert metadata.metadata_search(df, asked.limit(0)).count() == 0 and metadata.metadata_search(df.limit(0), asked).count() == 0


def test_higher_versions_come_first(spark):
    titles = ["Notes 1.9", "Notes 1.10", "Notes 1.10.1", "Notes", "Notes 2.0.0.1", "Notes 99999999999999999999.1"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(titles)], "document_id int, title string, key string")
    found = metadata.metadata_search(df, spark.createDataFrame([(1, "find notes")], "query_id int, query string")).orderBy("rank").collect()
    assert [r.document_id for r in found] == [3, 4, 2, 1, 0, 5]  # a title that is a term itself, then versions


def test_latest_versions(spark):
    titles = ["App 1.2", "App v1.10.0", "App 1.9.9", "App 1.0 -> 2.0", "App", None, "App 2024.1", "Tool 3.1", "App v1.10.0"]
    documents = spark.createDataFrame([(i, t, "t" if t and t.startswith("Tool") else "a") for i, t in enumerate(titles)], "document_id int, title string, library string")
    chunks = spark.createDataFrame([(d, c) for d in range(9) for c in range(d % 3 * 3)], "document_id int, chunk_index int")
    found = metadata.latest_versions(documents, chunks, ["library"], count=3, floor=10.0).orderBy("library", "document_rank", "chunk_index").collect()
    assert [(r.document_id, r.version, r.document_rank, r.chunk_index) for r in found] == [(1, "1.10.0", 1, c) for c in range(3)] + [(8, "1.10.0", 2, c) for c in range(4)] + [(2, "1.9.9", 3, c) for c in range(4)] + [(7, "3.1", 1, c) for c in range(3)]
    assert [r.score for r in found if r.document_id == 8] == [10 + 4 * 3 - 1, 10 + 3 * 3 - 1, 10 + 2 * 3 - 1, 10 + 1 * 3 - 1]


def test_topic_pruning(spark):
    hits = [(1, d, t, s) for d, (t, s) in enumerate([("Workflow setup", 0.01), ("workflows at large", 0.01), ("Network setup", 0.01), ("Manual", 0.95), ("Manual two", None)])]
    hits += [(2, d, t, 0.01) for d, t in enumerate(["Alpha guide", "Beta guide", "Gamma guide"])] + [(3, d, t, 0.01) for d, t in enumerate(["Workflow a1", "Workflow b1"])] + [(4, 0, None, 0.01)]
    df = spark.createDataFrame(hits, "query_id int, document_id int, title string, score double")
    asked = spark.createDataFrame([(1, "the workflow please"), (2, "any guide"), (3, "workflow"), (4, None)], "query_id int, query string")
    found = sorted((r.query_id, r.document_id) for r in metadata.prune_topic(df, asked).collect())
    assert found == [(1, 0), (1, 1), (1, 3), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (4, 0)]


# ---- excerpts


def test_focused_lines(spark):
    text = "\n".join(["intro line", "second line", "", "The token limit is here", "after it", "and more", "the end"])
    assert search.focused_lines(text, ["limit", "token"], 30) == "second line The token limit is..." and search.focused_lines(text, ["limit"], 20) == "The token limit is h..."
    assert search.focused_lines(text, ["limit"], 500) == "intro line second line The token limit is here after it and more"
    assert search.focused_lines(text, ["intro"], 500) == "intro line second line The token limit is here after it and more"
    assert search.focused_lines(text, ["absent", "it"], 10) == "intro line..." and search.focused_lines(" \n ", ["x"], 10) == "" and search.focused_lines("short", [], 10) == "short"
    rows = spark.createDataFrame([(1, text, ["limit"]), (2, None, None)], "doc_id int, text string, k array<string>")
    assert {r.doc_id: r.excerpt for r in search.focused_excerpts(rows, F.col("k"), 20).collect()} == {1: "The token limit is h...", 2: ""}


# ---- summaries


def test_summary_lines_are_read_back(spark):
    rows = [("Ferrell LLC", "Papua New Guinea", "10", "https://a.example/1"), ("Mckinney", "Sweden", "20", "https://b.example/2"), ("Hester Ltd", "Sweden", "30,5", "https://c.example/3"), ("Holder", None, " ", "https://d.example/4")]
    df = spark.createDataFrame(rows, "Name string, Country string, Employees string, Website string")
    found = {r.column_name: r for r in summaries.summaries(df, df.columns, sheet="organizations").withColumn("line", summaries.render()).collect()}
    assert found["Country"].line == "Table Summary | Sheet: organizations | Column: Country | Value Kind: categorical | Value Shape: label | Aggregation Priority: 3 | Row Count: 4 | Non-empty Count: 3 | Distinct Count: 2 | Most Frequent Count: 2 | Most Frequent Tie Count: 1 | Most Frequent Values: Sweden"
    assert "Average: 20.166667 | Min: 10 | Max: 30.5" in found["Employees"].line and found["Website"].priority == 0 and found["Name"].priority == 2
    lines = spark.createDataFrame([(r.line,) for r in found.values()], "line string").select(summaries.parse(F.col("line")).alias("s")).select("s.*")
    shown = {"value_kind", "shape", "priority", "row_count", "non_empty", "distinct_count", "sheet", "column_name"}
    for r in lines.collect():
        assert all(r[c] == found[r.column_name][c] for c in shown)
        assert r.value_kind != "numeric" or (r.min_value, r.max_value, r.mode_count) == (10, 30.5, 0)
    bad = ["no summary", "Table Summary | Column: x", "Table Summary | Column: x | Value Kind: odd | Row Count: 1 | Non-empty Count: 1 | Distinct Count: 1", "Table Summary | Column: x | Value Kind: numeric | Row Count: many | Non-empty Count: 1 | Distinct Count: 1", None]
    assert all(r.s is None for r in spark.createDataFrame([(b,) for b in bad], "line string").select(summaries.parse(F.col("line")).alias("s")).collect())
    few = spark.createDataFrame([("  Table Summary | Column: a: b | Value Kind: categorical | Value Shape: odd | Row Count: 3 | Non-empty Count: 2 | Distinct Count: 2 | Most Frequent Values: p; q",)], "line string")
    s = few.select(summaries.parse(F.col("line")).alias("s")).first().s
    assert (s.column_name, s.shape, s.priority, s.mode_count, s.modes) == ("a: b", "label", 0, 0, "p; q")


def test_rows_for_a_graph(spark):
    rows = [("Legacy", "Alpha", "Shared", 1), (None, "Beta", "Shared", 2), (None, "Gamma", "Shared", 3), (None, "Delta", "Shared", 4), (None, "Epsilon", "Shared", 5)]
    df = spark.createDataFrame(rows, "Name string, `Primary` string, `Group` string, Number int")
    roles = summaries.graph_roles(summaries.summaries(df, df.columns))
    assert {r.key: (r.subject, r.attribute) for r in roles.collect()} == {"name": (False, False), "primary": (True, False), "group": (False, True), "number": (False, False)}
    one = roles.agg(F.collect_list(F.struct("key", "subject", "attribute")).alias("roles"))
    texts = ["Sheet: s | Row 1 | Name: Legacy | Primary: Alpha | Group: Shared | Number: 1", "Row 2 | Group: 12-3 | col_1: x | Number: 2", "Primary: Only", "nothing", None]
    found = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").join(F.broadcast(one)).orderBy("i").select(summaries.graph_row(F.col("x"), F.col("roles")).alias("t")).collect()]
    assert found == ["Primary: Alpha | Group: Shared", None, "Primary: Only", None, None]
