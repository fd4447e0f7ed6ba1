"""Operators on small inputs with known results."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvine.operators import blocks, crawl, facts, filters, graph, joins, ranking, records, search
from corvine.sources import html, snapshot


def test_blocks_keep_the_heading_trail():
    found = blocks.prepare("# A\ntext\nmore\n\n## B\n- item\n```\ncode\n```\nGET /v1/x\n| a | b |\n")
    assert [(b[0], b[1]) for b in found] == [
        ("heading", "A"), ("paragraph", "text\nmore"), ("heading", "B"), ("list_item", "- item"), ("code_block", "code"), ("endpoint_block", "GET /v1/x"), ("table_row", "| a | b |"),
    ]
    assert found[-1][2] == ["A", "B"]


def test_boilerplate_is_reset_when_everything_is():
    line = "Home | About | News | Contact"
    assert blocks.is_boilerplate("paragraph", line) and not blocks.prepare(line)[0][4]
    assert [b[4] for b in blocks.prepare(line + "\n\nA real paragraph of text.")] == [True, False]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["paragraph", "heading", "table_row", "code_block"]), st.integers(1, 400)), max_size=30), st.integers(100, 900), st.integers(0, 90))
def test_windows_hold_all_blocks_in_order(items, most, overlap):
    rows = [(kind, "x" * n, [], 0, False) for kind, n in items]
    rows = [(k, f"{i}:{t}", *r) for i, (k, t, *r) in enumerate(rows)]
    found = blocks.windows(rows, most, overlap)
    seen = list(dict.fromkeys(b[1] for w in found for b in w))
    assert seen == [r[1] for r in rows]
    for w in found:
        assert len(w) == 1 or sum(len(b[1]) for b in w) + 2 * (len(w) - 1) <= most


def test_sentence_window():
    texts = ["One. Two.", "Three.", "Four. Five. Six."]
    assert blocks.sentence_window(texts, 1) == "One. Two. Three. Four. Five."
    assert blocks.sentence_window(["Alone."], 0) is None


def test_markdown_cells_and_headers():
    assert records.markdown_cells(r"| a | b \| c | |") == ["a", "b | c", ""]
    assert records.table_shape([["Report", ""], ["name", "size"], ["a", "1"]])[0] == ["name", "size"]
    assert records.table_shape([["1", "2"], ["3", "4"]])[::3] == (["col_1", "col_2"], "synthetic_data_like_header")


def test_urls():
    assert html.normal_url("HTTP://Example.COM:80#x") == "http://example.com/"
    assert html.normal_url("../b?q=1#f", "https://a.org/x/y") == "https://a.org/b?q=1"
    assert html.normal_url("mailto:x@y.z") == "" and html.normal_url("http://[bad") == ""
    assert html.best_source("a.png 320w, b.png 640w, c.png") == "b.png"


def test_page_without_chrome():
    page = "<title> T </title><nav><a href='/n'>Menu</a></nav><main><p>Hello <b>there</b></p><p hidden>no</p><script>x</script></main>"
    title, text, canonical, links, _ = html.read_page(page, "http://e.org/a")
    assert (title, text, canonical, links) == ("T", "Hello there", "http://e.org/a", ["http://e.org/n"])


def test_content_roots():
    text = lambda page: html.read_page(page)[1]
    assert text("<article>short</article><article>a longer one</article>") == "a longer one"
    assert text("<article>" + "x" * 100 + "</article><main><h2>T</h2></main>") == "T"  # a heading counts 120
    assert text("<article>same</article><main>same</main>") == "same" and text("<article>first</article><article>again</article>") == "first"
    assert text("<div>outer<div role='main'>inner <a href='/x'>link</a></div></div>") == "inner link"
    assert text("<main></main><p>all of it</p>") == "all of it" and text("<main>open <p>end") == "open\nend"
    assert text("<article>" + "y" * 30 + "</article><main>ab<img><img></main>") == "ab"


def test_global_position_equals_a_sort(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 101).alias("v"))
    found = {r.id: r.position for r in ranking.global_position(df, [F.desc("v"), F.col("id")], -F.floor(F.col("v") / 10)).collect()}
    expected = sorted(range(1000), key=lambda i: (-(i * 7919 % 101), i))
    assert found == {i: k + 1 for k, i in enumerate(expected)}


def test_keyset_pages_cover_everything(spark):
    df = spark.range(23).select("id", (F.col("id") % 4).alias("k"))
    after, seen = None, []
    while True:
        page = ranking.keyset_page(df, ["k", "id"], after, 5).collect()
        seen += [r.id for r in page[:5]]
        if len(page) <= 5:
            break
        after = [page[4].k, page[4].id]
    assert seen == sorted(range(23), key=lambda i: (-(i % 4), -i))


def test_ladder_stops_when_there_is_enough(spark):
    many = spark.range(8).select(F.lit(1).alias("query_id"), "id")
    loose = spark.range(5, 30).select(F.lit(1).alias("query_id"), "id")
    few = spark.range(2).select(F.lit(2).alias("query_id"), "id")
    wide = spark.range(6).select(F.lit(2).alias("query_id"), "id")
    found = search.ladder([many.unionByName(few), loose.unionByName(wide)], "id").collect()
    assert sorted(r.id for r in found if r.query_id == 1) == list(range(8))
    assert sorted((r.id, r["pass"]) for r in found if r.query_id == 2) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 1), (5, 1)]


def test_price_as_of_edges(spark):
    calls = spark.createDataFrame([(1, 1, "2020-01-01", None), (2, 1, "2020-02-01", 500), (3, 1, "2019-12-31", 5)], "call_id int, provider_id int, called_at string, input_tokens int")
    prices = spark.createDataFrame(
        [(10, 1, "system", "2020-01-01", "2020-02-01", None, 5), (11, 1, "system", "2020-02-01", None, None, 6), (12, 1, "system", "2020-01-01", None, 400, 7)],
        "price_id int, provider_id int, scope string, effective_from string, effective_to string, tokens_from int, cents_per_1000 int",
    )
    assert {r.call_id: r.price_id for r in joins.price_as_of(calls, prices).collect()} == {1: 10, 2: 12}


def test_canonical_graph(spark):
    nodes = spark.createDataFrame([("person:a", "Ann", "person", 1), ("concept:a", "ann", "concept", 5), ("person:b", "Bob", "person", 2)], "node_id string, label string, node_type string, support_count int")
    edges = spark.createDataFrame([("person:a", "person:b", "knows"), ("concept:a", "person:b", "knows"), ("person:a", "concept:a", "is")], "from_node_id string, to_node_id string, relation_type string")
    kept, joined = graph.canonical(nodes, edges)
    assert {r.node_id for r in kept.collect()} == {"concept:a", "person:b"}
    assert [tuple(r) for r in joined.collect()] == [("concept:a", "knows", "person:b", 2)]


def test_terminal_state(spark):
    row = spark.range(1).select(*[crawl.terminal_state(*map(F.lit, x)) for x in [(1, 0, 0, 0, 0), (1, 1, 0, 0, 0), (0, 0, 1, 0, 0), (0, 0, 0, 2, 0), (0, 0, 0, 0, 1)]]).first()
    assert list(row) == ["completed", "completed_partial", "failed", "completed_partial", "canceled"]


def test_facts(spark):
    df = spark.createDataFrame([(1, "call GET /v1/items, see https://x.org/a#b. port: 8080 port: 99999 MY_VAR `do_it`")], "id int, t string")
    found = {(r.fact_kind, r.canonical_value) for r in facts.extract(df, ["id"], "t").collect()}
    assert {("endpoint_path", "/v1/items"), ("url", "https://x.org/a"), ("port", "8080"), ("environment_variable", "MY_VAR"), ("code_identifier", "do_it")} <= found
    assert ("port", "99999") not in found


def test_snapshot_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, [1.5])], "id int, s string, v array<double>")
    snapshot.export({"t": df}, f"file://{tmp_path}/s")
    assert sorted(map(tuple, snapshot.import_(spark, f"file://{tmp_path}/s")["t"].collect())) == sorted(map(tuple, df.collect()))
    snapshot.publish(df, f"file://{tmp_path}/p")
    snapshot.publish(df.where("id = 1"), f"file://{tmp_path}/p")
    assert snapshot.current(spark, f"file://{tmp_path}/p").count() == 1


def test_glob_and_trigrams(spark):
    assert filters.glob_pattern("a*b?.c") == r"^a.*b.\.c$"
    row = spark.range(1).select(filters.trigram_similarity(F.lit("word"), F.lit("words")), filters.trigram_similarity(F.lit(""), F.lit("x"))).first()
    assert row[0] == pytest.approx(4 / 7) and row[1] == 0.0


def test_hybrid_search_takes_whole_questions(spark, tmp_path):
    """A question's late words count, and questions of any id have both lanes."""
    from corvine import registry

    spark.createDataFrame([(5, "zebra stripes"), (60, "nothing of it")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, [1.0, 0.0]), (60, [0.0, 1.0])], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(60, "one two three four five six zebra")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {(r.query_id, r.doc_id): r.lanes for r in registry.QUERIES["r02_hybrid_document_search"](spark, str(tmp_path)).collect()}
    assert found == {(60, 5): 2, (60, 60): 1}


def test_release_versions(spark):
    from corvine.functions import text as fn

    cases = {
        "release v1.2.3": ["1.2.3"], "from 1.10.0-rc.1+b7, 2.0.": ["1.10.0", "2.0"], "v10.0.0.1 but not 10.0.0.2": ["10.0.0.1"], "31.12.2024 and 2024.1": [],
        "x1.2 1.2x 1..2 1.2- 1.2-a..b": [], "(1.2) 1.2": ["1.2"], "300.1.1.1": ["300.1.1.1"], "1.99999999999": [], "7": [], "": [], "2.5.": ["2.5"], "2.5.,": [],
    }
    df = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string")
    found = {r.t: r.v for r in df.select("t", fn.release_versions(F.col("t")).alias("v")).collect()}
    assert found == cases | {None: None}


def test_nearest_decides_ties(spark, monkeypatch):
    """Scaled copies of one vector tie, whatever their last bits; zero, null and shorter vectors score nothing."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(search, "VECTORS", 90)
    base = rng.normal(size=16)
    rows = [(int(i), (base * s).astype(np.float32).astype(float).tolist()) for i, s in zip(rng.permutation(300), rng.uniform(0.1, 9, 300), strict=True)]
    rows += [(400 + i, rng.normal(size=16).tolist()) for i in range(200)] + [(900, [0.0] * 16), (901, None), (902, [1.0, 2.0]), (903, base.tolist()), (904, base.tolist())]
    asked = [(1, base.tolist()), (2, rng.normal(size=16).tolist()), (3, [0.0] * 16), (4, rows[310][1])]
    found = search.nearest(spark.createDataFrame(rows, "id bigint, v array<double>"), spark.createDataFrame(asked, "query_id bigint, q array<double>"), "id", "v", 10).collect()
    cos = lambda a, b: round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 9)
    for q, vector in asked:
        best = sorted((-cos(vector, v), i) for i, v in rows if v and len(v) == 16 and any(v)) if any(vector) else []
        assert [r.id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [i for _, i in best[:10]]


def test_boilerplate_rules(spark):
    url = "http://a.b/c"
    rows = [(1, p, line) for p in range(5) for line in (f"own line {p}", "Footer", f"{url} {url} {url}", f"{url} {url} and many more words than links {p}", f"One | Two | Three | {p}", f"One | Two | {p}", "x" * 161)]
    rows += [(2, p, "Footer") for p in range(6)] + [(3, 0, "Footer"), (3, 0, None), (3, 1, "Home › A › B › C")]
    found = {(r.d, r.p, r.t): r.is_boilerplate for r in records.boilerplate(spark.createDataFrame(rows, "d int, p int, t string"), "d", "t", "p").collect()}
    first = {t: found[1, 0, t] for d, p, t in rows if d == 1 and p == 0}
    assert list(first.values()) == [False, True, True, False, True, False, False]
    assert not any(v for (d, _, _), v in found.items() if d == 2)  # all of it would be
    assert found[3, 1, "Home › A › B › C"] and not found[3, 0, "Footer"]


def test_earliest_times(spark):
    cases = {
        '{"a": "2024-05-01T10:00:00Z", "b": {"c": 1714550400}}': 1714550400, '{"a": ["2024-05-01T10:00:00+02:00", 1714999999]}': 1714550400, '[{"x": 1714550400123}, {"y": 1714550399999}]': 1714550399,
        '{"a": "2024-05-01", "n": 12345, "t": true}': None, '{"bad"': None, "": None, '{"a": "2024-13-01T00:00:00Z"}': None, '{"a": "1714550400"}': 1714550400, '{"f": 1714550400.5}': None,
    }
    df = spark.createDataFrame(list(enumerate([*cases, None])), "i int, j string")
    found = {r.i: r.s for r in records.record_times(df, "i", "j").select("i", F.unix_timestamp("occurred_at").alias("s")).collect()}
    assert [found[i] for i in range(len(cases) + 1)] == [*cases.values(), None]


def test_charges_and_coverage(spark):
    calls = spark.createDataFrame([(1, 7, 2_000_000, "2024-01-01"), (2, 8, 5, "2024-01-01"), (3, 7, None, "2024-01-01")], "call_id int, provider_id int, input_tokens bigint, d string").withColumn("called_at", F.to_timestamp("d"))
    prices = spark.createDataFrame([(1, 7, "system", "2020-01-01", None, None, 3)], "price_id int, provider_id int, scope string, a string, b string, tokens_from bigint, cents_per_1000 bigint")
    prices = prices.withColumn("effective_from", F.to_timestamp("a")).withColumn("effective_to", F.to_timestamp("b"))
    found = {r.call_id: (r.price_id, None if r.charge is None else float(r.charge)) for r in joins.charges(calls, prices).collect()}
    assert found == {1: (1, 6.0), 2: (None, None), 3: (1, None)}
    from corvine.operators import aggregates

    rows = spark.createDataFrame([(1, 2), (5, 2), (0, 0), (None, 3), (3, 0)], "f int, b int")
    assert [r.c for r in rows.select(aggregates.coverage(F.col("f"), F.col("b")).alias("c")).collect()] == [0.5, 1.0, 0.0, None, 0.0]


def test_edges_near_the_keywords(spark):
    nodes = spark.createDataFrame([("a", "Payment Gateway", "system", 3), ("b", "Ledger", "store", 1)], "node_id string, label string, node_type string, support_count int")
    edges = spark.createDataFrame([("a", "b", "writes_to")], "from_node_id string, to_node_id string, relation_type string")
    plain, near = (graph.edge_relevance(edges, nodes, k).first().relevance for k in ((), ("gatewey", "ledger", "absent", "writes")))
    assert abs(near - plain - 3 * 0.24) < 1e-9 and abs(plain - (3 + 0.5 + 0.015 * np.log(4))) < 1e-9


def test_facts_of_lines(spark):
    lines = {
        "See <http://a.b/c>, (https://a.b:8080/v1/x?q=1).": {("url", "https://a.b:8080/v1/x?q=1)."), ("endpoint_path", "/v1/x"), ("protocol", "https")},
        "| GET | /users/{id} | list |": {("http_method", "GET"), ("endpoint_path", "/users/{id")}, "connect to ws now": {("http_method", "CONNECT"), ("protocol", "ws")}, "POST GET /a/b": {("http_method", "POST"), ("http_method", "GET"), ("endpoint_path", "/a/b")},
        "http://h:0/ http://h:65535 http://h:70000/": {("url", "http://h:0/"), ("url", "http://h:65535"), ("url", "http://h:70000/"), ("port", "65535"), ("protocol", "http")}, "status 404, HTTP/1.1 99 HTTP/x 200": set(), "AUTHORIZATION:  basic dXNlcg==": {("auth_rule", "basic_auth")}, "": set(), None: set(),
    }
    df = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    found = {}
    for r in facts.line_facts(df, ["i"], "t").collect():
        found.setdefault(r.i, set()).add((r.fact_kind, r.value))
        assert r.method == ("GET" if r.i == 1 and r.fact_kind == "endpoint_path" else None)
    found = {i: {(k, v) for k, v in x} for i, x in found.items()}
    got = [found.get(i, set()) for i in range(len(lines))]
    assert got[1:] == list(lines.values())[1:]
    assert ("endpoint_path", "/v1/x") in got[0] and ("protocol", "https") in got[0]


def test_overflow_spares_what_runs_or_is_replayed(spark):
    talks = spark.createDataFrame([(i, i) for i in range(8)], "id int, created_at int")
    runs = spark.createDataFrame([(0, 1), (1, 1), (1, None), (2, 1), (4, 1)], "id int, completed_at int")
    replays = spark.createDataFrame([(2, 9), (4, 4)], "source_id int, id int")
    gone = lambda most: [r.id for r in joins.overflow(talks, runs, replays, most, F.lit(6), F.floor(F.col("created_at") / 2)).orderBy("age").collect()]
    assert gone(5) == [0, 3, 4] and gone(0) == [0, 3, 4, 5] and gone(8) == [] and gone(20) == [] and gone(7) == [0]
