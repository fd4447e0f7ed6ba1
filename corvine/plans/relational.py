"""Queries of the relational core: filters, joins, windows, order and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import filters, joins, ranking
from ..registry import query

# ---- filters -------------------------------------------------------------------------------


@query(
    "x01_canonical_head",
    """SELECT r.document_id, r.revision_id, r.text_state FROM {revision} r
       JOIN {document} d ON d.document_id = r.document_id AND d.readable_revision_id = r.revision_id WHERE d.document_state = 'active'""",
    "revision",
    "document",
)
def x01(revision: DataFrame, document: DataFrame) -> DataFrame:
    return filters.canonical_head(revision, document).select("document_id", "revision_id", "text_state")


@query(
    "x02_temporal_overlap",
    """SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS t0, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 2 DAY END AS t1 FROM {events})
       WHERE coalesce(t1, t0) >= TIMESTAMP '2024-01-05' AND t0 <= TIMESTAMP '2024-01-15'""",
    "events",
)
def x02(events: DataFrame) -> DataFrame:
    at = F.when(F.col("event_id") % 10 != 0, F.col("ts"))
    until = F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 2 DAY"))
    low, high = (F.to_timestamp(F.lit(x)) for x in ("2024-01-05", "2024-01-15"))
    return events.where(filters.overlaps(at, until, low, high)).select("event_id")


@query(
    "x03_all_terms_match",
    "SELECT doc_id FROM {documents} WHERE contains(lower(text), 'the') AND contains(lower(text), 'con') AND contains(lower(text), 'en')",
    "documents",
)
def x03(documents: DataFrame) -> DataFrame:
    return documents.where(filters.all_terms(F.col("text"), ["the", "con", "en"])).select("doc_id")


@query("x04_any_term", "SELECT doc_id FROM {documents} WHERE contains(lower(text), 'license') OR contains(lower(text), 'token')", "documents")
def x04(documents: DataFrame) -> DataFrame:
    return documents.where(filters.any_term(F.col("text"), ["license", "token"])).select("doc_id")


TRIGRAMS = """list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


@query(
    "x05_trigram_similarity",
    f"""WITH p AS (SELECT p_partkey, {TRIGRAMS.format("p_name")} AS x, {TRIGRAMS.format("'blue ring'")} AS y FROM {{part}})
    SELECT p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS similarity FROM p
    WHERE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.2""",
    "part",
)
def x05(part: DataFrame) -> DataFrame:
    near = part.withColumn("s", filters.trigram_similarity(F.col("p_name"), F.lit("blue ring")))
    return near.where("s >= 0.2").select("p_partkey", F.round("s", 6).alias("similarity"))


@query(
    "x08_regex_shape",
    r"""SELECT doc_id, regexp_matches(text, '[A-Za-z_]+ ?= ?["]?[A-Za-z0-9]+') AS assignment, regexp_matches(text, '[0-9]{3}-[0-9]{4}') AS numeric_map FROM {documents}""",
    "documents",
)
def x08(documents: DataFrame) -> DataFrame:
    text = F.col("text")
    return documents.select("doc_id", text.rlike('[A-Za-z_]+ ?= ?["]?[A-Za-z0-9]+').alias("assignment"), text.rlike("[0-9]{3}-[0-9]{4}").alias("numeric_map"))


@query("x09_keyset_predicate", "SELECT event_id FROM {events} WHERE (ts, event_id) < (TIMESTAMP '2024-01-10 00:00:00', 5000)", "events")
def x09(events: DataFrame) -> DataFrame:
    return events.where(F.struct("ts", "event_id") < F.struct(F.lit("2024-01-10 00:00:00").cast(events.schema["ts"].dataType), F.lit(5000).cast("bigint"))).select("event_id")


_WORDS = "SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \\n]+')) AS w FROM {documents}"


@query(
    "x10_identifier_shape",
    f"""SELECT w, (regexp_matches(w, '[_./:\\-]') OR regexp_matches(w, '[0-9]') OR regexp_matches(w, '\\p{{Ll}}\\p{{Lu}}') OR regexp_matches(w, '^\\p{{Lu}}{{2,}}$')) AS identifier
        FROM ({_WORDS}) WHERE w <> ''""",
    "documents",
)
def x10(documents: DataFrame) -> DataFrame:
    words = documents.select(F.explode(F.split("text", r"[ \n]+")).alias("w")).where("w <> ''").distinct()
    return words.select("w", filters.identifier_shape(F.col("w")).alias("identifier"))


@query(
    "x11_literal_kind",
    """SELECT page_id, kind FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '/a/b' WHEN 2 THEN 'v1.2.3' WHEN 3 THEN '404' ELSE 'plain' END AS t FROM {pages}),
       LATERAL (SELECT CASE WHEN regexp_matches(t, '^https?://') THEN 'url' WHEN t LIKE '/%' THEN 'path' WHEN regexp_matches(t, '^v?[0-9]+(\\.[0-9]+)+$') THEN 'version'
                WHEN regexp_matches(t, '^[0-9]+$') THEN 'numeric_code' ELSE 'other' END AS kind)""",
    "pages",
)
def x11(pages: DataFrame) -> DataFrame:
    i = F.col("page_id") % 5
    t = F.when(i == 0, F.col("url")).when(i == 1, "/a/b").when(i == 2, "v1.2.3").when(i == 3, "404").otherwise("plain")
    return pages.select("page_id", filters.literal_kind(t).alias("kind"))


_TERMS = "w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM {benchmark})"


def _terms(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).distinct()


@query(
    "x12_near_token",
    f"""WITH {_TERMS} SELECT a.w AS a, b.w AS b FROM w a JOIN w b
        ON a.w < b.w AND length(a.w) >= 5 AND length(b.w) >= 5 AND substr(a.w, 1, 1) = substr(b.w, 1, 1) AND levenshtein(a.w, b.w) <= 1""",
    "benchmark",
)
def x12(benchmark: DataFrame) -> DataFrame:
    return joins.near_tokens(_terms(benchmark), "w")


@query(
    "x13_related_prefix",
    f"""WITH {_TERMS} SELECT a.w AS target, b.w AS label FROM w a JOIN w b ON length(a.w) >= 5 AND length(b.w) > length(a.w)
         AND substr(b.w, 1, greatest(length(a.w) - 1, 4)) = substr(a.w, 1, greatest(length(a.w) - 1, 4))""",
    "benchmark",
)
def x13(benchmark: DataFrame) -> DataFrame:
    w = _terms(benchmark)
    a, b = w.select(F.col("w").alias("target")), w.select(F.col("w").alias("label"))
    # a shared beginning of four characters brings both together by equality
    return a.join(b, (F.substring("target", 1, 4) == F.substring("label", 1, 4)) & filters.related_prefix(F.col("target"), F.col("label")))


@query("x17_list_filter", "SELECT document_id, title FROM {document} WHERE document_state = 'active' AND lower(title) LIKE '%src1 part 1%'", "document")
def x17(document: DataFrame) -> DataFrame:
    return document.where((F.col("document_state") == "active") & F.lower("title").like("%src1 part 1%")).select("document_id", "title")


# ---- joins ---------------------------------------------------------------------------------


@query(
    "j01_inner_multi_key",
    "SELECT r.revision_id, d.title FROM {revision} r JOIN {document} d ON r.document_id = d.document_id AND r.revision_id = d.readable_revision_id",
    "revision",
    "document",
)
def j01(revision: DataFrame, document: DataFrame) -> DataFrame:
    head = document.select("document_id", F.col("readable_revision_id").alias("revision_id"), "title")
    return revision.join(head, ["document_id", "revision_id"]).select("revision_id", "title")


@query(
    "j02_left_outer",
    "SELECT d.document_id, d.parent_document_id, p.title AS parent_title FROM {document} d LEFT JOIN {document} p ON d.parent_document_id = p.document_id",
    "document",
)
def j02(document: DataFrame) -> DataFrame:
    parent = document.select(F.col("document_id").alias("parent_document_id"), F.col("title").alias("parent_title"))
    return document.select("document_id", "parent_document_id").join(parent, "parent_document_id", "left")


@query("j03_semi_join", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", "customer", "orders")
def j03(customer: DataFrame, orders: DataFrame) -> DataFrame:
    return customer.join(orders.where("o_orderstatus = 'P'"), customer.c_custkey == orders.o_custkey, "left_semi").select("c_custkey")


@query("j04_anti_join", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", "customer", "orders")
def j04(customer: DataFrame, orders: DataFrame) -> DataFrame:
    return customer.join(orders.where("o_orderstatus = 'F'"), customer.c_custkey == orders.o_custkey, "left_anti").select("c_custkey")


@query(
    "j05_lateral_top1",
    """SELECT c_custkey, o_orderkey AS last_order, o_orderdate AS last_date FROM {customer} LEFT JOIN
       (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM {orders}) WHERE r = 1) ON o_custkey = c_custkey""",
    "customer",
    "orders",
)
def j05(customer: DataFrame, orders: DataFrame) -> DataFrame:
    last = ranking.first_per_group(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    last = last.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("last_order"), F.col("o_orderdate").alias("last_date"))
    return customer.select("c_custkey").join(last, "c_custkey", "left")


@query("j06_per_row_computation", """SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS charge FROM {lineitem}""", "lineitem")
def j06(lineitem: DataFrame) -> DataFrame:
    share = lambda c: F.col(c).cast("decimal(4,2)")  # noqa: E731  money goes by decimals
    charge = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - share("l_discount")) * (1 + share("l_tax"))
    return lineitem.select("l_orderkey", "l_linenumber", charge.cast("double").alias("charge"))


@query(
    "j07_join_request_list",
    "SELECT i AS place, p_partkey, p_name FROM (SELECT unnest([30, 10, 20, 10, 999999]) AS k, generate_subscripts([30, 10, 20, 10, 999999], 1) - 1 AS i) JOIN {part} ON p_partkey = k",
    "part",
)
def j07(part: DataFrame) -> DataFrame:
    return joins.request_list(part, "p_partkey", [30, 10, 20, 10, 999999]).select("place", "p_partkey", "p_name")


@query("j08_theta_contains", "SELECT p_partkey, t AS term FROM {part} JOIN (SELECT unnest(['red', 'ing', 'blue']) AS t) ON contains(lower(p_name), t)", "part")
def j08(part: DataFrame) -> DataFrame:
    return joins.contains_any(part, F.lower("p_name"), ["red", "ing", "blue"]).select("p_partkey", "term")


@query(
    "j09_range_join",
    """WITH a AS (SELECT o_custkey, min(o_orderdate) AS lo, min(o_orderdate) + INTERVAL 60 DAY AS hi FROM {orders} GROUP BY o_custkey)
       SELECT DISTINCT o.o_orderkey FROM {orders} o JOIN a ON a.o_custkey = o.o_custkey AND o.o_orderdate BETWEEN a.lo AND a.hi""",
    "orders",
)
def j09(orders: DataFrame) -> DataFrame:
    windows = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("low")).withColumn("high", F.col("low") + F.expr("INTERVAL 60 DAY"))
    return joins.within_ranges(orders, windows, ["o_custkey"], "o_orderdate").select("o_orderkey")


@query(
    "j10_json_path_join",
    "SELECT e.event_id, p.p_partkey FROM {events} e JOIN {part} p ON CAST(e.props ->> '$.k' AS BIGINT) = p.p_partkey",
    "events",
    "part",
)
def j10(events: DataFrame, part: DataFrame) -> DataFrame:
    key = F.get_json_object("props", "$.k").cast("bigint")
    return events.select("event_id", key.alias("p_partkey")).join(part.select("p_partkey"), "p_partkey")


@query(
    "j11_anchor_row",
    "SELECT x.kind, s.n FROM (SELECT 'health' AS kind) x LEFT JOIN (SELECT count(*) AS n FROM {events} WHERE event_type = 'nothing' HAVING count(*) > 0) s ON true",
    "events",
)
def j11(events: DataFrame) -> DataFrame:
    found = events.where("event_type = 'nothing'").agg(F.count("*").alias("n")).where("n > 0")
    return joins.always_one_row(found, {"kind": "health"})


@query(
    "j12_graph_self_join",
    """SELECT e.from_node_id, e.to_node_id, a.label AS from_label, b.label AS to_label FROM {edge} e
       JOIN {node} a ON a.node_id = e.from_node_id JOIN {node} b ON b.node_id = e.to_node_id""",
    "edge",
    "node",
)
def j12(edge: DataFrame, node: DataFrame) -> DataFrame:
    return joins.with_endpoints(edge, node).select("from_node_id", "to_node_id", "from_label", "to_label")


@query(
    "j13_or_condition_join",
    """SELECT DISTINCT p.p_partkey, s.s_suppkey FROM {part} p JOIN {supplier} s ON p.p_partkey = s.s_suppkey OR p.p_size = s.s_suppkey OR CAST(p.p_retailprice AS BIGINT) = s.s_suppkey""",
    "part",
    "supplier",
)
def j13(part: DataFrame, supplier: DataFrame) -> DataFrame:
    # SQL rounds halves to the even number; parts that repeat give a pair once
    keys = [F.col("p_partkey"), F.col("p_size").cast("bigint"), F.rint("p_retailprice").cast("bigint")]
    return joins.any_of_keys(part, keys, supplier, "s_suppkey").select("p_partkey", "s_suppkey").distinct()


@query(
    "j14_array_membership",
    """WITH c AS (SELECT c_nationkey AS community, list(c_custkey ORDER BY c_custkey)[1:5] AS members FROM {customer} GROUP BY c_nationkey)
       SELECT community, c_custkey, c_name FROM (SELECT community, unnest(members) AS m FROM c) JOIN {customer} ON c_custkey = m""",
    "customer",
)
def j14(customer: DataFrame) -> DataFrame:
    few = ranking.top_per_group(customer, ["c_nationkey"], [F.col("c_custkey")], 5)
    members = few.groupBy(F.col("c_nationkey").alias("community")).agg(F.array_sort(F.collect_list("c_custkey")).alias("members"))
    return members.select("community", F.explode("members").alias("c_custkey")).join(customer.select("c_custkey", "c_name"), "c_custkey")


@query(
    "j16_as_of_price",
    """SELECT call_id, price_id, cents_per_1000 FROM (
         SELECT c.call_id, p.price_id, p.cents_per_1000, row_number() OVER (PARTITION BY c.call_id
           ORDER BY (p.scope = 'workspace') DESC, (p.tokens_from IS NOT NULL) DESC, p.tokens_from DESC, p.effective_from DESC, p.price_id) AS r
         FROM {provider_call} c JOIN {price} p ON p.provider_id = c.provider_id AND p.effective_from <= c.called_at AND (p.effective_to IS NULL OR p.effective_to > c.called_at)
           AND (p.tokens_from IS NULL OR c.input_tokens >= p.tokens_from)) WHERE r = 1""",
    "provider_call",
    "price",
)
def j16(provider_call: DataFrame, price: DataFrame) -> DataFrame:
    return joins.price_as_of(provider_call, price).select("call_id", "price_id", "cents_per_1000")


@query(
    "j17_scoped_inheritance",
    """SELECT c_custkey, mktsegment, source_scope FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY precedence) AS r FROM (
         SELECT c_custkey, c_mktsegment AS mktsegment, 'library' AS source_scope, 1 AS precedence FROM {customer} WHERE c_custkey % 3 = 0
         UNION ALL SELECT c_custkey, n_name, 'workspace', 2 FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey WHERE c_custkey % 2 = 0
         UNION ALL SELECT c_custkey, 'default', 'instance', 3 FROM {customer})) WHERE r = 1""",
    "customer",
    "nation",
)
def j17(customer: DataFrame, nation: DataFrame) -> DataFrame:
    own = customer.where("c_custkey % 3 = 0").select("c_custkey", F.col("c_mktsegment").alias("mktsegment"))
    workspace = customer.where("c_custkey % 2 = 0").join(nation, customer.c_nationkey == nation.n_nationkey).select("c_custkey", F.col("n_name").alias("mktsegment"))
    return joins.inherit(
        ["c_custkey"], {"library": own, "workspace": workspace, "instance": customer.select("c_custkey", F.lit("default").alias("mktsegment"))}
    )


_TALKS = """c AS (SELECT user_id AS id, min(ts) AS created_at FROM {events} GROUP BY user_id), x AS (SELECT user_id AS id, CASE WHEN event_type = 'signup' AND value > 9 THEN NULL ELSE ts END AS completed_at FROM {events} WHERE event_type IN ('purchase', 'signup') AND event_id % 3 = 0),
  r AS (SELECT user_id AS source_id, user_id + event_id % 2 AS id FROM {events} WHERE event_type = 'error' AND event_id % 7 = 0)"""


@query(
    "j18_overflow_retention",
    f"""WITH {_TALKS}, f AS (SELECT id, created_at FROM c WHERE CASE WHEN EXISTS (SELECT 1 FROM x WHERE x.id = c.id) THEN NOT EXISTS (SELECT 1 FROM x WHERE x.id = c.id AND completed_at IS NULL) ELSE created_at < (SELECT max(created_at) FROM c) END
         AND NOT EXISTS (SELECT 1 FROM r WHERE r.source_id = c.id AND r.id <> c.id))
       SELECT id, age FROM (SELECT *, row_number() OVER (ORDER BY created_at, id) AS age FROM f) WHERE age <= (SELECT greatest(count(*) - 50, 0) FROM c)""",
    "events",
)
def j18(events: DataFrame) -> DataFrame:
    """Users as conversations, purchases and signups as executions, errors as replays."""
    talks, runs, replays = (events.sparkSession.sql(f"WITH {_TALKS} SELECT * FROM {t}", events=events) for t in "cxr")
    last = talks.agg(F.max("created_at").alias("last"))
    before = talks.join(F.broadcast(last))
    gone = joins.overflow(before, runs, replays, 50, F.col("last"), F.unix_timestamp(F.date_trunc("hour", F.col("created_at").cast("timestamp"))))
    return gone.select("id", "age")


@query(
    "j19_stale_executions",
    """SELECT e.execution_id, c.call_id AS last_call FROM {execution} e JOIN
       (SELECT execution_id, call_id FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY called_at DESC, call_id DESC) AS r FROM {provider_call}) WHERE r = 1) c
       USING (execution_id) WHERE e.state = 'running' AND e.started_at < TIMESTAMP '1995-06-01'""",
    "execution",
    "provider_call",
)
def j19(execution: DataFrame, provider_call: DataFrame) -> DataFrame:
    stale = execution.where((F.col("state") == "running") & (F.col("started_at") < F.to_timestamp(F.lit("1995-06-01"))))
    calls = provider_call.join(stale, "execution_id", "left_semi")
    last = ranking.first_per_group(calls, ["execution_id"], [F.desc("called_at"), F.desc("call_id")])
    return last.select("execution_id", F.col("call_id").alias("last_call"))


# ---- windows -------------------------------------------------------------------------------


@query(
    "w01_top2_per_document",
    "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders}) WHERE r <= 2",
    "orders",
)
def w01(orders: DataFrame) -> DataFrame:
    return ranking.top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@query(
    "w02_rank_within_revision",
    "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS place FROM {lineitem}",
    "lineitem",
)
def w02(lineitem: DataFrame) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return lineitem.select("l_orderkey", "l_linenumber", F.row_number().over(order).cast("bigint").alias("place"))


@query(
    "w03_first_n_per_revision",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM {lineitem}) WHERE r <= 3",
    "lineitem",
)
def w03(lineitem: DataFrame) -> DataFrame:
    return ranking.top_per_group(lineitem, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey")], 3).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "w04_quota_per_target",
    """SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS r
       FROM {lineitem} WHERE l_partkey IN (1, 2, 3, 5, 8, 13, 21)) WHERE r <= ceil(30 / 7.0)""",
    "lineitem",
)
def w04(lineitem: DataFrame) -> DataFrame:
    targets = [1, 2, 3, 5, 8, 13, 21]
    order = [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]
    return ranking.top_per_group(lineitem.where(F.col("l_partkey").isin(targets)), ["l_partkey"], order, -(-30 // len(targets))).select(
        "l_partkey", "l_orderkey", "l_linenumber"
    )


@query(
    "w05_queue_position",
    "SELECT job_id, row_number() OVER (ORDER BY priority DESC, queued_at, job_id) AS position FROM {job} WHERE queue_state = 'queued'",
    "job",
)
def w05(job: DataFrame) -> DataFrame:
    queued = job.where("queue_state = 'queued'")
    bucket = F.struct(-F.col("priority"), F.date_trunc("hour", "queued_at"))
    return ranking.global_position(queued, [F.desc("priority"), F.col("queued_at"), F.col("job_id")], bucket).select("job_id", "position")


@query(
    "w06_distinct_on",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {events}) WHERE r = 1",
    "events",
)
def w06(events: DataFrame) -> DataFrame:
    return ranking.first_per_group(events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query(
    "w07_diversify",
    """SELECT event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS r FROM (
         SELECT event_id, user_id, row_number() OVER (ORDER BY value DESC, event_id) AS place FROM {events})) WHERE r <= CASE WHEN user_id % 10 = 0 THEN 5 ELSE 2 END ORDER BY place LIMIT 40""",
    "events",
)
def w07(events: DataFrame) -> DataFrame:
    # no more than the cap of any user can be in the answer, so the global order needs only those
    cap = F.when(F.col("user_id") % 10 == 0, 5).otherwise(2)
    order = [F.desc("value"), F.col("event_id")]
    ranked = ranking.global_position(events, order, -F.floor("value"), "place")
    return ranking.top_per_group(ranked, ["user_id"], [F.col("place")], cap).orderBy("place").limit(40).select("event_id", "place")


# ---- order and limits ----------------------------------------------------------------------


@query("t01_total_order_limit", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "orders")
def t01(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("t02_nulls_last", "SELECT document_id, parent_document_id FROM {document} ORDER BY parent_document_id DESC NULLS LAST, document_id LIMIT 200", "document")
def t02(document: DataFrame) -> DataFrame:
    return document.select("document_id", "parent_document_id").orderBy(F.desc_nulls_last("parent_document_id"), "document_id").limit(200)


@query(
    "t03_keyset_page",
    "SELECT event_id, ts FROM {events} WHERE (ts, event_id) < (TIMESTAMP '2024-01-12', 100) ORDER BY ts DESC, event_id DESC LIMIT 21",
    "events",
)
def t03(events: DataFrame) -> DataFrame:
    return ranking.keyset_page(events.select("event_id", "ts"), ["ts", "event_id"], ["2024-01-12 00:00:00", 100], 20)


@query(
    "t04_document_page",
    "SELECT document_id, title, byte_size FROM {document} WHERE document_state = 'active' ORDER BY byte_size DESC NULLS LAST, document_id DESC LIMIT 26 OFFSET 50",
    "document",
)
def t04(document: DataFrame) -> DataFrame:
    page = document.where("document_state = 'active'").orderBy(F.desc_nulls_last("byte_size"), F.desc("document_id"))
    return page.offset(50).limit(26).select("document_id", "title", "byte_size")


@query("t05_tail_slice", "SELECT l_orderkey, l_linenumber FROM (SELECT * FROM {lineitem} ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC LIMIT 30)", "lineitem")
def t05(lineitem: DataFrame) -> DataFrame:
    return ranking.tail_slice(lineitem, ["l_orderkey", "l_linenumber", "l_partkey"], 30).select("l_orderkey", "l_linenumber")


# ---- set operations ------------------------------------------------------------------------


@query(
    "u01_union_all_lanes",
    "SELECT 'lexical' AS lane, doc_id FROM {documents} WHERE contains(text, 'license') UNION ALL SELECT 'identity', doc_id FROM {documents} WHERE source = 'src1'",
    "documents",
)
def u01(documents: DataFrame) -> DataFrame:
    lexical = documents.where(F.contains("text", F.lit("license"))).select(F.lit("lexical").alias("lane"), "doc_id")
    return lexical.unionByName(documents.where("source = 'src1'").select(F.lit("identity").alias("lane"), "doc_id"))


@query("u02_union_distinct", "SELECT from_node_id AS node_id FROM {edge} UNION SELECT to_node_id FROM {edge}", "edge")
def u02(edge: DataFrame) -> DataFrame:
    return edge.select(F.explode(F.array("from_node_id", "to_node_id")).alias("node_id")).distinct()


@query("u03_except", "SELECT c_nationkey AS k FROM {customer} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000", "customer", "supplier")
def u03(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    return customer.select(F.col("c_nationkey").alias("k")).subtract(supplier.where("s_acctbal > 5000").select("s_nationkey"))


@query("u04_intersect", "SELECT l_partkey AS k FROM {lineitem} INTERSECT SELECT o_custkey FROM {orders}", "lineitem", "orders")
def u04(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    return lineitem.select(F.col("l_partkey").alias("k")).intersect(orders.select("o_custkey"))


@query(
    "u05_append_distinct",
    """WITH a AS (SELECT doc_id, doc_id AS place FROM {documents} WHERE contains(text, 'license')), b AS (SELECT doc_id, 10000000 - doc_id AS place FROM {documents})
       SELECT doc_id, pass FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pass, place) AS r FROM (SELECT *, 0 AS pass FROM a UNION ALL SELECT *, 1 FROM b)) WHERE r = 1""",
    "documents",
)
def u05(documents: DataFrame) -> DataFrame:
    a = documents.where(F.contains("text", F.lit("license"))).select("doc_id", F.col("doc_id").alias("place"))
    b = documents.select("doc_id", (10_000_000 - F.col("doc_id")).alias("place"))
    return ranking.append_distinct(a, b, "doc_id").select("doc_id", "pass")

