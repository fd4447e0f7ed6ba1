"""Queries of rollups, profiles and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, blocks, joins, ranking, records, summaries
from ..registry import query


@query("a01_count_by_library", "SELECT library_id, count(*) AS n_documents FROM {document} GROUP BY library_id", "document")
def a01(document: DataFrame) -> DataFrame:
    return document.groupBy("library_id").agg(F.count("*").alias("n_documents"))


@query(
    "a02_conditional_counts",
    """SELECT workspace_id, count(*) FILTER (WHERE queue_state = 'queued') AS queued, count(*) FILTER (WHERE queue_state = 'leased') AS leased,
       count(*) FILTER (WHERE queue_state = 'failed') AS failed FROM {job} GROUP BY workspace_id""",
    "job",
)
def a02(job: DataFrame) -> DataFrame:
    return job.groupBy("workspace_id").agg(*[F.count_if(F.col("queue_state") == s).alias(s) for s in ("queued", "leased", "failed")])


@query(
    "a03_generation_signals",
    """SELECT document_id, coalesce(max(revision_number) FILTER (WHERE text_state = 'ready'), 0) AS latest_ready, coalesce(bool_or(vector_state = 'ready') FILTER (WHERE text_state = 'ready'), false) AS has_vector
       FROM {revision} GROUP BY document_id""",
    "revision",
)
def a03(revision: DataFrame) -> DataFrame:
    ready = F.col("text_state") == "ready"
    return revision.groupBy("document_id").agg(
        F.coalesce(F.max(F.when(ready, F.col("revision_number"))), F.lit(0)).alias("latest_ready"),
        F.coalesce(F.bool_or(F.when(ready, F.col("vector_state") == "ready")), F.lit(False)).alias("has_vector"),
    )


@query(
    "a04_cost_by_currency",
    "SELECT currency_code, count(DISTINCT execution_id) FILTER (WHERE call_state = 'completed') AS executions, sum(cost_cents)::BIGINT AS cost_cents FROM {provider_call} GROUP BY currency_code",
    "provider_call",
)
def a04(provider_call: DataFrame) -> DataFrame:
    done = F.when(F.col("call_state") == "completed", F.col("execution_id"))
    return provider_call.groupBy("currency_code").agg(F.count_distinct(done).alias("executions"), F.sum("cost_cents").alias("cost_cents"))


@query(
    "a05_document_cost",
    """SELECT e.document_id, coalesce(c.currency_code, 'USD') AS currency_code, coalesce(sum(c.cost_cents), 0)::BIGINT AS cost_cents, count(c.call_id) AS calls
       FROM {execution} e LEFT JOIN {provider_call} c USING (execution_id) GROUP BY 1, 2""",
    "execution",
    "provider_call",
)
def a05(execution: DataFrame, provider_call: DataFrame) -> DataFrame:
    # calls are rolled up before the join, so that an execution's cost is never doubled
    rolled = provider_call.groupBy("execution_id", "currency_code").agg(F.sum("cost_cents").alias("c"), F.count("*").alias("n"))
    joined = execution.join(rolled, "execution_id", "left")
    return joined.groupBy("document_id", F.coalesce("currency_code", F.lit("USD")).alias("currency_code")).agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("cost_cents"), F.coalesce(F.sum("n"), F.lit(0)).alias("calls")
    )


@query(
    "a06_workspace_cost",
    "SELECT n_name AS workspace, currency_code, sum(cost_cents)::BIGINT AS cost_cents FROM {provider_call} JOIN {supplier} ON s_suppkey = provider_id JOIN {nation} ON n_nationkey = s_nationkey GROUP BY 1, 2",
    "provider_call",
    "supplier",
    "nation",
)
def a06(provider_call: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    by_provider = provider_call.groupBy("provider_id", "currency_code").agg(F.sum("cost_cents").alias("c"))
    named = by_provider.join(supplier, by_provider.provider_id == supplier.s_suppkey).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return named.groupBy(F.col("n_name").alias("workspace"), "currency_code").agg(F.sum("c").alias("cost_cents"))


@query(
    "a07_execution_cost_single_currency",
    """SELECT execution_id, count(DISTINCT call_id) AS calls, count(DISTINCT currency_code) > 1 AS mixed,
       CASE WHEN count(DISTINCT currency_code) <= 1 THEN sum(cost_cents)::BIGINT END AS total, CASE WHEN count(DISTINCT currency_code) <= 1 THEN coalesce(max(currency_code), 'USD') END AS currency_code
       FROM {provider_call} GROUP BY execution_id""",
    "provider_call",
)
def a07(provider_call: DataFrame) -> DataFrame:
    return aggregates.single_currency(provider_call, ["execution_id"], F.col("cost_cents"), "call_id")


@query(
    "a08_stage_cost_labels",
    """SELECT execution_id, string_agg(DISTINCT call_state, ',' ORDER BY call_state) AS states, min(called_at) AS first_at, max(called_at) AS last_at, count(DISTINCT provider_id) AS providers
       FROM {provider_call} GROUP BY execution_id""",
    "provider_call",
)
def a08(provider_call: DataFrame) -> DataFrame:
    return provider_call.groupBy("execution_id").agg(
        F.array_join(F.array_sort(F.collect_set("call_state")), ",").alias("states"),
        F.min("called_at").alias("first_at"), F.max("called_at").alias("last_at"), F.count_distinct("provider_id").alias("providers"),
    )


@query("a09_group_by_json_field", "SELECT props ->> '$.k' AS k, count(*) AS n FROM {events} GROUP BY 1", "events")
def a09(events: DataFrame) -> DataFrame:
    return events.groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query(
    "a10_support_counts",
    """SELECT p.p_partkey, coalesce(s.n, 0) AS support FROM {part} p LEFT JOIN (SELECT l_partkey, count(*) AS n FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey AND o_orderstatus = 'O' GROUP BY 1) s
       ON s.l_partkey = p.p_partkey""",
    "part",
    "lineitem",
    "orders",
)
def a10(part: DataFrame, lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    active = lineitem.join(orders.where("o_orderstatus = 'O'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    counts = active.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return part.select("p_partkey").join(counts, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("support"))


@query(
    "a11_link_counts",
    "SELECT node_id, sum(n)::BIGINT AS links FROM (SELECT from_node_id AS node_id, count(*) AS n FROM {edge} GROUP BY 1 UNION ALL SELECT to_node_id, count(*) FROM {edge} GROUP BY 1) GROUP BY 1",
    "edge",
)
def a11(edge: DataFrame) -> DataFrame:
    return edge.select(F.explode(F.array("from_node_id", "to_node_id")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("links"))


@query("a12_first_by_order", "SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_priority FROM {orders} GROUP BY o_custkey", "orders")
def a12(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("first_priority"))


@query(
    "a13_child_rows_json",
    """SELECT l_orderkey, '[' || string_agg('{"line":' || l_linenumber || ',"part":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']' AS children FROM {lineitem} GROUP BY l_orderkey""",
    "lineitem",
)
def a13(lineitem: DataFrame) -> DataFrame:
    child = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))
    return lineitem.groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(child))).alias("children"))


@query("a14_alias_set", "SELECT p_brand, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS aliases FROM {part} GROUP BY p_brand", "part")
def a14(part: DataFrame) -> DataFrame:
    return part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_name")), "|").alias("aliases"))


@query(
    "a15_rows_fingerprint",
    """SELECT l_orderkey, md5(string_agg(md5(concat_ws('|', l_partkey, l_suppkey, l_returnflag)), chr(30) ORDER BY l_linenumber, md5(concat_ws('|', l_partkey, l_suppkey, l_returnflag)))) AS fingerprint
       FROM {lineitem} GROUP BY l_orderkey""",
    "lineitem",
)
def a15(lineitem: DataFrame) -> DataFrame:
    return aggregates.rows_fingerprint(lineitem, ["l_orderkey"], ["l_partkey", "l_suppkey", "l_returnflag"], ["l_linenumber"])


@query(
    "a16_structural_density",
    """SELECT source, dense, longest FROM (SELECT source, count(*) FILTER (WHERE regexp_matches(text, '[0-9]{3}')) AS dense, max(n_chars) FILTER (WHERE regexp_matches(text, '[0-9]{3}')) AS longest
       FROM {documents} GROUP BY source) WHERE dense >= 3""",
    "documents",
)
def a16(documents: DataFrame) -> DataFrame:
    hit = F.col("text").rlike("[0-9]{3}")
    return documents.groupBy("source").agg(F.count_if(hit).alias("dense"), F.max(F.when(hit, F.col("n_chars"))).alias("longest")).where("dense >= 3")


_PROFILED = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS column_name, trim(CAST({c} AS VARCHAR)) AS value FROM {{part}}" for c in _PROFILED)


@query(
    "a17_column_profile",
    f"""WITH l AS ({_LONG}), c AS (SELECT column_name, value, count(*) AS n, try_cast(replace(replace(value, ' ', ''), ',', '.') AS DOUBLE) AS x FROM l GROUP BY 1, 2),
        s AS (SELECT column_name, sum(n)::BIGINT AS row_count, coalesce(sum(n) FILTER (WHERE value <> ''), 0)::BIGINT AS non_empty, count(*) FILTER (WHERE value <> '') AS distinct_count,
                coalesce(sum(n) FILTER (WHERE x IS NOT NULL), 0)::BIGINT AS numeric_count, min(x) AS lo, max(x) AS hi, sum(x * n) / sum(n) FILTER (WHERE x IS NOT NULL) AS mean, max(n) AS mode_count FROM c GROUP BY 1),
        m AS (SELECT column_name, string_agg(value, '|' ORDER BY value) AS modes FROM (SELECT c.*, row_number() OVER (PARTITION BY c.column_name ORDER BY c.n DESC, value) AS r FROM c)
              JOIN s USING (column_name) WHERE r <= 5 AND n = mode_count GROUP BY 1)
        SELECT column_name, row_count, non_empty, distinct_count, CASE WHEN num THEN 'numeric' ELSE 'categorical' END AS value_kind, CASE WHEN num THEN lo END AS min_value,
               CASE WHEN num THEN hi END AS max_value, CASE WHEN num THEN round(mean, 6) END AS mean_value, mode_count, modes
        FROM (SELECT *, numeric_count >= 2 AND numeric_count >= 0.8 * non_empty AS num FROM s) JOIN m USING (column_name)""",
    "part",
)
def a17(part: DataFrame) -> DataFrame:
    return aggregates.column_profiles(part, _PROFILED).withColumn("mean_value", F.round("mean_value", 6))


@query(
    "a18_value_shape",
    """WITH l AS (SELECT 'url' AS column_name, url AS value FROM {pages} UNION ALL SELECT 'page_id', CAST(page_id AS VARCHAR) FROM {pages} UNION ALL SELECT 'title', regexp_extract(html, '<title>([^<]*)</title>', 1) FROM {pages}),
       r AS (SELECT column_name, avg(CAST(regexp_matches(trim(value), '^https?://') AS INT)) AS u,
               avg(CAST(len(regexp_split_to_array(trim(value), '[ \\t\\n\\r]+')) = 1 AND regexp_matches(value, '[0-9]') AS INT)) AS i,
               avg(CAST(len(regexp_split_to_array(trim(value), '[ \\t\\n\\r]+')) >= 6 OR length(trim(value)) >= 48 AS INT)) AS n FROM l GROUP BY 1)
       SELECT column_name, CASE WHEN u >= 0.5 THEN 'url' WHEN i >= 0.6 THEN 'identifier' WHEN n >= 0.6 THEN 'narrative' ELSE 'label' END AS shape,
              CASE WHEN u >= 0.5 THEN 0 WHEN i >= 0.6 THEN 1 WHEN n >= 0.6 THEN 0 ELSE 3 END AS priority FROM r""",
    "pages",
)
def a18(pages: DataFrame) -> DataFrame:
    return aggregates.value_shapes(pages.select("url", "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")), ["url", "page_id", "title"])


@query(
    "a20_numeric_parse",
    """SELECT p_partkey, try_cast(replace(replace(v, ' ', ''), ',', '.') AS DOUBLE) AS number FROM
       (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '1 234,5' WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN 'n/a' ELSE '-3.25' END AS v FROM {part})""",
    "part",
)
def a20(part: DataFrame) -> DataFrame:
    i = F.col("p_partkey") % 4
    text = F.when(i == 0, "1 234,5").when(i == 1, F.col("p_size").cast("string")).when(i == 2, "n/a").otherwise("-3.25")
    return part.select("p_partkey", F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double").alias("number"))


@query(
    "a22_grouped_references",
    """SELECT l_suppkey, min(l_linenumber)::BIGINT AS best_rank, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'mixed' ELSE min(l_returnflag) END AS kind, count(DISTINCT l_orderkey) AS supports
       FROM {lineitem} GROUP BY l_suppkey""",
    "lineitem",
)
def a22(lineitem: DataFrame) -> DataFrame:
    kind = F.when(F.min("l_returnflag") != F.max("l_returnflag"), "mixed").otherwise(F.min("l_returnflag"))
    return lineitem.groupBy("l_suppkey").agg(F.min("l_linenumber").cast("bigint").alias("best_rank"), kind.alias("kind"), F.count_distinct("l_orderkey").alias("supports"))


@query(
    "a23_rank_metrics",
    """WITH r AS (SELECT item_id, CASE WHEN item_id % 6 = 5 THEN NULL ELSE item_id % 12 + 1 END AS rank FROM {benchmark})
       SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 9) AS hit_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 9) AS hit_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 9) AS hit_5,
              round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 9) AS hit_10, round(avg(coalesce(1.0 / rank, 0.0)), 9) AS mrr FROM r""",
    "benchmark",
)
def a23(benchmark: DataFrame) -> DataFrame:
    ranks = benchmark.select(F.when(F.col("item_id") % 6 != 5, F.col("item_id") % 12 + 1).alias("rank"))
    found = aggregates.rank_metrics(ranks)
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query(
    "a23_nearest_rank_percentiles",
    "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM {events} GROUP BY event_type",
    "events",
)
def a23_percentiles(events: DataFrame) -> DataFrame:
    return aggregates.nearest_rank(events, ["event_type"], "value", [50, 95, 99])


@query(
    "a24_library_metrics",
    """SELECT d.library_id, count(*) AS documents, count(*) FILTER (WHERE r.text_state = 'ready') AS ready,
       least(count(*) FILTER (WHERE r.graph_state = 'ready'), count(*) FILTER (WHERE r.text_state = 'ready')) AS graph_ready
       FROM {document} d JOIN {revision} r ON r.document_id = d.document_id AND r.revision_id = d.readable_revision_id WHERE d.document_state = 'active' GROUP BY 1""",
    "document",
    "revision",
)
def a24(document: DataFrame, revision: DataFrame) -> DataFrame:
    head = document.where("document_state = 'active'").select("library_id", F.col("readable_revision_id").alias("revision_id"))
    ready, graph = F.count_if(F.col("text_state") == "ready"), F.count_if(F.col("graph_state") == "ready")
    return head.join(revision, "revision_id").groupBy("library_id").agg(F.count("*").alias("documents"), ready.alias("ready"), F.least(graph, ready).alias("graph_ready"))


@query(
    "a27_charges",
    """SELECT c.call_id, CAST(CAST(p.cents_per_1000 AS DECIMAL(18,6)) * c.input_tokens / 1000000 AS DECIMAL(30,6))::DOUBLE AS charge, price_id FROM {provider_call} c LEFT JOIN (SELECT call_id, price_id, cents_per_1000 FROM (
         SELECT c.call_id, p.price_id, p.cents_per_1000, row_number() OVER (PARTITION BY c.call_id ORDER BY (p.scope = 'workspace') DESC, (p.tokens_from IS NOT NULL) DESC, p.tokens_from DESC, p.effective_from DESC, p.price_id) AS r
         FROM {provider_call} c JOIN {price} p ON p.provider_id = c.provider_id AND p.provider_id % 4 <> 1 AND p.effective_from <= c.called_at AND (p.effective_to IS NULL OR p.effective_to > c.called_at)
           AND (p.tokens_from IS NULL OR c.input_tokens >= p.tokens_from)) WHERE r = 1) p USING (call_id)""",
    "provider_call",
    "price",
)
def a27(provider_call: DataFrame, price: DataFrame) -> DataFrame:
    """Some providers have no prices."""
    return joins.charges(provider_call, price.where("provider_id % 4 <> 1")).select("call_id", F.col("charge").cast("double").alias("charge"), "price_id")


@query(
    "a29_queue_facts",
    "SELECT (SELECT count(*) FROM {job} WHERE queue_state = 'queued') AS queued_jobs, (SELECT count(*) FROM {execution} WHERE state = 'running') AS running_attempts",
    "job",
    "execution",
)
def a29(job: DataFrame, execution: DataFrame) -> DataFrame:
    return job.agg(F.count_if(F.col("queue_state") == "queued").alias("queued_jobs")).join(execution.agg(F.count_if(F.col("state") == "running").alias("running_attempts")))


@query(
    "a30_fact_coverage",
    """WITH l AS (SELECT doc_id, count(*) AS blocks FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM {documents}) WHERE trim(t, ' ') <> '' GROUP BY 1),
       f AS (SELECT doc_id, count(DISTINCT lower(v)) AS facts FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z_]+) ?= ?["]', 1)) AS v FROM {documents}) GROUP BY 1)
       SELECT d.doc_id, CASE WHEN d.doc_id % 7 = 3 THEN NULL WHEN coalesce(blocks, 0) = 0 THEN 0.0 ELSE least(coalesce(facts, 0)::DOUBLE / blocks, 1.0) END AS coverage FROM {documents} d LEFT JOIN l USING (doc_id) LEFT JOIN f USING (doc_id)""",
    "documents",
)
def a30(documents: DataFrame) -> DataFrame:
    """Assigned keys as facts, lines as blocks; every seventh document has not been scanned."""
    keys = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r'([A-Za-z_]+) ?= ?["]'), F.lit(1))).alias("v"))
    facts = keys.groupBy("doc_id").agg(F.count_distinct(F.lower("v")).alias("facts"))
    lines = blocks.line_chunks(documents).groupBy("doc_id").agg(F.count("*").alias("blocks"))
    known = documents.select("doc_id").join(facts, "doc_id", "left").join(lines, "doc_id", "left").na.fill(0, ["facts", "blocks"])
    scanned = F.when(F.col("doc_id") % 7 != 3, F.col("facts"))
    return known.select("doc_id", aggregates.coverage(scanned, F.col("blocks")).alias("coverage"))


@query(
    "a25_token_usage",
    """SELECT call_id, greatest(input_tokens - least(cached, input_tokens), 0) AS fresh_tokens, least(cached, input_tokens) AS cached_tokens, input_tokens + output_tokens AS total_tokens
       FROM (SELECT *, model_id * 20 AS cached FROM {provider_call})""",
    "provider_call",
)
def a25(provider_call: DataFrame) -> DataFrame:
    cached = F.least(F.col("model_id") * 20, F.col("input_tokens"))
    return provider_call.select("call_id", F.greatest(F.col("input_tokens") - cached, F.lit(0)).alias("fresh_tokens"), cached.alias("cached_tokens"), (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))


@query(
    "a26_unit_progress",
    "SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'F') AS done, count(*) AS units, floor(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END))::BIGINT AS pages FROM {lineitem} GROUP BY 1",
    "lineitem",
)
def a26(lineitem: DataFrame) -> DataFrame:
    done = F.col("l_linestatus") == "F"
    return lineitem.groupBy("l_orderkey").agg(F.count_if(done).alias("done"), F.count("*").alias("units"), F.floor(F.sum(F.when(done, F.col("l_quantity")).otherwise(0))).alias("pages"))


@query(
    "a28_execution_rollup",
    """SELECT e.execution_id, coalesce(c.currency_code, 'USD') AS currency_code, coalesce(sum(c.cost_cents), 0)::BIGINT AS cost_cents, count(DISTINCT c.call_id) AS calls
       FROM {execution} e LEFT JOIN {provider_call} c ON c.execution_id = e.execution_id GROUP BY 1, 2""",
    "execution",
    "provider_call",
)
def a28(execution: DataFrame, provider_call: DataFrame) -> DataFrame:
    rolled = provider_call.groupBy("execution_id", "currency_code").agg(F.sum("cost_cents").alias("c"), F.count_distinct("call_id").alias("n"))
    return execution.select("execution_id").join(rolled, "execution_id", "left").select(
        "execution_id", F.coalesce("currency_code", F.lit("USD")).alias("currency_code"), F.coalesce("c", F.lit(0)).alias("cost_cents"), F.coalesce("n", F.lit(0)).alias("calls")
    )


@query(
    "t07_top_communities",
    """WITH c AS (SELECT c_nationkey AS community, count(*) AS n FROM {customer} GROUP BY 1 ORDER BY n DESC, community LIMIT 5)
       SELECT community, n, (SELECT string_agg(c_name, '|' ORDER BY r) FROM (SELECT c_name, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM {customer} WHERE c_nationkey = community) WHERE r <= 10) AS members FROM c""",
    "customer",
)
def t07(customer: DataFrame) -> DataFrame:
    best = customer.groupBy(F.col("c_nationkey").alias("community")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(5)
    inside = customer.join(best.select(F.col("community").alias("c_nationkey")), "c_nationkey", "left_semi")
    top = ranking.top_per_group(inside, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 10, rank="r")
    names = top.groupBy(F.col("c_nationkey").alias("community")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "c_name"))), lambda x: x["c_name"]), "|").alias("members"))
    return best.join(names, "community")


@query(
    "k04_alias_upsert",
    """SELECT p_brand, string_agg(name, '|' ORDER BY first_seen, name) AS aliases FROM (SELECT p_brand, p_name AS name, min(p_partkey) AS first_seen FROM {part} GROUP BY 1, 2) GROUP BY p_brand""",
    "part",
)
def k04(part: DataFrame) -> DataFrame:
    seen = part.groupBy("p_brand", F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("first_seen"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first_seen", "name"))), lambda x: x["name"])
    return seen.groupBy("p_brand").agg(F.array_join(ordered, "|").alias("aliases"))


_SUMMED = f"""l AS ({_LONG}), c AS (SELECT column_name, value, count(*) AS n, try_cast(replace(replace(value, ' ', ''), ',', '.') AS DOUBLE) AS x FROM l GROUP BY 1, 2),
  s AS (SELECT column_name, sum(n)::BIGINT AS row_count, count(*) AS distinct_count, coalesce(sum(n) FILTER (WHERE x IS NOT NULL), 0)::BIGINT AS numeric_count, max(n) AS top, count(*) FILTER (WHERE NOT regexp_matches(value, ' ') AND regexp_matches(value, '[0-9]')) AS odd,
    sum(n) FILTER (WHERE NOT contains(value, ' ') AND regexp_matches(value, '[0-9]')) AS ids, sum(n) FILTER (WHERE len(string_split(value, ' ')) >= 6 OR length(value) >= 48) AS long FROM c GROUP BY 1),
  m AS (SELECT column_name, count(*) AS ties FROM c JOIN s USING (column_name) WHERE n = top GROUP BY 1),
  p AS (SELECT column_name, row_count, distinct_count, top, ties, numeric_count >= 2 AND numeric_count >= 0.8 * row_count AS num, CASE WHEN coalesce(ids, 0) >= 0.6 * row_count THEN 'identifier' WHEN coalesce(long, 0) >= 0.6 * row_count THEN 'narrative' ELSE 'label' END AS shape FROM s JOIN m USING (column_name)),
  f AS (SELECT *, CASE WHEN num THEN 3 WHEN shape = 'identifier' THEN 0 WHEN shape = 'narrative' THEN (top > 1 AND distinct_count < row_count)::INT WHEN top > 1 THEN 3 WHEN distinct_count = row_count THEN 2 ELSE 1 END AS priority FROM p)"""


@query("a21_summary_round_trip", f"""WITH {_SUMMED} SELECT column_name, CASE WHEN num THEN 'numeric' ELSE 'categorical' END AS value_kind, shape, priority, row_count, distinct_count, CASE WHEN num THEN 0 ELSE top END AS mode_count, CASE WHEN num THEN 0 ELSE ties END AS mode_ties, 'part' AS sheet FROM f""", "part")
def a21(part: DataFrame) -> DataFrame:
    """Lines of text from the columns' summaries, read back."""
    lines = summaries.summaries(part, _PROFILED, sheet="part").select(summaries.render().alias("line"))
    return lines.select(summaries.parse(F.col("line")).alias("s")).select("s.column_name", "s.value_kind", "s.shape", "s.priority", "s.row_count", "s.distinct_count", "s.mode_count", "s.mode_ties", "s.sheet")


@query("p12_graph_roles", f"""WITH {_SUMMED} SELECT replace(column_name, '_', ' ') AS key, NOT num AND shape = 'label' AND distinct_count * 5 >= row_count * 4 AS subject, NOT num AND shape <> 'identifier' AND top > 1 AS attribute FROM f""", "part")
def p12(part: DataFrame) -> DataFrame:
    return summaries.graph_roles(summaries.summaries(part, _PROFILED))


@query("p12_graph_rows", f"""WITH {_SUMMED}, r AS (SELECT bool_or(column_name = 'p_name' AND NOT num AND shape <> 'identifier' AND top > 1) AS a, bool_or(column_name = 'p_brand' AND NOT num AND shape <> 'identifier' AND top > 1) AS b, bool_or(column_name = 'p_type' AND NOT num AND shape <> 'identifier' AND top > 1) AS c FROM f)
  SELECT p_partkey, nullif(concat_ws(' | ', CASE WHEN a THEN 'p_name: ' || p_name END, CASE WHEN b THEN 'p_brand: ' || p_brand END, CASE WHEN c THEN 'p_type: ' || p_type END), '') AS text FROM {{part}}, r""", "part")  # fmt: skip
def p12_rows(part: DataFrame) -> DataFrame:
    """Rows as text; the roles of a table's columns are one small row beside each."""
    roles = summaries.graph_roles(summaries.summaries(part, _PROFILED)).agg(F.array_sort(F.collect_list(F.struct("key", "subject", "attribute"))).alias("roles"))
    rows = part.select("p_partkey", records.semantic_row("part", F.col("p_partkey"), _PROFILED).alias("row"))
    return rows.join(F.broadcast(roles)).select("p_partkey", summaries.graph_row(F.col("row"), F.col("roles")).alias("text"))
