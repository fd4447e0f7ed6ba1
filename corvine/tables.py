"""Canonical tables of the engine, derived from the fixture tables.

Each is SQL over fixture tables in the dialect that Spark and DuckDB share, so the
same text gives the rows on both sides; fixtures are named in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXTURES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()

CANONICAL = {
    # documents with a head: which revision may be read, and a state
    "document": """
        SELECT doc_id AS document_id, source AS library_id, concat('Doc ', source, ' part ', CAST(doc_id % 40 AS VARCHAR(20))) AS title,
               CASE WHEN doc_id % 11 = 0 THEN 'deleted' ELSE 'active' END AS document_state,
               CASE WHEN doc_id % 17 = 5 THEN NULL ELSE doc_id * 10 + 2 END AS readable_revision_id,
               doc_id * 10 + CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 2 END AS active_revision_id,
               CASE WHEN doc_id % 9 = 4 THEN doc_id - 4 ELSE NULL END AS parent_document_id,
               n_chars AS byte_size, lang
        FROM {documents}""",
    # two revisions of each document; the second one is the head's
    "revision": """
        SELECT doc_id * 10 + r AS revision_id, doc_id AS document_id, r AS revision_number,
               CASE WHEN doc_id % 6 = 1 THEN 'failed' ELSE 'ready' END AS text_state,
               CASE WHEN doc_id % 4 = 3 THEN 'pending' ELSE 'ready' END AS vector_state,
               CASE WHEN doc_id % 7 = 2 THEN 'failed' ELSE 'ready' END AS graph_state
        FROM {documents} CROSS JOIN (SELECT 1 AS r UNION ALL SELECT 2 AS r) AS x""",
    # the newest mutation of each document and its job; some documents have neither
    "mutation": """
        SELECT doc_id AS document_id,
               CASE doc_id % 8 WHEN 0 THEN 'failed' WHEN 1 THEN 'conflicted' WHEN 2 THEN 'canceled' WHEN 3 THEN 'accepted' WHEN 4 THEN 'running' ELSE 'applied' END AS mutation_state,
               CASE doc_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'leased' WHEN 2 THEN 'canceled' WHEN 3 THEN 'queued' WHEN 4 THEN 'completed' ELSE NULL END AS queue_state
        FROM {documents} WHERE doc_id % 10 <> 9""",
    # provider calls: an order is an execution of a customer's document, a line one call of it
    "provider_call": """
        SELECT l_orderkey * 10 + l_linenumber AS call_id, l_orderkey AS execution_id, l_suppkey AS provider_id, l_partkey AS model_id,
               CAST(floor(l_quantity) AS BIGINT) * 1000 AS input_tokens, CAST(floor(l_extendedprice) AS BIGINT) AS output_tokens,
               CASE WHEN l_linenumber % 7 = 6 THEN 'EUR' ELSE 'USD' END AS currency_code,
               CASE l_returnflag WHEN 'A' THEN 'failed' WHEN 'R' THEN 'canceled' ELSE 'completed' END AS call_state,
               l_shipdate AS called_at, CAST(round(l_extendedprice * 100) AS BIGINT) AS cost_cents
        FROM {lineitem}""",
    "execution": """
        SELECT o_orderkey AS execution_id, o_custkey AS document_id, o_orderdate AS started_at,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'queued' END AS state, o_orderpriority AS priority
        FROM {orders}""",
    # a price list by supplier with half-open periods of validity
    "price": """
        SELECT s_suppkey * 10 + k AS price_id, s_suppkey AS provider_id,
               CASE WHEN k = 3 THEN 'workspace' ELSE 'system' END AS scope,
               CAST(CASE k WHEN 1 THEN '1990-01-01' WHEN 2 THEN '1995-01-01' ELSE '1996-06-01' END AS TIMESTAMP) AS effective_from,
               CAST(CASE k WHEN 1 THEN '1995-01-01' WHEN 2 THEN NULL ELSE '1997-06-01' END AS TIMESTAMP) AS effective_to,
               CASE WHEN k = 2 AND s_suppkey % 2 = 0 THEN 20000 ELSE NULL END AS tokens_from,
               s_suppkey % 9 + k AS cents_per_1000
        FROM {supplier} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k UNION ALL SELECT 3 AS k) AS x
        WHERE k < 3 OR s_suppkey % 3 = 0""",
    # nodes and edges of a knowledge graph: customers, parts and nations; who bought what
    "node": """
        SELECT concat('person:', CAST(c_custkey AS VARCHAR(20))) AS node_id, c_name AS label, 'person' AS node_type, c_custkey % 5 AS support_count FROM {customer}
        UNION ALL SELECT concat('artifact:', CAST(p_partkey AS VARCHAR(20))), p_name, 'artifact', p_partkey % 7 FROM {part}
        UNION ALL SELECT concat('location:', CAST(n_nationkey AS VARCHAR(20))), n_name, 'location', n_nationkey % 3 FROM {nation}""",
    "edge": """
        SELECT DISTINCT concat('person:', CAST(o_custkey AS VARCHAR(20))) AS from_node_id, concat('artifact:', CAST(l_partkey AS VARCHAR(20))) AS to_node_id, 'bought' AS relation_type
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
        UNION ALL SELECT concat('person:', CAST(c_custkey AS VARCHAR(20))), concat('location:', CAST(c_nationkey AS VARCHAR(20))), 'lives_in' FROM {customer}""",
    # what was found in chunks (orders) of documents (customers): entities, and relations between labels
    "entity_candidate": """
        SELECT o_orderkey AS chunk_id, o_custkey AS document_id, concat(' ', p_name) AS label, CASE WHEN l_linenumber % 3 = 0 THEN 'concept' ELSE 'artifact' END AS node_type,
               CASE WHEN l_linenumber % 2 = 0 THEN p_brand ELSE NULL END AS alias, CASE WHEN l_linenumber % 4 = 1 THEN p_type ELSE NULL END AS summary
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey
        UNION ALL SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN c_name ELSE upper(c_name) END, 'person', CAST(NULL AS VARCHAR(20)), c_mktsegment
        FROM {orders} JOIN {customer} ON c_custkey = o_custkey""",
    "relation_candidate": """
        SELECT o_orderkey AS chunk_id, o_custkey AS document_id, c_name AS source_label, p_name AS target_label,
               CASE l_linenumber % 4 WHEN 0 THEN 'bought' WHEN 1 THEN ' received ' WHEN 2 THEN 'Has Bought' ELSE '' END AS relation_type,
               CASE WHEN l_linenumber % 2 = 0 THEN concat('line ', CAST(l_linenumber AS VARCHAR(20))) ELSE NULL END AS summary
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey JOIN {customer} ON c_custkey = o_custkey
        UNION ALL SELECT o_orderkey, o_custkey, c_name, concat(c_name, '!'), 'same_as', CAST(NULL AS VARCHAR(20)) FROM {orders} JOIN {customer} ON c_custkey = o_custkey
        UNION ALL SELECT o_orderkey, o_custkey, c_name, n_name, 'lives_in', 'home' FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey""",
    # queue of jobs: events as jobs, their users as workspaces
    "job": """
        SELECT event_id AS job_id, user_id % 20 AS workspace_id, user_id AS library_id, ts AS queued_at,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'leased' WHEN 'signup' THEN 'completed' ELSE 'queued' END AS queue_state,
               CAST(floor(value) AS BIGINT) % 3 AS priority, value, props
        FROM {events}""",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture or canonical table."""
    if name not in CANONICAL:
        return fixture(spark, sf_dir, name)
    text = CANONICAL[name]
    used = set(re.findall(r"\{([a-z]\w*)\}", text))
    return spark.sql(text, **{t: load(spark, sf_dir, t) for t in used})


def oracle(sql: str) -> str:
    """``sql`` for DuckDB with the canonical tables that it names in braces in front."""
    names = list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", sql)))
    parts = [f"{n} AS ({re.sub(r'[{}]', '', CANONICAL[n])})" for n in names if n in CANONICAL]
    body = re.sub(r"\{([a-z]\w*)\}", r"\1", sql).strip()
    if not parts:
        return body
    if re.match(r"WITH RECURSIVE\b", body):
        return f"WITH RECURSIVE {', '.join(parts)}, {body[len('WITH RECURSIVE'):]}"
    return f"WITH {', '.join(parts)}, {body[4:]}" if re.match(r"WITH\b", body) else f"WITH {', '.join(parts)} {body}"
