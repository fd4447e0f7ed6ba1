"""Queries of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import uuid5_sql
from ..operators import graph, merge
from ..registry import query

_NB = "nb AS (SELECT from_node_id AS a, to_node_id AS b FROM {edge} UNION SELECT to_node_id, from_node_id FROM {edge})"
#: Edges with a support, and both directions of them with supports added.
_SUPPORT = "(length(to_node_id) * 7 + length(from_node_id)) % 5 + 1"
_WEIGHED = f"e AS (SELECT from_node_id AS a, to_node_id AS b, {_SUPPORT} AS w FROM {{edge}}), nb AS (SELECT a, b, sum(w) AS w FROM (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e) GROUP BY 1, 2)"


def _supported(edge: DataFrame) -> DataFrame:
    return edge.withColumn("support_count", F.expr(_SUPPORT))


@query("g02_node_keys", """SELECT node_id, node_type || ':' || trim(regexp_replace(lower(label), '[^\\p{L}\\p{N}]+', '_', 'g'), '_') AS canonical_key FROM {node}""", "node")
def g02(node: DataFrame) -> DataFrame:
    return node.select("node_id", graph.node_key(F.col("node_type"), F.col("label")).alias("canonical_key"))


@query("g02_edge_keys", "SELECT from_node_id || '--' || relation_type || '--' || to_node_id AS canonical_key FROM {edge}", "edge")
def g02_edges(edge: DataFrame) -> DataFrame:
    return edge.select(graph.edge_key(F.col("from_node_id"), F.col("relation_type"), F.col("to_node_id")).alias("canonical_key"))


@query("x14_graph_admission", """SELECT node_id FROM {node} WHERE node_id IN (SELECT from_node_id FROM {edge} WHERE from_node_id <> to_node_id UNION SELECT to_node_id FROM {edge} WHERE from_node_id <> to_node_id)""", "node", "edge")
def x14(node: DataFrame, edge: DataFrame) -> DataFrame:
    return graph.admitted_nodes(node, edge).select("node_id")


@query("g03_label_types", """SELECT label, node_type FROM (SELECT lower(label) AS label, node_type, row_number() OVER (PARTITION BY lower(label) ORDER BY CASE node_type WHEN 'document' THEN 0 WHEN 'concept' THEN 1 ELSE 2 END DESC, node_id) AS r FROM {node}) WHERE r = 1""", "node")
def g03(node: DataFrame) -> DataFrame:
    return graph.label_types(node)


_CANON = """m AS (SELECT node_id, label, node_type, support_count, first_value(node_id) OVER (PARTITION BY trim(regexp_replace(lower(label), '[^\\p{L}\\p{N}]+', '_', 'g'), '_') ORDER BY support_count DESC, label, node_id) AS cid FROM {node})"""


@query("g05_canonical_nodes", f"WITH {_CANON} SELECT node_id, label FROM m WHERE node_id = cid", "node", "edge")
def g05(node: DataFrame, edge: DataFrame) -> DataFrame:
    return graph.canonical(node, edge)[0].select("node_id", "label")


@query("g06_canonical_edges", f"WITH {_CANON} SELECT a.cid AS from_node_id, relation_type, b.cid AS to_node_id, count(*) AS support_count FROM {{edge}} JOIN m a ON a.node_id = from_node_id JOIN m b ON b.node_id = to_node_id WHERE a.cid <> b.cid GROUP BY 1, 2, 3", "node", "edge")
def g06(node: DataFrame, edge: DataFrame) -> DataFrame:
    return graph.canonical(node, edge)[1]


@query("g08_support_recount", "SELECT n.node_id, count(e.to_node_id) AS support FROM {node} n JOIN {edge} e ON e.to_node_id = n.node_id GROUP BY 1", "node", "edge")
def g08(node: DataFrame, edge: DataFrame) -> DataFrame:
    counts = edge.groupBy(F.col("to_node_id").alias("node_id")).agg(F.count("*").alias("support"))
    return node.select("node_id").join(counts, "node_id")


#: Edges whose evidence is an active document: those of the others' persons are gone.
_ACTIVE = "CAST(split_part(from_node_id, ':', 2) AS BIGINT) % 11 <> 0"


@query("g09_unsupported_nodes", f"WITH e AS (SELECT * FROM {{edge}} WHERE {_ACTIVE}) SELECT node_id FROM {{node}} WHERE NOT EXISTS (SELECT 1 FROM e WHERE from_node_id = node_id OR to_node_id = node_id)", "node", "edge")
def g09(node: DataFrame, edge: DataFrame) -> DataFrame:
    return node.join(graph.endpoints(edge.where(_ACTIVE)), "node_id", "left_anti").select("node_id")


@query("g10_traversal", f"""WITH {_NB}, d0 AS (SELECT 'person:3' AS node_id), d1 AS (SELECT DISTINCT b AS node_id FROM nb JOIN d0 ON a = node_id), d2 AS (SELECT DISTINCT b AS node_id FROM nb JOIN d1 ON a = node_id)
  SELECT node_id, min(depth)::INTEGER AS depth FROM (SELECT node_id, 0 AS depth FROM d0 UNION ALL SELECT node_id, 1 FROM d1 UNION ALL SELECT node_id, 2 FROM d2) GROUP BY 1""", "edge")  # fmt: skip
def g10(edge: DataFrame) -> DataFrame:
    return graph.traverse(edge, ["person:3"], 2)


def _round(i: int) -> str:
    return f"""v{i} AS (SELECT a AS node_id, community, sum(w) AS n FROM nb JOIN l{i - 1} ON b = l{i - 1}.node_id GROUP BY 1, 2),
      l{i} AS (SELECT node_id, community FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY n DESC, community) AS r FROM v{i}) WHERE r = 1)"""


@query("g11_label_propagation", f"WITH {_WEIGHED}, l0 AS (SELECT DISTINCT a AS node_id, a AS community FROM nb), {_round(1)}, {_round(2)} SELECT node_id, community FROM l2", "edge")
def g11(edge: DataFrame) -> DataFrame:
    return graph.label_propagation(_supported(edge), rounds=2)


@query("g12_community_sizes", f"WITH {_WEIGHED}, l0 AS (SELECT DISTINCT a AS node_id, a AS community FROM nb), {_round(1)}, {_round(2)} SELECT community, count(*) AS size, min(node_id) AS first_member FROM l2 GROUP BY community HAVING count(*) >= 10", "edge")
def g12(edge: DataFrame) -> DataFrame:
    found = graph.label_propagation(_supported(edge), rounds=2)
    return found.groupBy("community").agg(F.count("*").alias("size"), F.min("node_id").alias("first_member")).where("size >= 10")


@query("g14_associative_expansion", """WITH e AS (SELECT *, length(to_node_id) AS support_count FROM {edge}), b AS (SELECT from_node_id AS node_id, to_node_id AS other, relation_type, support_count FROM e UNION ALL SELECT to_node_id, from_node_id, relation_type, support_count FROM e)
  SELECT node_id, other FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY support_count DESC, other, relation_type) AS r FROM b WHERE node_id IN ('location:1', 'person:5', 'artifact:9')) WHERE r <= 8""", "edge")  # fmt: skip
def g14(edge: DataFrame) -> DataFrame:
    seeds = edge.sparkSession.createDataFrame([("location:1",), ("person:5",), ("artifact:9",)], "node_id string")
    return graph.expand(edge.withColumn("support_count", F.length("to_node_id")), seeds, 8).select("node_id", "other")


def _walk(i: int) -> str:
    return f"""m{i} AS (SELECT b AS node_id, sum(p{i - 1}.score / d.d) AS m FROM nb JOIN d ON d.a = nb.a JOIN p{i - 1} ON p{i - 1}.node_id = nb.a GROUP BY 1),
      p{i} AS (SELECT n.node_id, n.t, 0.85 * coalesce(m, 0) + 0.15 * n.t AS score FROM n LEFT JOIN m{i} ON m{i}.node_id = n.node_id)"""


@query("g15_personalised_pagerank", f"""WITH {_NB}, d AS (SELECT a, count(*) AS d FROM nb GROUP BY a), n AS (SELECT a AS node_id, CASE a WHEN 'person:5' THEN 2.0::DOUBLE / 3.5 WHEN 'location:1' THEN 1.5::DOUBLE / 3.5 ELSE 0 END AS t FROM d),
  p0 AS (SELECT node_id, t, t AS score FROM n), {', '.join(map(_walk, range(1, 9)))} SELECT node_id, round(score, 8) AS score FROM p8""", "edge")  # fmt: skip
def g15(edge: DataFrame) -> DataFrame:
    ranks = graph.personalised_pagerank(edge, ["person:5", "location:1"])
    return ranks.select("node_id", F.round("score", 8).alias("score"))


_NEAR = "(SELECT count(*) FROM (SELECT unnest(['wideget', 'person', 'bough']) AS k) WHERE len(list_filter(regexp_split_to_array(lower(relation_type || ' ' || a.label || ' ' || a.node_type || ' ' || b.label || ' ' || b.node_type), '[^a-z0-9]+'), lambda w: w = k OR (length(w) >= 5 AND length(k) >= 5 AND w[1] = k[1] AND levenshtein(w, k) <= 1))) > 0)"


@query("g16_edge_relevance", f"""SELECT from_node_id, to_node_id, round(greatest(a.support_count, b.support_count) + 0.5 * least(a.support_count, b.support_count) + 0.24 * {_NEAR} + 0.015 * ln(1 + greatest(a.support_count, b.support_count, 1)), 6)::DOUBLE AS relevance FROM {{edge}} JOIN {{node}} a ON a.node_id = from_node_id JOIN {{node}} b ON b.node_id = to_node_id""", "edge", "node")
def g16(edge: DataFrame, node: DataFrame) -> DataFrame:
    found = graph.edge_relevance(edge, node, ["wideget", "person", "bough"])
    return found.select("from_node_id", "to_node_id", F.round("relevance", 6).alias("relevance"))


@query("g18_sense_dominance", "SELECT node_id FROM (SELECT *, max(support_count) OVER (PARTITION BY node_type) AS m FROM {node}) WHERE support_count >= greatest(m // 2, 1)", "node")
def g18(node: DataFrame) -> DataFrame:
    return graph.sense_dominance(node, ["node_type"], floor=2).select("node_id")


@query("g24_missing_nodes", "SELECT d.document_id FROM {document} d WHERE NOT EXISTS (SELECT 1 FROM {node} n WHERE n.node_id = 'person:' || d.document_id AND n.support_count > 0) AND d.document_state = 'active'", "document", "node")
def g24(document: DataFrame, node: DataFrame) -> DataFrame:
    known = node.select(F.expr("try_cast(split_part(node_id, ':', 2) AS bigint)").alias("document_id"), "node_type", "support_count").where("node_type = 'person' AND support_count > 0")
    return document.where("document_state = 'active'").join(known, "document_id", "left_anti").select("document_id")


@query("g26_top_entities", "SELECT node_id, support_count FROM {node} ORDER BY support_count DESC, label, node_id LIMIT 40", "node")
def g26(node: DataFrame) -> DataFrame:
    return node.orderBy(F.desc("support_count"), "label", "node_id").limit(40).select("node_id", "support_count")


@query("t06_ranked_subgraph", """WITH t AS (SELECT node_id FROM {node} ORDER BY support_count DESC, label, node_id LIMIT 2000) SELECT DISTINCT from_node_id, relation_type, to_node_id FROM {edge} WHERE from_node_id IN (SELECT node_id FROM t) AND to_node_id IN (SELECT node_id FROM t)
  ORDER BY 1, 2, 3 LIMIT 5000""", "node", "edge")  # fmt: skip
def t06(node: DataFrame, edge: DataFrame) -> DataFrame:
    return graph.ranked_subgraph(node, edge, 2000)[1]


@query("g29_stale_evidence", """SELECT r.revision_id FROM {revision} r WHERE NOT EXISTS (SELECT 1 FROM {document} d WHERE d.document_id = r.document_id AND (d.readable_revision_id = r.revision_id OR d.active_revision_id = r.revision_id))""", "revision", "document")
def g29(revision: DataFrame, document: DataFrame) -> DataFrame:
    heads = document.select("document_id", F.explode(F.array("readable_revision_id", "active_revision_id")).alias("revision_id")).where("revision_id IS NOT NULL")
    return revision.join(heads, ["document_id", "revision_id"], "left_anti").select("revision_id")


@query("g13_community_summary", """SELECT c_nationkey, string_agg(c_name, ', ' ORDER BY r) AS summary FROM (SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM {customer}) WHERE r <= 3 GROUP BY 1""", "customer")
def g13(customer: DataFrame) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    top = customer.withColumn("r", F.row_number().over(w)).where("r <= 3")
    return top.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "c_name"))), lambda x: x["c_name"]), ", ").alias("summary"))


# ---- candidates merged, and acronyms

_KEY = "trim(regexp_replace(lower(trim({0})), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_')".format
_MERGE = f"""f AS (SELECT chunk_id, document_id, trim(label) AS label, {_KEY('label')} AS k, node_type, alias, summary FROM {{entity_candidate}}),
   t AS (SELECT chunk_id, k, arg_min(node_type, (CASE node_type WHEN 'document' THEN 2 WHEN 'concept' THEN 1 ELSE 0 END, node_type)) AS type FROM f GROUP BY 1, 2),
   n AS (SELECT f.*, type || ':' || k AS key FROM f JOIN t USING (chunk_id, k)),
   g AS (SELECT r.*, coalesce(a.type, 'concept') || ':' || {_KEY('source_label')} AS source_key, coalesce(b.type, 'concept') || ':' || {_KEY('target_label')} AS target_key,
     CASE WHEN regexp_matches(trim(relation_type), '^[a-z][a-z0-9]*(_[a-z0-9]+)*$') THEN trim(relation_type) ELSE '' END AS relation FROM {{relation_candidate}} r
     LEFT JOIN t a ON a.chunk_id = r.chunk_id AND a.k = {_KEY('source_label')} LEFT JOIN t b ON b.chunk_id = r.chunk_id AND b.k = {_KEY('target_label')}),
   ok AS (SELECT * FROM g WHERE relation <> '' AND source_key <> target_key),
   rows_ AS (SELECT chunk_id, document_id, key, label, alias, summary, 0 AS last FROM n UNION ALL SELECT chunk_id, document_id, source_key, trim(source_label), NULL, NULL, 1 FROM ok
     UNION ALL SELECT chunk_id, document_id, target_key, trim(target_label), NULL, NULL, 1 FROM ok UNION ALL SELECT chunk_id, document_id, 'document:' || document_id, document_id::VARCHAR, NULL, NULL, 0 FROM n),
   each_ AS (SELECT chunk_id, document_id, 'document:' || document_id AS source_key, 'mentions' AS relation, key AS target_key, NULL AS summary FROM n UNION ALL SELECT chunk_id, document_id, source_key, relation, target_key, summary FROM ok)"""


@query("g04_merged_nodes", f"""WITH {_MERGE}, a AS (SELECT key, string_agg(DISTINCT x, '|' ORDER BY x) AS aliases FROM (SELECT key, label AS x FROM rows_ UNION ALL SELECT key, alias FROM rows_) WHERE x <> '' GROUP BY 1)
   SELECT {uuid5_sql("'node|' || key")} AS node_id, key AS canonical_key, arg_min(label, (last, chunk_id, label)) AS label, split_part(key, ':', 1) AS node_type, any_value(aliases) AS aliases,
   arg_min(summary, (chunk_id, summary)) FILTER (WHERE summary IS NOT NULL) AS summary, count(DISTINCT chunk_id) AS support_count FROM rows_ JOIN a USING (key) GROUP BY key""", "entity_candidate", "relation_candidate")  # fmt: skip
def g04_nodes(entities: DataFrame, relations: DataFrame) -> DataFrame:
    nodes = merge.merge_candidates(entities, relations).nodes
    return nodes.withColumn("aliases", F.array_join("aliases", "|"))


@query("g04_merged_edges", f"""WITH {_MERGE}, k AS (SELECT *, source_key || '--' || relation || '--' || target_key AS key FROM each_)
   SELECT {uuid5_sql("'edge|' || key")} AS edge_id, key AS canonical_key, {uuid5_sql("'node|' || source_key")} AS from_node_id, {uuid5_sql("'node|' || target_key")} AS to_node_id, relation AS relation_type,
   arg_min(summary, (chunk_id, summary)) FILTER (WHERE summary IS NOT NULL) AS summary, count(DISTINCT chunk_id) AS support_count FROM k GROUP BY key, source_key, relation, target_key""", "entity_candidate", "relation_candidate")  # fmt: skip
def g04_edges(entities: DataFrame, relations: DataFrame) -> DataFrame:
    return merge.merge_candidates(entities, relations).edges


@query("g04_rejected_relations", f"""WITH {_MERGE} SELECT chunk_id, document_id, source_key, target_key, relation_type AS raw_relation_type, CASE WHEN relation = '' THEN 'empty_relation' ELSE 'degenerate_self_loop' END AS reason,
   {uuid5_sql("'rejected|' || chunk_id || '|' || source_key || '--' || relation_type || '--' || target_key")} AS rejected_id FROM g WHERE relation = '' OR source_key = target_key""", "entity_candidate", "relation_candidate")  # fmt: skip
def g04_rejected(entities: DataFrame, relations: DataFrame) -> DataFrame:
    return merge.merge_candidates(entities, relations).rejected


@query("g28_evidence_per_target", f"""WITH {_MERGE}, k AS (SELECT 'node' AS target_kind, key, chunk_id, document_id FROM rows_ UNION SELECT 'edge', source_key || '--' || relation || '--' || target_key, chunk_id, document_id FROM each_)
   SELECT target_kind, {uuid5_sql("target_kind || '|' || key")} AS target_id, count(*) AS evidence, count(DISTINCT document_id) AS documents FROM k GROUP BY target_kind, key""", "entity_candidate", "relation_candidate")  # fmt: skip
def g28(entities: DataFrame, relations: DataFrame) -> DataFrame:
    return merge.merge_candidates(entities, relations).targets


@query("g20_acronym_aliases", """SELECT 'artifact:' || p_partkey AS node_id, upper(substr(split_part(p_name, ' ', 1), 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)) AS alias FROM {part} WHERE regexp_matches(p_name, '^[a-z]+ [a-z]+$') AND p_partkey % 5 <> 0
   UNION ALL SELECT 'short:' || p_partkey, p_name FROM {part} WHERE regexp_matches(p_name, '^[a-z]+ [a-z]+$') AND p_partkey % 5 <> 0""", "part")  # fmt: skip
def g20(part: DataFrame) -> DataFrame:
    """Parts and their short forms: a chunk of each part glosses its name, every fifth with other letters."""
    named = part.where(F.col("p_name").rlike("^[a-z]+ [a-z]+$"))
    short = F.upper(F.concat(F.substring("p_name", 1, 1), F.substring(F.split_part("p_name", F.lit(" "), F.lit(2)), 1, 1)))
    told = F.when(F.col("p_partkey") % 5 == 0, F.lit("XQ")).otherwise(short)
    chunks = named.select(F.col("p_partkey").alias("chunk_id"), F.concat(F.lit("Of all (some) parts the "), F.col("p_name"), F.lit(" ( "), told, F.lit(" ) is of type "), F.col("p_type")).alias("text"))
    of = lambda kind: F.concat(F.lit(f"{kind}:"), F.col("p_partkey").cast("string")).alias("node_id")
    nodes = named.select(of("artifact"), F.initcap("p_name").alias("label")).unionByName(named.select(of("short"), short.alias("label")))
    evidence = named.select(of("artifact"), F.col("p_partkey").alias("chunk_id")).unionByName(named.select(of("short"), F.col("p_partkey").alias("chunk_id")))
    return merge.acronym_aliases(merge.gloss_table(chunks), nodes, evidence)


@query("g21_acronym_terms", """WITH w AS (SELECT p_partkey, string_split(lower(p_type) || ' ' || p_name, ' ') AS w FROM {part} WHERE regexp_matches(lower(p_type) || ' ' || p_name, '^[a-z]{2,}( [a-z]{2,})*$')), d AS (SELECT p_partkey, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM w),
   t AS (SELECT p_partkey, unnest(range(1, len(w) + 1)) AS i, w FROM d), n AS (SELECT p_partkey, w, i, unnest([2, 3, 4]) AS n FROM t)
   SELECT p_partkey, string_agg(DISTINCT a, ',' ORDER BY a) AS terms FROM (SELECT p_partkey, list_aggregate(list_transform(w[i:i + n - 1], lambda x: x[1]), 'string_agg', '') AS a FROM n WHERE i + n - 1 <= len(w)) GROUP BY 1""", "part")  # fmt: skip
def g21(part: DataFrame) -> DataFrame:
    label = F.concat_ws(" ", F.lower("p_type"), "p_name")
    # parts are small rows in few files, and labels take longer than reading: rows are dealt out
    plain = part.where(label.rlike("^[a-z]{2,}( [a-z]{2,})*$")).select("p_partkey", label.alias("label")).repartition(int(part.sparkSession.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    # a filter of the terms would find them twice
    return plain.select("p_partkey", F.explode(F.filter(F.array(F.array_join(merge.acronym_terms(F.col("label")), ",")), lambda t: t != "")).alias("terms"))
