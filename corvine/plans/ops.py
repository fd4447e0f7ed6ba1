"""Queries of queues, runs, retention and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import queue as q
from ..operators import ranking
from ..registry import query


@query("q05_queue_claim", """WITH l AS (SELECT * FROM {job} WHERE queue_state = 'leased') SELECT job_id, workspace_id FROM {job} j WHERE queue_state = 'queued' AND (SELECT count(*) FROM l) < 100000
  AND (SELECT count(*) FROM l WHERE l.workspace_id = j.workspace_id) < 100 AND (SELECT count(*) FROM l WHERE l.library_id = j.library_id) < 20
  ORDER BY priority, (SELECT count(*) FROM l WHERE l.library_id = j.library_id), queued_at, job_id LIMIT 1""", "job")  # fmt: skip
def q05(job: DataFrame) -> DataFrame:
    return q.claimable(job, 100_000, 100, 20)


@query("q06_stale_leases", "SELECT job_id FROM {job} WHERE queue_state = 'leased' AND floor(epoch(TIMESTAMP '2024-01-20')) - floor(epoch(queued_at)) > 60", "job")
def q06(job: DataFrame) -> DataFrame:
    return q.stale_leases(job, F.to_timestamp(F.lit("2024-01-20")), 60).select("job_id")


@query("q07_latest_attempt", "SELECT execution_id, call_id FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY called_at DESC, call_id DESC) AS r FROM {provider_call}) WHERE r = 1", "provider_call")
def q07(provider_call: DataFrame) -> DataFrame:
    return ranking.first_per_group(provider_call, ["execution_id"], [F.desc("called_at"), F.desc("call_id")]).select("execution_id", "call_id")


def _stage(c: str) -> str:
    return f"CASE {c} % 7 " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(q.STAGES)) + " END"


_BEFORE = [sum(w for _, w in q.STAGES[:i]) for i in range(len(q.STAGES))]
_DONE = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN {_BEFORE[i] + w}" for i, (_, w) in enumerate(q.STAGES)) + " END"
_OPEN = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN {min(_BEFORE[i] + min(max(w // 5, 1), 5), 99)}" for i, (_, w) in enumerate(q.STAGES)) + " END"


@query("q08_stage_progress", f"SELECT event_id, CASE WHEN event_type = 'click' THEN {_DONE} ELSE {_OPEN} END AS progress FROM {{events}}", "events")
def q08(events: DataFrame) -> DataFrame:
    state = F.when(F.col("event_type") == "click", "completed").otherwise("started")
    return events.select("event_id", q.stage_progress(F.expr(_stage("event_id")), state).alias("progress"))


@query("q09_stage_timeline", f"""SELECT user_id, stage, min(ts) FILTER (WHERE event_type = 'view') AS started_at, max(ts) FILTER (WHERE event_type <> 'view') AS finished_at,
  epoch_us(max(ts) FILTER (WHERE event_type <> 'view')) // 1000 - epoch_us(min(ts) FILTER (WHERE event_type = 'view')) // 1000 AS elapsed_ms FROM (SELECT *, {_stage('event_id')} AS stage FROM {{events}}) GROUP BY 1, 2""", "events")  # fmt: skip
def q09(events: DataFrame) -> DataFrame:
    rows = events.select("user_id", F.expr(_stage("event_id")).alias("stage"), F.col("ts").alias("at"), F.when(F.col("event_type") == "view", "started").otherwise("completed").alias("state"))
    return q.stage_timeline(rows, ["user_id", "stage"])


@query("q11_retention", "SELECT event_id FROM {events} WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY", "events")
def q11(events: DataFrame) -> DataFrame:
    return events.where(F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-31' - INTERVAL '14' DAY")).select("event_id")


@query("q12_cache_winner", "SELECT user_id, event_id AS winner, hits FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS hits, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM {events} WHERE ts >= TIMESTAMP '2024-01-29') WHERE r = 1", "events")
def q12(events: DataFrame) -> DataFrame:
    live = events.where("ts >= TIMESTAMP_NTZ '2024-01-29'")
    return live.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("winner"), F.count("*").alias("hits"))


@query("q13_audit_page", "SELECT event_id, ts, event_type FROM {events} WHERE event_type IN ('error', 'signup') AND (ts, event_id) < (TIMESTAMP '2024-01-20', 0) ORDER BY ts DESC, event_id DESC LIMIT 51", "events")
def q13(events: DataFrame) -> DataFrame:
    rows = events.where(F.col("event_type").isin("error", "signup")).select("event_id", "ts", "event_type")
    return ranking.keyset_page(rows, ["ts", "event_id"], ["2024-01-20 00:00:00", 0], 50)


@query("q14_backoff", "SELECT p_partkey, least(pow(2.0, least(p_size, 8)), 128)::INTEGER AS minutes FROM {part}", "part")
def q14(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", q.backoff_minutes(F.col("p_size")).alias("minutes"))


@query("q15_null_head_repair", """SELECT document_id, revision_id FROM (SELECT r.document_id, r.revision_id, row_number() OVER (PARTITION BY r.document_id ORDER BY revision_number DESC, revision_id) AS n FROM {revision} r
  JOIN {document} d ON d.document_id = r.document_id AND d.readable_revision_id IS NULL WHERE r.text_state = 'ready') WHERE n = 1""", "revision", "document")  # fmt: skip
def q15(revision: DataFrame, document: DataFrame) -> DataFrame:
    broken = document.where("readable_revision_id IS NULL")
    ready = revision.where("text_state = 'ready'").join(broken, "document_id", "left_semi")
    return ranking.first_per_group(ready, ["document_id"], [F.desc("revision_number"), F.col("revision_id")]).select("document_id", "revision_id")


@query("q16_orphans", "SELECT l.doc_id FROM {labels} l WHERE NOT EXISTS (SELECT 1 FROM {documents} d WHERE d.doc_id = l.doc_id + 500)", "labels", "documents")
def q16(labels: DataFrame, documents: DataFrame) -> DataFrame:
    return labels.withColumn("k", F.col("doc_id") + 500).join(documents.select(F.col("doc_id").alias("k")), "k", "left_anti").select("doc_id")


@query("q17_drift", "SELECT document_id FROM {document} WHERE readable_revision_id IS DISTINCT FROM active_revision_id", "document")
def q17(document: DataFrame) -> DataFrame:
    return document.where(~F.col("readable_revision_id").eqNullSafe(F.col("active_revision_id"))).select("document_id")


@query("q18_next_due", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM {events} WHERE ts >= TIMESTAMP '2024-01-10') WHERE r = 1", "events")
def q18(events: DataFrame) -> DataFrame:
    due = events.where("ts >= TIMESTAMP_NTZ '2024-01-10'")
    return due.groupBy("event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("t09_queue_reorder", """SELECT o_orderkey AS job_id, o_custkey AS library_id, o_orderkey + CASE WHEN o_orderkey = 17 THEN -1000000 ELSE 0 END AS queue_rank FROM {orders}""", "orders")
def t09(orders: DataFrame) -> DataFrame:
    return q.moved(orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("library_id"), F.col("o_orderkey").alias("queue_rank")), 17, "top")


@query("p25_readiness", """SELECT revision_id, CASE WHEN text_state <> 'ready' THEN 'unavailable' WHEN vector_state <> 'ready' AND graph_state <> 'ready' THEN 'readable' WHEN graph_state <> 'ready' THEN 'graph_sparse' WHEN vector_state <> 'ready' THEN 'vector_sparse' ELSE 'graph_ready' END AS readiness FROM {revision}""", "revision")
def p25(revision: DataFrame) -> DataFrame:
    bad = lambda c: F.col(c) != "ready"
    kind = (
        F.when(bad("text_state"), "unavailable").when(bad("vector_state") & bad("graph_state"), "readable").when(bad("graph_state"), "graph_sparse")
        .when(bad("vector_state"), "vector_sparse").otherwise("graph_ready")
    )
    return revision.select("revision_id", kind.alias("readiness"))
