"""Queries of sinks: upserts, manifests, lines of JSON, and a stream of increments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources import snapshot
from ..streaming import ingest


@query("k03_upsert", """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'changed' ELSE c_mktsegment END AS segment FROM {customer} UNION ALL SELECT 90000000 + n_nationkey, 'new' FROM {nation}""", "customer", "nation")
def k03(customer: DataFrame, nation: DataFrame) -> DataFrame:
    now = customer.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    changes = now.where("c_custkey % 10 = 0").select("c_custkey", F.lit("changed").alias("segment"), F.lit(2).alias("n"))
    older = changes.select("c_custkey", F.lit("older").alias("segment"), F.lit(1).alias("n"))
    added = nation.select((90_000_000 + F.col("n_nationkey")).alias("c_custkey"), F.lit("new").alias("segment"), F.lit(1).alias("n"))
    rows = changes.unionByName(older).unionByName(added)
    return snapshot.upsert(now.withColumn("n", F.lit(0)), rows, ["c_custkey"], [F.desc("n")]).select("c_custkey", "segment")


@query("k06_vector_manifest", "SELECT len(embedding) AS dimensions, label, count(*) AS row_count FROM {embeddings} GROUP BY 1, 2", "embeddings")
def k06(embeddings: DataFrame) -> DataFrame:
    return embeddings.groupBy(F.size("embedding").alias("dimensions"), "label").agg(F.count("*").alias("row_count"))


@query("k08_ndjson_topology", """SELECT '{"from_node_id":"' || from_node_id || '","to_node_id":"' || to_node_id || '","relation_type":"' || relation_type || '"}' AS value FROM {edge}""", "edge")
def k08(edge: DataFrame) -> DataFrame:
    return snapshot.ndjson(edge.select("from_node_id", "to_node_id", "relation_type"))


@query("st01_stream_counts", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY event_type")
def st01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream, folded increment by increment into a rollup."""
    done = ingest.rollup_stream(spark, f"{sf_dir}/events.parquet")
    return done.select("event_type", "n", F.round("total", 4).alias("total"))
