"""Incremental ingest by Structured Streaming.

Increments are rolled up per batch and upserted into a versioned table by ``foreachBatch``;
the batch id makes a repeated batch harmless.  Sessions of leases time out by event time.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import snapshot


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(known or tempfile.mkdtemp(prefix='corvine-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def rollup_stream(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` per ``event_type`` of a growing Parquet folder or file.

    Processes what is there and stops (``availableNow``); called again with the same
    ``folder`` it goes on from where it stopped.
    """
    folder = folder or _folder(spark)
    table = f"{folder}/rollup"
    schema = spark.read.parquet(path).schema
    # a stream reads folders; a single file is named by a pattern
    source = spark.readStream.schema(schema).parquet(path + ("" if not path.endswith(".parquet") else "*"))

    def fold(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        new.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    source.writeStream.foreachBatch(fold).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.schema("event_type string, n bigint, total double").parquet(f"{table}/batch=*")
    done = parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    snapshot.publish(done, f"{folder}/published")
    return snapshot.current(spark, f"{folder}/published")


def lease_sessions(stream: DataFrame, timeout: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of signs of life per job: a gap longer than the timeout ends a lease."""
    w = F.session_window("heartbeat_at", timeout)
    return stream.withWatermark("heartbeat_at", late).groupBy("job_id", w.alias("lease")).agg(F.count("*").alias("beats"))
