"""Queue, leases, stages and retention as selections over state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stages in their order with their share of a run. Fixed values.
STAGES = [("extract_content", 20), ("prepare_structure", 10), ("chunk_content", 10), ("extract_technical_facts", 10), ("embed_chunk", 20), ("extract_graph", 25), ("finalizing", 5)]


def claimable(jobs: DataFrame, total: int, per_workspace: int, per_library: int) -> DataFrame:
    """The queued job that may be claimed next; none while no slot is free.

    Leased jobs count against caps overall, per workspace and per library.  Priority (low first), the
    library's running jobs, age and id decide; claiming is the caller's update, one job at a time.
    """
    leased = jobs.where("queue_state = 'leased'")
    by_workspace = leased.groupBy("workspace_id").agg(F.count("*").alias("_w"))
    by_library = leased.groupBy("library_id").agg(F.count("*").alias("_l"))
    free = leased.agg((F.lit(total) - F.count("*")).alias("_free"))
    waiting = jobs.where("queue_state = 'queued'").join(by_workspace, "workspace_id", "left").join(by_library, "library_id", "left").join(F.broadcast(free))
    open_ = waiting.na.fill(0, ["_w", "_l"]).where((F.col("_free") > 0) & (F.col("_w") < per_workspace) & (F.col("_l") < per_library))
    return open_.orderBy("priority", "_l", "queued_at", "job_id").limit(1).select("job_id", "workspace_id")


def stale_leases(jobs: DataFrame, now: Column, timeout_s: int) -> DataFrame:
    """Leased jobs whose last sign of life is older than the timeout."""
    return jobs.where((F.col("queue_state") == "leased") & (F.unix_timestamp(now) - F.unix_timestamp(F.col("queued_at").cast("timestamp")) > timeout_s))


def stage_progress(stage: Column, state: Column) -> Column:
    """Share of a run that is done: what came before, and the stage's part by its state."""
    before, out = 0, F.lit(None).cast("int")
    for name, weight in STAGES:
        part = min(max(weight // 5, 1), 5)
        out = F.when(stage == name, F.when(state == "completed", before + weight).otherwise(min(before + part, 99))).otherwise(out)
        before += weight
    return out


def stage_timeline(events: DataFrame, keys: list[str]) -> DataFrame:
    """First start and last finish of every stage, and the milliseconds between."""
    start, end = F.min(F.when(F.col("state") == "started", F.col("at"))), F.max(F.when(F.col("state") != "started", F.col("at")))
    millis = lambda c: F.unix_millis(c.cast("timestamp"))
    return events.groupBy(*keys).agg(start.alias("started_at"), end.alias("finished_at")).withColumn("elapsed_ms", millis(F.col("finished_at")) - millis(F.col("started_at")))


def backoff_minutes(attempt: Column) -> Column:
    """Minutes until the next attempt: doubling, 128 at most."""
    return F.least(F.pow(F.lit(2.0), F.least(attempt, F.lit(8))), F.lit(128.0)).cast("int")


def moved(ranks: DataFrame, job_id: int, to: str) -> DataFrame:
    """New queue ranks after one job goes to the top or bottom, or trades places with a neighbour."""
    w = Window.partitionBy("library_id").orderBy("queue_rank", "job_id")
    near = ranks.withColumns({"_before": F.lag("job_id").over(w), "_after": F.lead("job_id").over(w), "_rb": F.lag("queue_rank").over(w), "_ra": F.lead("queue_rank").over(w)})
    rank, me = F.col("queue_rank"), F.col("job_id") == job_id
    if to in ("top", "bottom"):
        shift = -1_000_000 if to == "top" else 1_000_000
        new = F.when(me, rank + shift).otherwise(rank)
    else:
        mine, other = ("_rb", "_after") if to == "up" else ("_ra", "_before")
        theirs = "_ra" if to == "up" else "_rb"
        new = F.when(me, F.coalesce(F.col(mine), rank)).when(F.col(other) == job_id, F.col(theirs)).otherwise(rank)
    return near.select("job_id", "library_id", new.alias("queue_rank"))
