"""A crawl over a known link table: waves of a frontier with limits and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut
from .ranking import global_position


def waves(links: DataFrame, seeds: DataFrame, depth: int, budget: int) -> DataFrame:
    """``(url, depth)`` of pages reached breadth first, at most ``budget`` in order of depth and URL.

    ``links``: (source, target); ``seeds``: (url).  Each wave joins the frontier with the links once.
    """
    seen = cut(seeds.distinct().withColumn("depth", F.lit(0)))
    edges = cut(links.where("source <> target").distinct())
    for d in range(1, depth + 1):
        front = seen.where(F.col("depth") == d - 1).select(F.col("url").alias("source"))
        new = edges.join(front, "source", "left_semi").select(F.col("target").alias("url")).distinct().join(seen, "url", "left_anti")
        seen = cut(seen.unionByName(new.withColumn("depth", F.lit(d))))
    placed = global_position(seen, [F.col("depth"), F.col("url")], F.struct("depth", F.substring("url", 1, 12)))
    return placed.where(F.col("position") <= budget).select("url", "depth")


def decision(depth: Column, relation: Column, filtered: Column, most_depth: int, boundary: str) -> Column:
    """Why a link is taken or not: depth, then boundary, then URL filter."""
    outside = (relation != "same") if boundary == "same_host" else (relation == "external")
    return F.when(depth > most_depth, "exceeded_depth").when(outside, "outside_boundary").when(filtered != "allowed", "url_filtered").otherwise("queued")


def terminal_state(done: Column, failed: Column, blocked: Column, excluded: Column, canceled: Column) -> Column:
    """State of a finished run from its counts."""
    other = (failed + blocked + excluded + canceled) > 0
    return (
        F.when((done > 0) & other, "completed_partial").when((failed + blocked) > 0, "failed").when(excluded > 0, "completed_partial")
        .when(canceled > 0, "canceled").otherwise("completed")
    )
