"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Hang neighbours on the least one.

    ``larger``: every node's larger neighbours go to the least of it and its neighbours;
    otherwise the node itself and its smaller neighbours do.  ``links`` holds (a, b), a > b.
    """
    if larger:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return moved.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Label of every linked node: ``(node, component)``, the least node reachable.

    ``links`` has two columns of node ids; order, repetition and self-links don't matter.
    Rounds of two star operations halve paths, so their number grows with the logarithm of
    the longest one.  Minima are combined before each shuffle; a hub's links meet only in
    joins that Spark splits.  Each round is written to shared storage: nothing of the
    links comes to the driver but two sums, which tell when nothing moves any more.
    """
    a, b = links.columns
    now = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    now, before = materialize(now, "links"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state
        now = materialize(_star(_star(now, True), False), "links")


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links behind ``known`` and of more ``links`` (a, b): only parts that these join are contracted anew."""
    part = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"p{c}"))
    ends = links.join(part("a"), "a", "left").join(part("b"), "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
    found = materialize(components(ends), "merged")
    moved = known.join(found.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return moved.unionByName(found.join(known, "node", "left_anti").select("node", "component"))
