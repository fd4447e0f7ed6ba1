"""Exact duplicates with heavy hitters split off.

Each task finds digests that may be frequent (Misra-Gries counters, bounded); the tasks'
counters are added up and the largest estimates kept, again bounded.  An exact count of just these
digests, combined before its shuffle, verifies them and finds the row that stays of each; those
results are broadcast, and their copies are resolved where they lie.  Only the other
digests, none of which is frequent, are shuffled.  The answer is the same whichever digests
are taken for frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, map_rows, materialize

#: Counters of a task, and digests whose results are broadcast (some 80 bytes each).
COUNTERS, FREQUENT = 256, 256
#: A digest counts as frequent from this exact count on: below, an ordinary group is as cheap.
LEAST = 100


def misra_gries(values: Iterator[bytes], counters: int) -> dict[bytes, int]:
    """Counters of values; any value in over 1/(counters + 1) of the rows has one."""
    kept: dict[bytes, int] = {}
    for x in values:
        if x in kept:
            kept[x] += 1
        elif len(kept) < counters:
            kept[x] = 1
        else:
            kept = {k: n - 1 for k, n in kept.items() if n > 1}
    return kept


def frequent(digests: DataFrame, id_col: str) -> DataFrame:
    """``(digest, keep_id, group_size)`` of up to ``FREQUENT`` digests, exact, bounded."""

    def counters(rows: Iterator[tuple]) -> Iterator[tuple]:
        yield from misra_gries((digest for (digest,) in rows), COUNTERS).items()

    likely = (
        map_rows(digests.select("digest"), counters, "digest binary, n bigint")
        .groupBy("digest")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "digest")
        .limit(FREQUENT)
        .select("digest")
    )
    verified = digests.join(F.broadcast(likely), "digest").groupBy("digest")
    return verified.agg(F.max(id_col).alias("keep_id"), F.count("*").alias("group_size")).where(F.col("group_size") >= LEAST)


def exact_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` for every row of ``df``.

    Texts are equal when they are identical after lower-casing A-Z; equality is that of their
    SHA-256 digests.  Null texts count as empty.  Of equal texts the row with the largest id
    stays; null ids lose to any other, and among rows with the same largest id all are
    marked kept.  Result columns are fixed, so other columns of ``df`` don't matter.
    """
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    digests = materialize(df.select(id_col, F.unhex(F.sha2(text, 256)).alias("digest")), "digests")
    known = materialize(frequent(digests, id_col), "frequent")
    hot = digests.join(F.broadcast(known), "digest")
    group = Window.partitionBy("digest")
    rest = digests.join(F.broadcast(known.select("digest")), "digest", "left_anti").select(
        "*", F.max(id_col).over(group).alias("keep_id"), F.count("*").over(group).alias("group_size")
    )
    both = hot.select(id_col, "digest", "keep_id", "group_size").unionByName(rest.select(id_col, "digest", "keep_id", "group_size"))
    return both.select(
        id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE = """
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM (
  SELECT doc_id, text_sha256,
         max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents
  )
)
"""
