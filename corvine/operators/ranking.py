"""Top rows, latest rows, pages and slices: everything decided by a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int | Column, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group; ``n`` may be a column (a quota per row).

    The order must be total, or rows that tie may change places from run to run.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per group: the first in the order (``DISTINCT ON``)."""
    return top_per_group(df, group, order, 1)


def keyset_page(df: DataFrame, keys: Sequence[str], after: Sequence | None, size: int) -> DataFrame:
    """A page in descending key order and one row more, which tells whether another follows."""
    if after is not None:
        df = df.where(F.struct(*keys) < F.struct(*[F.lit(v).cast(df.schema[k].dataType) for k, v in zip(keys, after, strict=True)]))
    return df.orderBy(*[F.desc(k) for k in keys]).limit(size + 1)


def tail_slice(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows, in ascending order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def append_distinct(first: DataFrame, second: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Rows of ``first`` and then those of ``second`` with new keys; both have a ``place``."""
    both = first.withColumn("pass", F.lit(0)).unionByName(second.withColumn("pass", F.lit(1)))
    once = first_per_group(both, [key], [F.col("pass"), F.col("place")])
    return once.orderBy("pass", "place", key).limit(limit) if limit else once


def global_position(df: DataFrame, order: Sequence[Column], bucket: Column, name: str = "position") -> DataFrame:
    """Position of every row in a total order, without sorting all rows in one task.

    ``bucket`` splits the order into ranges: a smaller bucket comes wholly first.  Rows are
    numbered within buckets; only bucket sizes are added up in order.
    """
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = df.withColumn(name, F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    return within.join(before, "_bucket").withColumn(name, (F.col(name) + F.col("_before")).cast("bigint")).drop("_bucket", "_before")
