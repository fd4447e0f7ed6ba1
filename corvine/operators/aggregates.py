"""Rollups, fingerprints, profiles and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rows_fingerprint(df: DataFrame, group: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """MD5 over the MD5s of a group's rows in order, joined by the record separator.

    Rows of a group meet in one array of digests: meant for groups of the size of a document.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = df.select(*group, F.struct(*order, F.md5(text).alias("h")).alias("r"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["h"]), "\x1e")
    return rows.groupBy(*group).agg(F.md5(joined).alias("fingerprint"))


def single_currency(df: DataFrame, group: Sequence[str], amount: Column, call: str) -> DataFrame:
    """Total and number of calls per group; ``mixed`` marks groups of several currencies, which have no total."""
    rolled = df.groupBy(*group).agg(
        F.count_distinct("currency_code").alias("_n"), F.sum(amount).alias("_sum"), F.count_distinct(call).alias("calls"), F.max("currency_code").alias("_code")
    )
    return rolled.select(
        *group, "calls", (F.col("_n") > 1).alias("mixed"), F.when(F.col("_n") <= 1, F.col("_sum")).alias("total"),
        F.when(F.col("_n") <= 1, F.coalesce("_code", F.lit("USD"))).alias("currency_code"),
    )


def column_profiles(df: DataFrame, columns: Sequence[str], modes: int = 5) -> DataFrame:
    """A profile per column of text: counts, numeric statistics, most frequent values.

    Numeric if at least two values and at least 80 % of the non-empty ones parse.  ``modes``
    are the values of the greatest count, in order, ``mode_count`` that count.  Columns are
    unpivoted once; values are counted per column and value first, so no column is one task.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns])).alias("c")).select("c.*")
    counted = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    number = F.expr("try_cast(replace(replace(value, ' ', ''), ',', '.') AS double)")
    filled = (F.col("value") != "") & F.col("value").isNotNull()
    counted = counted.withColumns({"filled": F.coalesce(filled, F.lit(False)), "number": number})
    stats = counted.groupBy("column_name").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("filled"), F.col("n"))), F.lit(0)).alias("non_empty"),
        F.count_if("filled").alias("distinct_count"),
        F.coalesce(F.sum(F.when(F.col("filled") & F.col("number").isNotNull(), F.col("n"))), F.lit(0)).alias("numeric_count"),
        F.min(F.when(F.col("filled"), F.col("number"))).alias("min_value"),
        F.max(F.when(F.col("filled"), F.col("number"))).alias("max_value"),
        (F.sum(F.when(F.col("filled"), F.col("number") * F.col("n"))) / F.sum(F.when(F.col("filled") & F.col("number").isNotNull(), F.col("n")))).alias("mean_value"),
        F.max(F.when(F.col("filled"), F.col("n"))).alias("mode_count"),
    )
    numeric = (F.col("numeric_count") >= 2) & (F.col("numeric_count") >= 0.8 * F.col("non_empty"))
    top = counted.where("filled").withColumn("_r", F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))).where(F.col("_r") <= modes)
    best = top.join(stats.select("column_name", "mode_count"), "column_name").where("n = mode_count")
    listed = best.groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("modes"))
    only = lambda c: F.when(numeric, F.col(c)).alias(c)
    return stats.join(listed, "column_name", "left").where("row_count >= 2").select(
        "column_name", "row_count", "non_empty", "distinct_count", F.when(numeric, "numeric").otherwise("categorical").alias("value_kind"),
        only("min_value"), only("max_value"), only("mean_value"), "mode_count", F.array_join("modes", "|").alias("modes"),
    )


def value_shapes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shape of each column's values: url, identifier, narrative or label, and its priority for summaries."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns])).alias("c")).select("c.*")
    value = F.col("value")
    share = lambda p: F.avg(F.when(p, 1.0).otherwise(0.0))
    words = F.size(F.split(value, r"\s+"))
    rates = long.where("value <> ''").groupBy("column_name").agg(
        share(value.rlike("^https?://")).alias("url"), share((words == 1) & value.rlike("[0-9]")).alias("identifier"), share((words >= 6) | (F.length(value) >= 48)).alias("narrative")
    )
    shape = F.when(F.col("url") >= 0.5, "url").when(F.col("identifier") >= 0.6, "identifier").when(F.col("narrative") >= 0.6, "narrative").otherwise("label")
    return rates.select("column_name", shape.alias("shape")).withColumn("priority", F.when(F.col("shape") == "label", 3).when(F.col("shape") == "identifier", 1).otherwise(0))


def rank_metrics(first_hits: DataFrame, rank: str = "rank") -> DataFrame:
    """hit@1, 3, 5, 10 and mean reciprocal rank; a case without a hit has a null rank."""
    r = F.col(rank)
    hits = [F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in (1, 3, 5, 10)]
    return first_hits.agg(*hits, F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"))


def nearest_rank(df: DataFrame, group: Sequence[str], value: str, percents: Sequence[int]) -> DataFrame:
    """Nearest-rank percentiles: values that occur, no interpolation."""
    return df.groupBy(*group).agg(*[F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})").alias(f"p{p}") for p in percents])


def coverage(facts: Column, blocks: Column) -> Column:
    """Facts per block, between 0 and 1; 0 without blocks, null where the facts aren't known."""
    share = F.least(F.greatest(facts.cast("double") / F.nullif(blocks, F.lit(0)), F.lit(0.0)), F.lit(1.0))
    return F.when(facts.isNotNull(), F.coalesce(share, F.lit(0.0)))
