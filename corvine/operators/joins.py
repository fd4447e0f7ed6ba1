"""Joins that Spark has no single call for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import near_token
from .ranking import first_per_group, global_position


def request_list(df: DataFrame, key: str, wanted: Sequence) -> DataFrame:
    """Rows of a requested list of keys, once per request, with its ``place``."""
    asked = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(wanted)], f"place int, `{key}` {df.schema[key].dataType.simpleString()}")
    return F.broadcast(asked).join(df, key)


def contains_any(df: DataFrame, text: Column, terms: Sequence[str]) -> DataFrame:
    """One row per row and term that its text contains; the terms are part of the plan."""
    found = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))
    return df.withColumn("term", F.explode(found))


def within_ranges(df: DataFrame, ranges: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows whose value lies in one of their key's ranges (``low`` to ``high``, closed)."""
    wanted = ranges.select(*[F.col(k).alias(f"_{k}") for k in keys], "low", "high")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return df.join(wanted, same & F.col(value).between(F.col("low"), F.col("high")), "left_semi")


def always_one_row(df: DataFrame, anchor: dict) -> DataFrame:
    """``df`` with the anchor's values; the anchor alone where ``df`` is empty."""
    one = df.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in anchor.items()])
    return one.join(df, F.lit(True), "left")


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two nodes exist, with their labels and types."""
    side = lambda s: nodes.select(F.col("node_id").alias(f"{s}_node_id"), F.col("label").alias(f"{s}_label"), F.col("node_type").alias(f"{s}_type"))
    return edges.join(side("from"), "from_node_id").join(side("to"), "to_node_id")


def any_of_keys(left: DataFrame, keys: Sequence[Column], right: DataFrame, right_key: str) -> DataFrame:
    """Join where any of the keys matches: equal joins on all of a row's distinct keys.

    An OR of equalities would compare all pairs; a row whose keys repeat matches once.
    """
    return left.withColumn("_key", F.explode(F.array_distinct(F.array(*keys)))).join(right, F.col("_key") == right[right_key]).drop("_key")


def near_tokens(words: DataFrame, column: str) -> DataFrame:
    """Pairs of near tokens (see ``filters.near_token``), a < b.

    They share their first character and lengths that differ by one at most; each word goes to
    its own length and the next one, so pairs meet by equality.
    """
    w = F.col(column)
    long = words.where(F.length(w) >= 5).select(w.alias("w"), F.substring(w, 1, 1).alias("c"), F.length(w).alias("n"))
    left = long.select(F.col("w").alias("a"), "c", "n")
    right = long.select(F.col("w").alias("b"), "c", F.explode(F.array(F.col("n") - 1, F.col("n"), F.col("n") + 1)).alias("n"))
    return left.join(right, ["c", "n"]).where((F.col("a") < F.col("b")) & near_token(F.col("a"), F.col("b"))).select("a", "b")


def price_as_of(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """The price in force for each call; calls without one go missing.

    A price is in force from ``effective_from`` to before ``effective_to``; one of a token tier
    needs as many tokens, and calls of unknown size have only untiered prices.  Of several,
    the workspace's comes before the system's, a tier before none, then the higher tier,
    the later start and the smaller id.
    """
    p = prices.select(*[F.col(c).alias(f"p_{c}") for c in prices.columns])
    fits = (
        (F.col("p_provider_id") == F.col("provider_id"))
        & (F.col("p_effective_from") <= F.col("called_at"))
        & (F.col("p_effective_to").isNull() | (F.col("p_effective_to") > F.col("called_at")))
        & (F.col("p_tokens_from").isNull() | (F.col("input_tokens") >= F.col("p_tokens_from")))
    )
    order = [
        F.desc(F.col("p_scope") == "workspace"), F.desc(F.col("p_tokens_from").isNotNull()), F.desc("p_tokens_from"), F.desc("p_effective_from"), F.col("p_price_id"),
    ]
    best = first_per_group(calls.join(p, fits), ["call_id"], order)
    return best.select(*calls.columns, F.col("p_price_id").alias("price_id"), F.col("p_scope").alias("price_scope"), F.col("p_cents_per_1000").alias("cents_per_1000"))


def charges(calls: DataFrame, prices: DataFrame, tokens: str = "input_tokens") -> DataFrame:
    """Every call with the ``price_id`` in force and its ``charge``: the unit price times the tokens, by the million.

    A call without a price keeps its usage and has neither.
    """
    priced = price_as_of(calls, prices).select("call_id", "price_id", "cents_per_1000")
    charge = (F.col("cents_per_1000").cast("decimal(18,6)") * F.col(tokens) / 1_000_000).cast("decimal(30,6)")
    return calls.join(priced, "call_id", "left").withColumn("charge", charge).drop("cents_per_1000")


def overflow(conversations: DataFrame, executions: DataFrame, replays: DataFrame, most: int, before: Column, bucket: Column) -> DataFrame:
    """Conversations that go so that ``most`` stay: the oldest of those that may.

    ``conversations``: (id, created_at); ``executions``: (id, completed_at; null: it runs); ``replays``: (source_id, id).  One may go if all its executions have
    ended, or without any if it was made ``before``; not if another conversation replays one of its.  ``bucket`` splits the order of creation into ranges.
    """
    state = executions.groupBy("id").agg(F.bool_or(F.col("completed_at").isNull()).alias("_runs"))
    elsewhere = replays.where(F.col("source_id") != F.col("id")).select(F.col("source_id").alias("id")).distinct()
    free = conversations.join(state, "id", "left").where(F.coalesce(~F.col("_runs"), F.col("created_at") < before)).join(elsewhere, "id", "left_anti")
    extra = conversations.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("_extra"))
    aged = global_position(free.drop("_runs"), [F.col("created_at"), F.col("id")], bucket, "age")
    return aged.join(F.broadcast(extra)).where("age <= _extra").drop("_extra")


def inherit(keys: Sequence[str], scopes: dict[str, DataFrame]) -> DataFrame:
    """Of each key the row of the nearest scope; ``scopes`` go from near to far."""
    rows = None
    for i, (name, df) in enumerate(scopes.items()):
        part = df.withColumns({"source_scope": F.lit(name), "precedence": F.lit(i)})
        rows = part if rows is None else rows.unionByName(part)
    return first_per_group(rows, list(keys), [F.col("precedence")]).drop("precedence")
