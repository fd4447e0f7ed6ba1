"""Summaries of a table's columns as lines of text, read back, and what they say about a graph of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import column_profiles, value_shapes

#: How a summary begins, and its fields in their order: name, column, type. Fixed values.
PREFIX = "Table Summary"
FIELDS = [
    ("Sheet", "sheet", "string"), ("Table", "table", "string"), ("Column", "column_name", "string"), ("Value Kind", "value_kind", "string"), ("Value Shape", "shape", "string"),
    ("Aggregation Priority", "priority", "int"), ("Row Count", "row_count", "bigint"), ("Non-empty Count", "non_empty", "bigint"), ("Distinct Count", "distinct_count", "bigint"),
    ("Average", "mean_value", "double"), ("Min", "min_value", "double"), ("Max", "max_value", "double"), ("Most Frequent Count", "mode_count", "bigint"),
    ("Most Frequent Tie Count", "mode_ties", "bigint"), ("Most Frequent Values", "modes", "string"),
]
_NUMERIC, _CATEGORICAL = {"mean_value", "min_value", "max_value"}, {"mode_count", "mode_ties", "modes"}


def summaries(df: DataFrame, columns: Sequence[str], sheet: str | None = None, table: str | None = None) -> DataFrame:
    """A summary per column, as columns of ``FIELDS``; the most frequent values are joined by ``; ``.

    Tables of fewer than two rows and columns without values have none.
    """
    profile = column_profiles(df, columns).where("non_empty > 0")
    shapes = value_shapes(df, columns).select("column_name", "shape")
    counted = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns])).alias("c")).select("c.*")
    counted = counted.where("value <> ''").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    ties = counted.groupBy("column_name", "n").agg(F.count("*").alias("k")).groupBy("column_name").agg(F.max(F.struct("n", "k")).alias("t")).select("column_name", F.col("t.k").alias("mode_ties"))
    both = profile.join(shapes, "column_name").join(ties, "column_name")
    numeric, shape, mode = F.col("value_kind") == "numeric", F.col("shape"), F.col("mode_count") > 1
    priority = (
        F.when(numeric, 3).when(shape.isin("url", "identifier"), 0).when(shape == "narrative", (mode & (F.col("distinct_count") < F.col("non_empty"))).cast("int"))
        .when(mode, 3).when(F.col("distinct_count") == F.col("non_empty"), 2).otherwise(1)
    )
    filled = {"sheet": F.lit(sheet).cast("string"), "table": F.lit(table).cast("string"), "priority": priority, "modes": F.replace("modes", F.lit("|"), F.lit("; "))}
    return both.withColumns(filled).select(*[F.col(c).cast(t).alias(c) for _, c, t in FIELDS])


def render() -> Column:
    """The line of a summary from its columns: ``name: value`` of what is known, joined by bars.

    Numeric columns show their numbers, others their most frequent values (if one comes twice or all are few).
    """
    numeric = F.col("value_kind") == "numeric"

    def field(name: str, column: str, kind: str) -> Column:
        value = F.regexp_replace(F.format_string("%.6f", F.col(column)), r"\.?0+$", "") if kind == "double" else F.col(column).cast("string")
        shown = F.concat(F.lit(f"{name}: "), value)
        if column in _NUMERIC:
            return F.when(numeric, shown)
        if column == "modes":
            few = (F.col("mode_count") > 1) | (F.col("mode_ties") <= 5)
            return F.when(~numeric & few & (F.col(column) != ""), shown)
        return F.when(~numeric, shown) if column in _CATEGORICAL else shown

    return F.concat_ws(" | ", F.lit(PREFIX), *[field(*f) for f in FIELDS])


def parse(text: Column) -> Column:
    """The summary of a line as a struct of ``FIELDS``; null for other texts and where a needed field is missing or malformed."""
    parts = F.transform(F.split(F.trim(text), r" \| "), lambda p: F.trim(p))
    value = lambda name: F.nullif(F.trim(F.substring(F.get(F.filter(parts, lambda p: F.startswith(p, F.lit(f"{name}: "))), F.lit(0)), len(name) + 3, 1 << 30)), F.lit(""))
    known = {c: value(n).try_cast(t) if t != "string" else value(n) for n, c, t in FIELDS}
    known["value_kind"] = F.when(known["value_kind"].isin("numeric", "categorical"), known["value_kind"])
    known["shape"] = F.when(known["shape"].isin("label", "identifier", "url", "narrative"), known["shape"]).otherwise("label")
    known["priority"] = F.coalesce(known["priority"], F.lit(0))
    for c in ("mode_count", "mode_ties"):
        known[c] = F.coalesce(known[c], F.lit(0).cast("bigint"))
    needed = [known[c].isNotNull() for c in ("column_name", "value_kind", "row_count", "non_empty", "distinct_count")]
    sound = F.startswith(F.ltrim(text), F.lit(PREFIX))
    for n in needed:
        sound = sound & n
    return F.when(sound, F.struct(*[v.alias(c) for c, v in known.items()]))


def graph_key(name: Column) -> Column:
    """A column's name in lower case, other characters than letters and digits as single blanks."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def graph_roles(found: DataFrame) -> DataFrame:
    """``(key, subject, attribute)`` of summaries: which columns name a row, and which describe it.

    A subject is a column of labels, filled in four of five rows and different in four of five of these.  An attribute is not numeric, no
    identifier and no address, filled in half of the rows and with a value that comes twice.
    """
    part = lambda a, b, n, d: (F.col(b) > 0) & (F.col(a) * d >= F.col(b) * n)
    words = F.col("value_kind") != "numeric"
    subject = words & (F.col("shape") == "label") & part("non_empty", "row_count", 4, 5) & part("distinct_count", "non_empty", 4, 5)
    attribute = words & ~F.col("shape").isin("identifier", "url") & part("non_empty", "row_count", 1, 2) & (F.col("mode_count") > 1)
    return found.select(graph_key(F.col("column_name")).alias("key"), subject.alias("subject"), attribute.alias("attribute")).where("key <> ''")


def graph_row(text: Column, roles: Column) -> Column:
    """A row's text (``Row n | name: value``) as its subject first and then its attributes; null if nothing is left.

    ``roles``: an array of (key, subject, attribute).  Values of numbers alone and columns without a name are left out.
    """
    parts = F.filter(F.transform(F.split(text, r" \| "), lambda p: F.trim(p)), lambda p: p != "")
    named = F.transform(parts, lambda p: F.contains(p, F.lit(": ")))
    start = F.coalesce(F.array_position(named, False), F.lit(0)).cast("int")
    data = F.filter(F.slice(parts, start + 1, F.greatest(F.size(parts) - start, F.lit(0))), lambda p: F.contains(p, F.lit(": ")))
    pairs = F.transform(data, lambda p: F.struct(graph_key(F.substring_index(p, ": ", 1)).alias("key"), F.trim(F.substring(p, F.call_function("instr", p, F.lit(": ")) + 2, F.length(p))).alias("value"), p.alias("shown")))
    pairs = F.filter(pairs, lambda x: x["value"] != "")
    has = lambda x, role: F.exists(roles, lambda r: (r["key"] == x["key"]) & r[role])
    subject = F.slice(F.transform(F.filter(pairs, lambda x: has(x, "subject")), lambda x: x["shown"]), 1, 1)
    told = F.filter(pairs, lambda x: ~x["key"].rlike("^col [0-9]+$") & ~x["value"].rlike("^[0-9.,+/:% -]+$") & has(x, "attribute"))
    rest = F.filter(F.transform(told, lambda x: x["shown"]), lambda p: ~F.array_contains(subject, p))
    return F.nullif(F.array_join(F.concat(subject, rest), " | "), F.lit(""))
