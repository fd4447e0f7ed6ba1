"""Technical facts: typed literals found in text, normalised, aggregated and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds, the expressions that find them (group 1 is the value), and confidence. Fixed values.
PATTERNS = [
    ("url", r"(https?://[^\s<>\"')\]]+)", 0.95),
    ("endpoint_path", r"(?:^|\s)((?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+/[^\s,;]*)", 0.9),
    ("port", r"(?i)(?:port|puerto)[ :=]+([0-9]{2,5})\b", 0.8),
    ("status_code", r"(?i)(?:status|http|response)[ :=]+([1-5][0-9]{2})\b", 0.8),
    ("environment_variable", r"(?:^|[\s$({])([A-Z][A-Z0-9]*_[A-Z0-9_]+)\b", 0.8),
    ("version_number", r"(?:^|[\s(v])([0-9]+\.[0-9]+(?:\.[0-9]+)?)(?:$|[\s),;])", 0.7),
    ("configuration_key", r"(?:^|\s)([a-z][a-z0-9_.-]{2,40}) ?= ?\S", 0.7),
    ("error_code", r"\b(E[A-Z]*[0-9]{3,5})\b", 0.7),
    ("code_identifier", r"`([A-Za-z_][A-Za-z0-9_.]*)`", 0.9),
    ("identifier", r"\b([A-Z]{4}[A-Z0-9]{16})\b", 0.6),
]
METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]


def normal_value(kind: Column, value: Column) -> Column:
    """The value in its kind's normal form; null for a value that its kind doesn't allow."""
    bare = F.regexp_replace(F.trim(value), r"[.,;:)\]]+$", "")
    number = bare.try_cast("int")
    return (
        F.when(kind == "url", F.regexp_replace(bare, r"#.*$", ""))
        .when(kind == "endpoint_path", F.regexp_replace(bare, r"^[A-Z]+\s+", ""))
        .when(kind == "http_method", F.when(F.upper(bare).isin(METHODS), F.upper(bare)))
        .when(kind == "port", F.when(number.between(1, 65535), number.cast("string")))
        .when(kind == "status_code", F.when(number.between(100, 599), number.cast("string")))
        .when(kind.isin("environment_variable", "error_code"), F.upper(bare))
        .when(kind == "configuration_key", F.lower(bare))
        .otherwise(bare)
    )


def extract(lines: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, kind, display value, canonical value and confidence of every literal in every line."""
    found = F.flatten(F.array(*[_matches(text, *p) for p in PATTERNS]))
    rows = lines.select(*keys, F.explode(found).alias("f")).select(*keys, "f.*")
    return rows.withColumn("canonical_value", normal_value(F.col("fact_kind"), F.col("display_value"))).where("canonical_value IS NOT NULL AND canonical_value <> ''")


def _matches(text: str, kind: str, pattern: str, confidence: float) -> Column:
    fact = lambda v: F.struct(F.lit(kind).alias("fact_kind"), v.alias("display_value"), F.lit(confidence).alias("confidence"))
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), fact)


def aggregate(facts: DataFrame, scope: list[str], support: str) -> DataFrame:
    """One row per kind and value of a scope: distinct supports, best confidence, its display."""
    return facts.groupBy(*scope, "fact_kind", "canonical_value").agg(
        F.count_distinct(support).alias("supports"), F.max("confidence").alias("confidence"), F.max_by("display_value", F.struct("confidence", "display_value")).alias("display_value")
    )


def conflicts(facts: DataFrame, scope: list[str]) -> DataFrame:
    """Facts whose kind has more than one value in their scope, with that number."""
    keys = [*scope, "fact_kind"]
    several = facts.groupBy(*keys).agg(F.count_distinct("canonical_value").cast("int").alias("alternatives")).where("alternatives > 1")
    return facts.join(several, keys)


# ---- facts of a line, by its tokens

#: Methods that are scanned, protocols, and authorization schemes with the rule they stand for. Fixed values.
SCANNED_METHODS, PROTOCOLS = [*METHODS, "CONNECT"], ["http", "https", "tcp", "udp", "ws", "wss", "grpc", "soap"]
SCHEMES = {"bearer": "bearer_token", "basic": "basic_auth"}
_EDGE = r"^[,;:)(\]\[\"'`{}]+|[,;:)(\]\[\"'`{}]+$"


def technical_tokens(line: Column) -> Column:
    """Tokens between white space without quotes, brackets of all sorts and stops at their ends (a placeholder that ends a path loses its brace)."""
    return F.filter(F.transform(F.split(F.coalesce(line, F.lit("")), r"\s+"), lambda t: F.regexp_replace(t, _EDGE, "")), lambda t: t != "")


def _path(token: Column) -> Column:
    """A token that is a path, without its query; null for others."""
    bare = F.regexp_extract(token, r"^([^?#]*)", 1)
    return F.when((F.length(token) >= 2) & F.startswith(token, F.lit("/")) & bare.rlike(r"^[A-Za-z0-9/_.{}-]*$") & (bare != ""), bare)


def _port(url: Column) -> Column:
    """The port that an address names, from 1 to 65535; null without one."""
    authority = F.regexp_replace(F.regexp_extract(url, r"^[^:]+://([^/?#]*)", 1), r"^.*@", "")
    port = F.regexp_extract(authority, r"^(?:\[[^\]]*\]|[^\[\]:]*):([0-9]{1,9})$", 1).try_cast("int")
    return F.when(port.between(1, 65535), port.cast("string"))


def line_facts(lines: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, fact_kind, value and method of each technical fact of every line, each once.

    URLs; methods, and paths of tokens or URLs (with the line's method if it has just one); ports of URLs; status codes from 100 to 599 right behind an
    HTTP version; protocols by name or in a URL; and the rule of an authorization header.  Expressions over the line's tokens only.
    """
    tokens = technical_tokens(F.col(text))
    found = lines.select(*keys, F.col(text).alias("_line"), tokens.alias("_t"))
    found = found.withColumn("_urls", F.filter("_t", lambda t: t.rlike(r"(?i)^https?://[^/?#\s]+")))
    cells = F.when(F.contains("_line", F.lit("|")), F.filter(F.transform(F.split("_line", r"\|"), lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))), lambda c: c != "")).otherwise(F.array().cast("array<string>"))
    named = F.array_distinct(F.concat("_t", cells))
    upper = F.transform(named, lambda t: F.upper(F.regexp_replace(t, _EDGE, "")))
    methods = F.array_distinct(F.filter(upper, lambda t: t.isin(SCANNED_METHODS)))
    found = found.withColumn("_methods", methods)
    own = F.transform(F.transform(named, lambda t: F.regexp_replace(t, _EDGE, "")), _path)
    of_url = F.transform("_urls", lambda u: _path(F.regexp_extract(u, r"^[^:]+://[^/?#]*([^?#]*)", 1)))
    paths = F.array_compact(F.concat(own, F.filter(of_url, lambda p: p != "/")))
    status = F.filter(F.zip_with("_t", F.slice("_t", F.lit(2), F.greatest(F.size("_t") - 1, F.lit(0))), lambda a, b: F.when(a.rlike(r"^HTTP/[0-9]+(?:\.[0-9]+)?$") & b.rlike("^[1-5][0-9]{2}$"), b)), lambda x: x.isNotNull())
    schemes = F.transform("_urls", lambda u: F.regexp_extract(u, r"^([A-Za-z]+)://", 1))
    protocols = F.filter(F.concat(schemes, F.transform("_t", lambda t: F.lower(t))), lambda t: t.isin(PROTOCOLS))
    rule = F.element_at(F.create_map(*[F.lit(x) for kv in SCHEMES.items() for x in kv]), F.lower(F.regexp_extract("_line", r"(?i)^\s*authorization\s*:\s*([^\s]+)", 1)))
    one = F.when(F.size("_methods") == 1, F.get("_methods", F.lit(0)))
    kinds = {
        "url": F.col("_urls"), "http_method": F.col("_methods"), "endpoint_path": paths, "port": F.array_compact(F.transform("_urls", _port)), "status_code": status,
        "protocol": protocols, "auth_rule": F.array_compact(F.array(rule)),
    }
    rows = [F.transform(F.array_distinct(v), _fact(k, one if k == "endpoint_path" else F.lit(None).cast("string"))) for k, v in kinds.items()]
    return found.select(*keys, F.explode(F.concat(*rows)).alias("f")).select(*keys, "f.*")


def _fact(kind: str, method: Column):
    return lambda v: F.struct(F.lit(kind).alias("fact_kind"), v.alias("value"), method.alias("method"))
