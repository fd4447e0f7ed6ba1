"""Queries of technical facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import blocks, facts
from ..registry import query

_KEYS = r"""f AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|\s)([a-z][a-z0-9_.-]{2,40}) ?= ?\S', 1)) AS v FROM {documents})"""


def _facts(documents: DataFrame) -> DataFrame:
    return facts.extract(blocks.line_chunks(documents), ["doc_id", "chunk_index"], "content_text")


@query("f01_technical_facts", None, "documents")
def f01(documents: DataFrame) -> DataFrame:
    return _facts(documents)


@query(
    "f02_urls_in_pages",
    r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, 'https?://[^ <>")]+'))) AS n_urls FROM {pages}""",
    "pages",
)
def f02(pages: DataFrame) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('https?://[^ <>")]+'), F.lit(0))
    return pages.select("page_id", F.size(F.array_distinct(found)).alias("n_urls"))


@query("f07_query_parameters", r"SELECT page_id, unnest(list_distinct(regexp_extract_all(url, '[?&]([A-Za-z0-9_]+)=', 1))) AS parameter FROM {pages}", "pages")
def f07(pages: DataFrame) -> DataFrame:
    names = F.array_distinct(F.regexp_extract_all("url", F.lit(r"[?&]([A-Za-z0-9_]+)="), F.lit(1)))
    return pages.select("page_id", F.explode(names).alias("parameter"))


@query("f09_configuration_keys", f"WITH {_KEYS} SELECT doc_id, lower(v) AS canonical_value, count(*) AS n FROM f GROUP BY 1, 2", "documents")
def f09(documents: DataFrame) -> DataFrame:
    found = facts.extract(documents, ["doc_id"], "text").where("fact_kind = 'configuration_key'")
    return found.groupBy("doc_id", "canonical_value").agg(F.count("*").alias("n"))


@query("f10_normal_values", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size * 3000 BETWEEN 1 AND 65535 THEN CAST(p_size * 3000 AS VARCHAR) END WHEN 1 THEN CASE WHEN p_size * 20 BETWEEN 100 AND 599 THEN CAST(p_size * 20 AS VARCHAR) END ELSE upper(p_type) END AS value FROM {part}""", "part")
def f10(part: DataFrame) -> DataFrame:
    i = F.col("p_partkey") % 3
    kind = F.when(i == 0, "port").when(i == 1, "status_code").otherwise("error_code")
    value = F.when(i == 0, (F.col("p_size") * 3000).cast("string")).when(i == 1, (F.col("p_size") * 20).cast("string")).otherwise(F.concat("p_type", F.lit(".")))
    return part.select("p_partkey", facts.normal_value(kind, value).alias("value"))


@query("f11_fact_aggregate", None, "documents")
def f11(documents: DataFrame) -> DataFrame:
    return facts.aggregate(_facts(documents), ["doc_id"], "chunk_index")


@query("f12_fact_conflicts", """SELECT p_brand, p_type, n AS alternatives FROM (SELECT p_brand, p_type, count(DISTINCT p_type) OVER (PARTITION BY p_brand) AS n FROM (SELECT DISTINCT p_brand, p_type FROM {part})) WHERE n > 1""", "part")
def f12(part: DataFrame) -> DataFrame:
    rows = part.select("p_brand", F.lit("type").alias("fact_kind"), F.col("p_type").alias("canonical_value")).distinct()
    return facts.conflicts(rows, ["p_brand"]).select("p_brand", F.col("canonical_value").alias("p_type"), "alternatives")


@query("f13_dotted_versions", r"""WITH v AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)+'))) AS term FROM {documents}),
   p AS (SELECT *, list_filter(list_transform(string_split(term, '.'), lambda x: TRY_CAST(x AS UBIGINT)), lambda x: x <= 4294967295) AS n FROM v)
   SELECT doc_id, term FROM p WHERE len(n) BETWEEN 2 AND 4 AND NOT (len(n) >= 3 AND n[1] BETWEEN 1 AND 31 AND n[2] BETWEEN 1 AND 12 AND n[3] >= 1900)""", "documents")  # fmt: skip
def f13(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.explode(fn.version_terms(F.col("text"))).alias("term"))


@query("f14_version_parts", "SELECT p_partkey, p_size % 9 AS major, p_partkey % 20 AS minor FROM {part}", "part")
def f14(part: DataFrame) -> DataFrame:
    text = F.concat(F.lit("release v"), (F.col("p_size") % 9).cast("string"), F.lit("."), (F.col("p_partkey") % 20).cast("string"), F.lit(" of 2024"))
    parts = fn.version_parts(text)
    return part.select("p_partkey", F.get(parts, F.lit(0)).alias("major"), F.get(parts, F.lit(1)).alias("minor"))


@query("f14_release_versions", r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_.+-]+[^\p{L}\p{N}_.+-]?')) AS t FROM {documents}),
   m AS (SELECT doc_id, lower(left(t, 1)) = 'v' AS v, list_transform(string_split(regexp_extract(t, '^[vV]?([0-9]+(?:\.[0-9]+)+)', 1), '.'), lambda x: TRY_CAST(x AS BIGINT)) AS n FROM t
     WHERE regexp_matches(t, '^[vV]?[0-9]+(?:\.[0-9]+)+(?:-[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*(?:\+[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*)?|\+[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*)?(?:[^\p{L}\p{N}_.+-]|\.[\s)\]}>''"`]?)?$', 's'))
   SELECT DISTINCT doc_id, array_to_string(n, '.') AS version FROM m WHERE len(list_filter(n, lambda x: x < 4294967296)) = len(n) AND n[1] NOT BETWEEN 1900 AND 2100
     AND NOT (len(n) = 3 AND n[3] BETWEEN 1900 AND 2100 AND n[1] BETWEEN 1 AND 31 AND n[2] BETWEEN 1 AND 31 AND least(n[1], n[2]) <= 12) AND NOT (len(n) = 4 AND list_max(n) <= 255 AND NOT v)""", "documents")  # fmt: skip
def f14_releases(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.explode(fn.release_versions(F.col("text"))).alias("version"))


_FOUND = """CASE page_id % 6 WHEN 0 THEN [['url', url, NULL], ['http_method', 'GET', NULL], ['endpoint_path', '/api/v1/items', 'GET'], ['endpoint_path', '/b/' || chr(123) || 'id', 'GET'], ['protocol', split_part(url, ':', 1), NULL]]
  WHEN 1 THEN [['url', 'https://u:p@h.example:8443/p/q?k=2#f', NULL], ['url', 'http://[::1]:99999/x', NULL], ['http_method', 'PUT', NULL], ['http_method', 'POST', NULL], ['endpoint_path', '/p/q', NULL], ['endpoint_path', '/x', NULL], ['port', '8443', NULL], ['protocol', 'https', NULL], ['protocol', 'http', NULL]]
  WHEN 2 THEN [['status_code', '404', NULL], ['status_code', '200', NULL]] WHEN 3 THEN [['auth_rule', 'bearer_token', NULL]] WHEN 4 THEN [['protocol', 'tcp', NULL], ['protocol', 'udp', NULL], ['protocol', 'grpc', NULL], ['protocol', 'wss', NULL], ['protocol', 'http', NULL]] ELSE [] END"""


@query("f06_line_facts", f"""WITH f AS (SELECT page_id, unnest({_FOUND}) AS f, url FROM {{pages}}), p AS (SELECT page_id, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM {{pages}} WHERE page_id % 6 = 0)
  SELECT DISTINCT page_id, f[1] AS fact_kind, f[2] AS value, f[3] AS method FROM f UNION SELECT page_id, 'endpoint_path', path, 'GET' FROM p WHERE length(path) >= 2 AND regexp_matches(path, '^[A-Za-z0-9/_.{{}}-]*$')""".replace("{{}}", "{" + "}"), "pages")  # fmt: skip
def f06(pages: DataFrame) -> DataFrame:
    """A line of its own sort for every page."""
    i = F.col("page_id") % 6
    line = (
        F.when(i == 0, F.concat(F.lit("get /api/v1/items?x=1 or (/b/{id}), see "), "url", F.lit(";"))).when(i == 1, F.lit('put "https://u:p@h.example:8443/p/q?k=2#f" then POST /odd$path http://[::1]:99999/x'))
        .when(i == 2, F.lit("HTTP/1.1 404 Not; http/1.1 500, HTTP/2 200 HTTP/2 999 HTTP/1.1 404")).when(i == 3, F.lit(" Authorization : Bearer abc")).when(i == 4, F.lit("uses tcp, UDP; (gRPC) and wss HTTP")).otherwise("authorization: digest x")
    )
    return facts.line_facts(pages.select("page_id", line.alias("line")), ["page_id"], "line")
