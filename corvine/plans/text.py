"""Queries of text preparation: blocks, chunks, quality and near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import blocks, ranking, records
from ..registry import query
from ..rows import small_batches

_LINES = """l AS (SELECT doc_id, i AS chunk_index, content_text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content_text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM {documents})
  WHERE trim(content_text, ' ') <> '')"""
_LOWER_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= {1})"


@query("p13_repeated_boilerplate", f"""WITH {_LINES}, k AS (SELECT chunk_index % 6 AS page, doc_id, trim(regexp_replace(content_text, '[ \\t]+', ' ', 'g')) AS line FROM l),
   r AS (SELECT doc_id, line, count(DISTINCT page) AS pages, count(*) AS n FROM k WHERE length(line) BETWEEN 1 AND 160 GROUP BY 1, 2)
   SELECT doc_id, line, pages, n FROM r WHERE pages >= 5""", "documents")  # fmt: skip
def p13(documents: DataFrame) -> DataFrame:
    lines = blocks.line_chunks(documents).select("doc_id", (F.col("chunk_index") % 6).alias("page"), F.trim(F.regexp_replace("content_text", r"[ \t]+", " ")).alias("line"))
    return records.repeated_lines(lines, ["doc_id"], "line", "page", least=5, longest=160)


@query("p17_document_summary", f"""WITH {_LINES}, s AS (SELECT *, sum(length(content_text) + 1) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS used FROM l WHERE length(content_text) >= 10)
   SELECT doc_id, string_agg(content_text, chr(10) ORDER BY chunk_index) AS summary FROM s WHERE used <= 2001 GROUP BY doc_id""", "documents")  # fmt: skip
def p17(documents: DataFrame) -> DataFrame:
    lines = blocks.line_chunks(documents).where(F.length("content_text") >= 10)
    used = F.sum(F.length("content_text") + 1).over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    kept = lines.withColumn("used", used).where("used <= 2001").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content_text"))).alias("x"))
    return kept.select("doc_id", F.array_join(F.transform("x", lambda r: r["content_text"]), "\n").alias("summary"))


@query("c06_chunk_digest", f"""WITH {_LINES} SELECT doc_id, chunk_index, 'sha256:' || sha256(content_text) AS literal_digest, length(content_text) AS n_chars,
   len(list_filter(string_split(content_text, ' '), lambda w: w <> '')) AS token_count FROM l""", "documents")  # fmt: skip
def c06(documents: DataFrame) -> DataFrame:
    words = F.filter(F.split("content_text", " "), lambda w: w != "")
    return blocks.line_chunks(documents).select(
        "doc_id", "chunk_index", F.concat(F.lit("sha256:"), F.sha2("content_text", 256)).alias("literal_digest"), F.length("content_text").alias("n_chars"), F.size(words).alias("token_count")
    )


@query("c09_quality_parts", f"""WITH {_LINES} SELECT doc_id, chunk_index, round(greatest(0, least(1, 1.0 - CASE WHEN octet_length(encode(content_text)) < 100 THEN 0.2 ELSE 0 END
   - CASE WHEN len(list_distinct(w)) / len(w) < 0.3 THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS quality FROM (SELECT *, list_filter(string_split(content_text, ' '), lambda x: x <> '') AS w FROM l)""", "documents")  # fmt: skip
def c09_parts(documents: DataFrame) -> DataFrame:
    rows = blocks.line_chunks(documents).withColumn("w", F.filter(F.split("content_text", " "), lambda x: x != ""))
    short = F.when(F.octet_length("content_text") < 100, 0.2).otherwise(0.0)
    dull = F.when(F.size(F.array_distinct("w")) / F.size("w") < 0.3, 0.1).otherwise(0.0)
    return rows.select("doc_id", "chunk_index", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - short - dull)), 6).alias("quality"))


@query("c10_simhash", None, "documents")
def c10(documents: DataFrame) -> DataFrame:
    return fn.simhash(blocks.line_chunks(documents), ["doc_id", "chunk_index"], "content_text")


@query("c11_near_duplicate_flag", None, "documents")
def c11(documents: DataFrame) -> DataFrame:
    lines = blocks.line_chunks(documents).withColumn("d", F.sha2("content_text", 256))
    rows = fn.simhash(lines, ["doc_id", "chunk_index", "d"], "content_text")
    return rows.select("doc_id", "chunk_index", fn.near_duplicate_flag(F.col("simhash"), F.col("d"), ["doc_id"], "chunk_index").alias("is_near_duplicate"))


@query("c13_text_quality_ratios", r"""SELECT doc_id, round(len(regexp_extract_all(text, '[0-9]')) / greatest(length(text), 1), 9) AS digit_ratio,
   round(len(regexp_extract_all(text, '[^\p{L}\p{N}\s]')) / greatest(length(text), 1), 9) AS symbol_ratio FROM {documents}""", "documents")  # fmt: skip
def c13(documents: DataFrame) -> DataFrame:
    n = F.greatest(F.length("text"), F.lit(1))
    ratio = lambda p: F.round(F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))) / n, 9)
    return documents.select("doc_id", ratio("[0-9]").alias("digit_ratio"), ratio(r"[^\p{L}\p{N}\s]").alias("symbol_ratio"))


@query("c14_tokens", "SELECT doc_id, len(list_distinct(" + _LOWER_TOKENS.format("text", 3) + ")) AS n_tokens, len(" + _LOWER_TOKENS.format("text", 1) + ") AS n_words FROM {documents}", "documents")
def c14(documents: DataFrame) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 1)
    return documents.select("doc_id", F.size(fn.tokens(F.col("text"), 3)).alias("n_tokens"), F.size(words).alias("n_words"))


@query("c14_nfkc_tokens", None, "documents")
def c14_nfkc(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.size(fn.tokens(fn.nfkc(F.col("text")))).alias("n_tokens"))


_HAS = "contains(t, '{0}')".format


@query("s14_code_language_guess", f"""WITH s AS (SELECT doc_id, array_to_string(string_split(text, chr(10))[1:50], chr(10)) AS t FROM {{documents}})
   SELECT doc_id, CASE WHEN {_HAS('fn ')} AND ({_HAS('-> ')} OR {_HAS('pub ')} OR {_HAS('let ')}) THEN 'rust' WHEN {_HAS('def ')} AND {_HAS(':')} AND NOT contains(t, chr(123)) THEN 'python' WHEN {_HAS('func ')} AND {_HAS('package ')} THEN 'go'
   WHEN {_HAS('function ')} OR {_HAS('const ')} OR contains(t, '=> ' || chr(123)) THEN CASE WHEN {_HAS(': string')} OR {_HAS(': number')} OR {_HAS('interface ')} THEN 'typescript' ELSE 'javascript' END
   WHEN {_HAS('class ')} AND contains(t, chr(123)) AND ({_HAS('public ')} OR {_HAS('private ')}) AND {_HAS('package ')} AND {_HAS('import java')} THEN 'java'
   WHEN {_HAS('class ')} AND contains(t, chr(123)) AND ({_HAS('public ')} OR {_HAS('private ')}) AND ({_HAS('#include')} OR {_HAS('std::')}) THEN 'cpp'
   WHEN {_HAS('class ')} AND contains(t, chr(123)) AND ({_HAS('public ')} OR {_HAS('private ')}) AND {_HAS('using ')} AND {_HAS('namespace ')} THEN 'csharp'
   WHEN {_HAS('<?php')} OR {_HAS('function ')} AND {_HAS('$')} THEN 'php' WHEN {_HAS('require ')} AND contains(t, 'end' || chr(10)) THEN 'ruby'
   WHEN {_HAS('import Swift')} OR {_HAS('func ')} AND {_HAS('->')} AND NOT {_HAS('pub ')} THEN 'swift' WHEN {_HAS('fun ')} AND {_HAS('val ')} THEN 'kotlin'
   WHEN {_HAS('defmodule ')} OR {_HAS('def ')} AND contains(t, 'do' || chr(10)) THEN 'elixir' WHEN {_HAS('FROM ')} AND {_HAS('RUN ')} THEN 'dockerfile' WHEN {_HAS('---')} AND {_HAS(': ')} AND NOT contains(t, chr(123)) THEN 'yaml'
   WHEN starts_with(t, chr(123)) OR contains(t, '":' || chr(10)) THEN 'json' WHEN {_HAS('resource ')} AND {_HAS('provider ')} THEN 'terraform' WHEN {_HAS('CREATE TABLE')} OR {_HAS('SELECT ')} THEN 'sql' ELSE '' END AS code_language FROM s""", "documents")  # fmt: skip
def s14(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", fn.code_language(F.col("text")).alias("code_language"))


@query("sf_slug", "SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM {documents}", "documents")
def sf_slug(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", fn.slug(F.col("text")).alias("slug"))


@query("sf_unaccent", "SELECT doc_id, strip_accents(text) = text AS plain, md5(strip_accents(text)) AS digest FROM {documents}", "documents")
def sf_unaccent(documents: DataFrame) -> DataFrame:
    small_batches(documents.sparkSession)
    flat = documents.select("doc_id", "text", fn.unaccent(F.col("text")).alias("u"))
    return flat.select("doc_id", (F.col("u") == F.col("text")).alias("plain"), F.md5("u").alias("digest"))


@query("p22_mojibake_repair", "SELECT doc_id, md5(text) AS digest FROM {documents}", "documents")
def p22(documents: DataFrame) -> DataFrame:
    small_batches(documents.sparkSession)
    # what was damaged by reading UTF-8 as Latin-1 comes back as it was
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return documents.select("doc_id", F.md5(fn.repair_mojibake(broken)).alias("digest"))


@query("sf_hashes", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, sha1(text) AS sha1 FROM {documents}", "documents")
def sf_hashes(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1"))


@query("sf_math_dates", """SELECT event_id, round(ln(1 + value), 9) AS log_value, least(value, 10.0) AS low, greatest(value, 10.0) AS high, ceil(value)::BIGINT AS up, floor(value)::BIGINT AS down,
   floor(epoch(ts))::BIGINT AS epoch_s, ts + INTERVAL 90 SECOND AS later FROM {events}""", "events")  # fmt: skip
def sf_math(events: DataFrame) -> DataFrame:
    v = F.col("value")
    return events.select(
        "event_id", F.round(F.log1p(v), 9).alias("log_value"), F.least(v, F.lit(10.0)).alias("low"), F.greatest(v, F.lit(10.0)).alias("high"), F.ceil(v).alias("up"),
        F.floor(v).alias("down"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch_s"), (F.col("ts") + F.expr("INTERVAL 90 SECOND")).alias("later"),
    )


@query("sf_month_prefixes", """SELECT o_orderkey, string_agg(strftime(m, '%Y-%m'), ',' ORDER BY m) AS prefixes FROM (SELECT o_orderkey, unnest(generate_series(date_trunc('month', o_orderdate), date_trunc('month', o_orderdate) + INTERVAL 3 MONTH, INTERVAL 1 MONTH)) AS m
   FROM {orders}) GROUP BY 1""", "orders")  # fmt: skip
def sf_months(orders: DataFrame) -> DataFrame:
    start = F.trunc(F.col("o_orderdate").cast("date"), "month")
    months = F.sequence(start, F.add_months(start, 3), F.expr("INTERVAL 1 MONTH"))
    return orders.select("o_orderkey", F.array_join(F.transform(months, lambda m: F.date_format(m, "yyyy-MM")), ",").alias("prefixes"))


@query("f15_version_order", """SELECT v, row_number() OVER (ORDER BY a DESC, b DESC, c DESC, v) AS place FROM (SELECT DISTINCT v, CAST(split_part(v, '.', 1) AS BIGINT) AS a, CAST(split_part(v, '.', 2) AS BIGINT) AS b,
   CASE WHEN split_part(v, '.', 3) = '' THEN 0 ELSE CAST(split_part(v, '.', 3) AS BIGINT) END AS c FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN (p_size % 4) || '.' || (p_partkey % 13) ELSE (p_size % 4) || '.' || (p_partkey % 13) || '.' || (p_size % 11) END AS v FROM {part}))""", "part")  # fmt: skip
def f15(part: DataFrame) -> DataFrame:
    s = lambda e: (e).cast("string")
    a, b, c = F.col("p_size") % 4, F.col("p_partkey") % 13, F.col("p_size") % 11
    v = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(".", s(a), s(b))).otherwise(F.concat_ws(".", s(a), s(b), s(c)))
    versions = part.select(v.alias("v")).distinct().withColumn("k", fn.version_parts(F.col("v")))
    # the first number deals versions into ranges
    return ranking.global_position(versions, [F.desc("k"), F.col("v")], -F.get("k", F.lit(0)), "place").select("v", "place")
