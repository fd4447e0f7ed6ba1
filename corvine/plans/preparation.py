"""Queries of text preparation over texts of many lines: pages as outlines, files of rows and records, cut code, repaired layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import assess
from ..operators import blocks, code, layout, records
from ..registry import query
from ..sources import delimited, files, streams

# ---- pages as texts of headings, tables, lists, paragraphs and code


def outlines(pages: DataFrame) -> DataFrame:
    """``(page_id, text)``: every page as a text of lines, from its markup.

    The first heading, the navigation as a table, paragraphs under a heading for each three, sentences of every fourth one
    as a list, scripts and styles as code, and the footer.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    every = lambda p: F.regexp_extract_all("html", F.lit(p), F.lit(1))
    title = F.concat(F.lit("# "), plain(F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1)))
    links = F.transform(F.arrays_zip(every('<a href="([^"]*)"').alias("to"), every(r"(?s)<a href=[^>]*>(.*?)</a>").alias("name")), lambda a: F.concat(F.lit("| "), plain(a["name"]), F.lit(" | "), a["to"], F.lit(" |")))
    table = F.when(F.size(links) > 0, F.concat(F.lit("| Name | Target |\n| --- | --- |\n"), F.array_join(links, "\n")))
    body = F.filter(F.transform(every(r"(?s)<p>(.*?)(?=<p>|</p>|</article>|<footer)"), plain), lambda p: p != "")

    def part(p: Column, i: Column) -> Column:
        head = F.when(i % 3 == 0, F.concat(F.lit("## Part "), (F.floor(i / 3) + 1).cast("string"), F.lit("\n\n"))).otherwise(F.lit(""))
        items = F.array_join(F.transform(F.filter(F.split(p, r"(?<=\.) "), lambda s: s != ""), lambda s: F.concat(F.lit("- "), s)), "\n")
        return F.concat(head, F.when(i % 4 == 3, items).otherwise(p))

    script = F.transform(every(r"(?s)<script>(.*?)</script>"), lambda s: F.concat(F.lit("```javascript\n"), s, F.lit("\n```")))
    style = F.transform(every(r"(?s)<style>(.*?)</style>"), lambda s: F.concat(F.lit("```css\n"), s, F.lit("\n```")))
    footer = plain(F.regexp_extract("html", r"(?s)<footer[^>]*>(.*?)</footer>", 1))
    text = F.concat_ws("\n\n", title, table, F.array_join(F.transform(body, part), "\n\n"), F.array_join(F.concat(script, style), "\n\n"), footer)
    return pages.select("page_id", text.alias("text"))


@query("p14_structured_blocks", None, "pages")
def p14(pages: DataFrame) -> DataFrame:
    return blocks.blocks(outlines(pages), "page_id")


@query("p15_outline", None, "pages")
def p15(pages: DataFrame) -> DataFrame:
    heads = blocks.blocks(outlines(pages), "page_id").where("kind = 'heading'")
    return heads.select("page_id", "ordinal", "level", F.array_join("heading_trail", " / ").alias("path"))


@query("c01_chunk_windows", None, "pages")
def c01(pages: DataFrame) -> DataFrame:
    return blocks.chunks(outlines(pages), id_col="page_id").drop("text_quality")


@query("c08_sentence_windows", None, "pages")
def c08(pages: DataFrame) -> DataFrame:
    return blocks.chunks(outlines(pages), id_col="page_id").select("page_id", "chunk_index", "window_text")


@query("c09_quality_gate", None, "pages")
def c09(pages: DataFrame) -> DataFrame:
    good = F.filter(F.array("quality_score"), lambda q: F.coalesce(q, F.lit(1.0)) >= 0.35)
    # a filter of the scores would find them twice
    return blocks.chunks(outlines(pages), id_col="page_id").select("page_id", "chunk_index", F.explode(good).alias("quality_score"))


# ---- code, layout and legibility

_LISTING = """l AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' ELSE 'sql' END AS language,
   CASE p_partkey % 3 WHEN 0 THEN 'import math' || chr(10) || chr(10) || 'class Part:' || chr(10) || '    name = "' || p_name || '"' || chr(10) || chr(10) || 'def size():' || chr(10) || '    return ' || p_size || chr(10) || chr(10) || '@cached' || chr(10) || 'def price():' || chr(10) || '    # ' || repeat(p_type || ' ', 8) || chr(10) || '    return ' || p_size || chr(10)
   WHEN 1 THEN 'use std::fmt;' || chr(10) || 'pub struct Part ' || chr(123) || chr(10) || '    size: u32, // ' || p_type || chr(10) || chr(125) || chr(10) || '/// ' || p_name || chr(10) || 'pub fn size() -> u32 ' || chr(123) || chr(10) || '    ' || p_size || chr(10) || chr(125) || chr(10) || 'fn brand() -> String ' || chr(123) || chr(10) || '    "' || repeat(p_brand, 20) || '".to_string()' || chr(10) || chr(125)
   ELSE 'CREATE TABLE part_' || p_partkey || ' (' || chr(10) || '  name TEXT, -- ' || p_name || chr(10) || '  size INT' || chr(10) || ');' || chr(10) || 'INSERT INTO part_' || p_partkey || chr(10) || '  VALUES (''' || p_name || ''', ' || p_size || ');' END AS text FROM {part})"""


def listings(part: DataFrame) -> DataFrame:
    """``(p_partkey, language, text)``: a listing of some definitions for every part."""
    return part.sparkSession.sql(f"WITH {_LISTING} SELECT * FROM l", part=part)


@query("c12_code_pieces", None, "part")
def c12(part: DataFrame) -> DataFrame:
    return code.code_pieces(listings(part), 90, "p_partkey", "text", "language")


@query("p16_layout_repair", "SELECT page_id, url AS text FROM {pages} WHERE regexp_matches(url, '^https?://[^/]+(/[^/ ]+)+$')", "pages")
def p16(pages: DataFrame) -> DataFrame:
    """URLs that a narrow column cut after the scheme and before every part of the path come back whole."""
    urls = pages.where(F.col("url").rlike("^https?://[^/]+(/[^/ ]+)+$"))
    cut = F.regexp_replace(F.regexp_replace("url", "^(https?)", "$1\n"), "(?<=[^:/\n])/", "\n/")
    return layout.repair_layout(urls.select("page_id", cut.alias("text")), "page_id").select("page_id", "text")


@query("p16_repaired_documents", None, "documents")
def p16_documents(documents: DataFrame) -> DataFrame:
    done = layout.repair_layout(documents)
    return done.select("doc_id", "joined", F.sha2("text", 256).alias("digest"))


@query("c13_text_quality", None, "documents")
def c13(documents: DataFrame) -> DataFrame:
    found = documents.select("doc_id", assess(F.col("text")).alias("q"))
    return found.select("doc_id", F.round("q.score", 6).alias("score"), "q.low_confidence", "q.unstable", "q.tokens", F.array_join("q.reasons", ",").alias("reasons"))


# ---- files of rows: customers of a nation, 200 to a file, with a delimiter of its own

_FILE = "concat(CAST(c_nationkey AS VARCHAR(20)), '-', CAST(c_custkey // 200 AS VARCHAR(20)))"


def _files(customer: DataFrame, line: Column, between: str = "\n") -> DataFrame:
    """``(path, nation, content)``: a file of the lines of up to 200 customers."""
    key = F.concat_ws("-", "c_nationkey", F.floor(F.col("c_custkey") / 200).cast("bigint"))
    lines = customer.select(key.alias("path"), F.col("c_nationkey").alias("nation"), "c_custkey", line.alias("line"))
    held = lines.groupBy("path", "nation").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))).alias("x"))
    return held.select("path", "nation", F.array_join(F.transform("x", lambda r: r["line"]), between).alias("content"))


@query("s04_delimited_scan", f"""SELECT {_FILE} AS path, c_custkey, substr(',;' || chr(9) || '|', c_nationkey % 4 + 1, 1) AS delimiter, 'inferred_first_row_header' AS policy, 'Name' AS second_header, c_name AS name,
   'said "' || c_mktsegment || ', ' || c_mktsegment || '; ok|' || chr(9) || '"' AS note, round(c_acctbal, 2) AS balance FROM {{customer}}""", "customer")  # fmt: skip
def s04(customer: DataFrame) -> DataFrame:
    """Files with a byte order mark, blank lines, and cells that hold quotes and every delimiter."""
    d = F.substring(F.lit(",;\t|"), F.col("c_nationkey") % 4 + 1, F.lit(1))
    note = F.concat(F.lit('"said ""'), F.col("c_mktsegment"), F.lit(", "), F.col("c_mktsegment"), F.lit('; ok|\t"""'))
    files = _files(customer, F.concat_ws("", F.col("c_custkey"), d, "c_name", d, note, d, F.round("c_acctbal", 2).cast("string")), "\n\n")
    mark = F.substring(F.lit(",;\t|"), F.col("nation") % 4 + 1, F.lit(1))
    content = F.concat(F.lit("﻿Key"), mark, F.lit("Name"), mark, F.lit("Note"), mark, F.lit("Balance\n"), "content")
    rows = delimited.read_delimited(files.select("path", F.encode(content, "UTF-8").alias("content")))
    cell = lambda i: F.get("cells", F.lit(i))
    return rows.select("path", cell(0).cast("bigint").alias("c_custkey"), "delimiter", "policy", F.get("headers", F.lit(1)).alias("second_header"), cell(1).alias("name"), cell(2).alias("note"), cell(3).cast("double").alias("balance"))


_RECORDS = f"SELECT {_FILE} AS path, (row_number() OVER (PARTITION BY c_nationkey, c_custkey // 200 ORDER BY c_custkey) - 1)::INTEGER AS ordinal, c_custkey AS key, c_name AS name, round(c_acctbal, 2) AS balance FROM {{customer}}"


def _read(files: DataFrame, kind: str) -> DataFrame:
    rows = streams.read_records(files, streams.stream_format(F.concat("path", F.lit(f".{kind}")), F.lit("")))
    one = F.from_json("record", "key bigint, name string, balance double")
    return rows.select("path", "ordinal", one.alias("r")).select("path", "ordinal", "r.*")


def _as_json() -> Column:
    return F.to_json(F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("balance")))


@query("s06_json_records", _RECORDS, "customer")
def s06(customer: DataFrame) -> DataFrame:
    files = _files(customer, _as_json(), ",\n")
    return _read(files.select("path", F.concat(F.lit("[\n"), "content", F.lit("\n]\n")).alias("content")), "json")


@query("s07_json_lines", _RECORDS, "customer")
def s07(customer: DataFrame) -> DataFrame:
    return _read(_files(customer, _as_json(), "\n\n"), "ndjson")


@query("s08_yaml_stream", _RECORDS, "customer")
def s08(customer: DataFrame) -> DataFrame:
    """Single documents of a stream, with a comment and an empty document between them."""
    line = F.concat(F.lit("key: "), F.col("c_custkey"), F.lit("\nname: '"), F.col("c_name"), F.lit("' # a name\nbalance: "), F.round("c_acctbal", 2).cast("decimal(20,2)").cast("string"))
    return _read(_files(customer, line, "\n---\n---\n"), "yaml")


@query("s09_toml_document", "SELECT {_FILE} AS path, count(*) AS customers, min(c_custkey) AS first_key, round(sum(round(c_acctbal, 2)), 2) AS balance FROM {customer} GROUP BY 1".replace("{_FILE}", _FILE), "customer")
def s09(customer: DataFrame) -> DataFrame:
    """A document is one record; its tables are fields of it."""
    line = F.concat(F.lit("[[customer]]\nkey = "), F.col("c_custkey"), F.lit("\nname = '"), F.col("c_name"), F.lit("'\nbalance = "), F.round("c_acctbal", 2).cast("decimal(20,2)").cast("string"))
    rows = streams.read_records(_files(customer, line), F.lit("toml"))
    held = rows.select("path", F.from_json("record", "customer array<struct<key bigint, name string, balance double>>").alias("r"))
    total = F.aggregate("r.customer", F.lit(0.0), lambda s, c: s + c["balance"])
    return held.select("path", F.size("r.customer").cast("bigint").alias("customers"), F.array_min(F.transform("r.customer", lambda c: c["key"])).alias("first_key"), F.round(total, 2).alias("balance"))


# ---- wide record units

_UNITS = """u AS (SELECT c_custkey, concat('[unit_ordinal=', CAST(c_custkey AS VARCHAR(20)), '] ') AS header, concat('key=', CAST(c_custkey AS VARCHAR(20))) AS f1, concat('name=', c_name) AS f2,
   concat('segment=', c_mktsegment) AS f3, concat('nation=', CAST(c_nationkey AS VARCHAR(20))) AS f4, concat('note=', repeat(c_mktsegment, CAST(c_custkey % 6 AS INT))) AS f5, 'end=yes' AS f6 FROM {customer}),
   t AS (SELECT c_custkey, header, concat(header, 'fields: ', concat_ws('; ', f1, f2, f3, f4, f5, f6)) AS text, f1, f2, f3, f4, f5, f6 FROM u)"""


def _units(customer: DataFrame) -> DataFrame:
    return customer.sparkSession.sql(f"WITH {_UNITS} SELECT * FROM t", customer=customer)


_FOLD = "list_reduce([{'done': []::VARCHAR[], 'now': NULL::VARCHAR}]::STRUCT(done VARCHAR[], now VARCHAR)[] || list_transform([f1, f2, f3, f4, f5, f6], lambda f: {'done': []::VARCHAR[], 'now': f}), lambda s, x: CASE WHEN s.now IS NULL THEN {'done': s.done, 'now': x.now} WHEN length(s.now || '; ' || x.now) > 70 - length(header) - 8 THEN {'done': list_append(s.done, s.now), 'now': x.now} ELSE {'done': s.done, 'now': s.now || '; ' || x.now} END)"


@query("p05_split_units", f"""WITH {_UNITS}, s AS (SELECT c_custkey, header, text, {_FOLD} AS s FROM t),
   p AS (SELECT c_custkey, CASE WHEN length(text) <= 70 THEN [text] ELSE list_transform(list_append(s.done, s.now), lambda x: header || 'fields: ' || x) END AS parts FROM s)
   SELECT c_custkey, generate_subscripts(parts, 1)::INTEGER - 1 AS part, unnest(parts) AS unit FROM p""", "customer")  # fmt: skip
def p05(customer: DataFrame) -> DataFrame:
    units = _units(customer)
    return units.select("c_custkey", F.posexplode(streams.split_units(F.col("text"), 70)).alias("part", "unit"))


@query("p08_focused_excerpt", f"""WITH {_UNITS} SELECT c_custkey, CASE WHEN length(text) <= 90 THEN text ELSE header || 'fields: ' || f2 || '; ' || f3 || '; ' || f4 END AS excerpt FROM t
   WHERE length(header || 'fields: ' || f2 || '; ' || f3 || '; ' || f4) <= 90""", "customer")  # fmt: skip
def p08(customer: DataFrame) -> DataFrame:
    """The segment's field and its neighbours, where they fit."""
    units = _units(customer).where(F.length(F.concat("header", F.lit("fields: "), F.concat_ws("; ", "f2", "f3", "f4"))) <= 90)
    return streams.focused_excerpts(units, F.array(F.lit("segment=")), 90, "c_custkey", "text")


# ---- kinds of files, and lines with hints

_UPLOAD = """f AS (SELECT page_id, concat('/in/', CASE page_id % 9 WHEN 0 THEN 'Report.PDF' WHEN 1 THEN 'a.b/noext' WHEN 2 THEN 'x.tar.gz' WHEN 3 THEN 'table.TSV' WHEN 4 THEN 'main.rs' WHEN 5 THEN '.env.backup.2' WHEN 6 THEN 'photo.jpeg' WHEN 7 THEN 'notes.docx' ELSE 'page.htm' END) AS name,
  CASE page_id % 7 WHEN 0 THEN ' Text/HTML; charset=utf-8' WHEN 1 THEN 'application/octet-stream' WHEN 2 THEN 'video/mp4' WHEN 3 THEN '' WHEN 4 THEN 'image/png' ELSE NULL END AS media, CASE WHEN page_id % 5 = 0 THEN concat(chr(1), chr(2), 'ab') ELSE html END AS body FROM {pages})"""


@query("s01_declared_kind", f"""WITH {_UPLOAD} SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'pdf' WHEN page_id % 7 = 4 OR page_id % 9 = 6 THEN 'image' WHEN page_id % 9 = 7 THEN 'docx' WHEN page_id % 9 = 3 THEN 'spreadsheet' WHEN page_id % 7 = 0 OR page_id % 9 IN (4, 8) THEN 'text_like' END AS kind FROM f""", "pages")
def s01(pages: DataFrame) -> DataFrame:
    uploads = pages.sparkSession.sql(f"WITH {_UPLOAD} SELECT * FROM f", pages=pages)
    return uploads.select("page_id", files.declared_kind(F.col("name"), F.col("media")).alias("kind"))


@query("s02_sniffed_kind", f"""WITH {_UPLOAD} SELECT page_id, coalesce(CASE WHEN page_id % 9 = 0 THEN 'pdf' WHEN page_id % 7 = 4 OR page_id % 9 = 6 THEN 'image' WHEN page_id % 9 = 7 THEN 'docx' WHEN page_id % 9 = 3 THEN 'spreadsheet' WHEN page_id % 7 = 0 OR page_id % 9 IN (4, 8) THEN 'text_like' END,
  CASE WHEN page_id % 7 = 2 OR page_id % 5 = 0 THEN 'binary' ELSE 'text_like' END) AS kind FROM f""", "pages")  # fmt: skip
def s02(pages: DataFrame) -> DataFrame:
    uploads = pages.sparkSession.sql(f"WITH {_UPLOAD} SELECT * FROM f", pages=pages)
    return uploads.select("page_id", files.file_kind(F.col("name"), F.col("media"), F.encode("body", "UTF-8")).alias("kind"))


@query("s03_text_lines", None, "pages")
def s03(pages: DataFrame) -> DataFrame:
    return files.text_lines(outlines(pages), "page_id")
