"""Queries of records and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import records
from ..registry import query


@query("p01_flatten_record", "SELECT event_id, 'k' AS path, props ->> '$.k' AS value FROM {events}", "events")
def p01(events: DataFrame) -> DataFrame:
    return records.flatten_json(events, "event_id", "props")


@query("p01_flatten_nested", "SELECT event_id, unnest(['a.b', 'a.c', 'd[0].e']) AS path, unnest([event_type, '1, 2', CAST(user_id AS VARCHAR)]) AS value FROM {events}", "events")
def p01_nested(events: DataFrame) -> DataFrame:
    body = F.concat(F.lit('{"a": {"b": "'), "event_type", F.lit('", "c": [1, 2], "n": null}, "d": [{"e": '), F.col("user_id").cast("string"), F.lit("}]}"))
    return records.flatten_json(events.select("event_id", body.alias("j")), "event_id", "j")


@query("p02_timestamp_by_shape", """SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS seconds FROM {events}""", "events")
def p02(events: DataFrame) -> DataFrame:
    ts, i = F.col("ts").cast("timestamp"), F.col("event_id") % 3
    text = (
        F.when(i == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i == 1, F.unix_timestamp(ts).cast("string")).otherwise(F.unix_millis(ts).cast("string"))
    )
    return events.select("event_id", F.unix_timestamp(records.timestamp_by_shape(text)).alias("seconds"))


@query("p02_earliest_time", """SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN epoch(date_trunc('second', ts))::BIGINT - CASE event_id % 4 WHEN 1 THEN 90 WHEN 2 THEN 60 ELSE 0 END END AS seconds FROM {events}""", "events")
def p02_earliest(events: DataFrame) -> DataFrame:
    """Times under any key, at any depth, as text, seconds and milliseconds; every fourth record has none."""
    ts, i = F.col("ts").cast("timestamp"), F.col("event_id") % 4
    seconds, shown = F.unix_timestamp(ts), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    one = F.concat(F.lit('{"x": {"made": "'), shown, F.lit('", "n": 12}, "list": [{"at": '), (seconds - F.when(i == 1, 90).otherwise(-5)).cast("string"), F.lit("}, "), ((seconds - F.when(i == 2, 60).otherwise(-7)) * 1000 + 999).cast("string"), F.lit("]}"))
    body = F.when(i == 3, F.concat(F.lit('{"when": "'), F.date_format(ts, "dd.MM.yyyy"), F.lit('", "no": "12345"}'))).otherwise(one)
    return records.record_times(events.select("event_id", body.alias("j")), "event_id", "j").select("event_id", F.unix_timestamp("occurred_at").alias("seconds"))


_MENUS = """l AS (SELECT page_id // 30 AS doc, page_id % 30 AS page, k, CASE k WHEN 0 THEN concat('Page ', page_id, ' tells of its own things') WHEN 1 THEN 'Home | About | News | Contact us' WHEN 2 THEN concat(url, ' ', url, ' ', url, ' see') WHEN 3 THEN ' The same footer everywhere '
   WHEN 4 THEN concat('a > b > c ', page_id) WHEN 5 THEN 'a › b › › d' ELSE concat('short line ', page_id % 12) END AS line FROM {pages}, (SELECT unnest(sequence(0, 6)) AS k) WHERE page_id // 30 % 3 <> 2 OR k IN (1, 3))"""


@query("p13_boilerplate_rules", f"""WITH {_MENUS.replace('sequence', 'generate_series')}, r AS (SELECT doc, trim(line) AS t FROM l WHERE length(trim(line)) BETWEEN 1 AND 160 GROUP BY 1, 2 HAVING count(DISTINCT page) >= 5),
   f AS (SELECT doc, page, k, line, k = 1 OR k = 2 OR EXISTS (SELECT 1 FROM r WHERE r.doc = l.doc AND r.t = trim(l.line)) AS f FROM l), s AS (SELECT doc, bool_or(NOT f) AS other FROM f GROUP BY 1)
   SELECT doc, page, k, f AND other AS is_boilerplate FROM f JOIN s USING (doc)""", "pages")  # fmt: skip
def p13_rules(pages: DataFrame) -> DataFrame:
    """Seven lines a page, thirty pages a document; every third document has menus and footers only."""
    spark = pages.sparkSession
    lines = spark.sql(f"WITH {_MENUS.replace('//', 'DIV').replace('SELECT unnest(sequence(0, 6)) AS k', 'SELECT explode(sequence(0, 6)) AS k')} SELECT * FROM l", pages=pages)
    return records.boilerplate(lines, "doc", "line", "page").select("doc", "page", "k", "is_boilerplate")


@query("p03_source_profile", """SELECT 'k' AS path, count(*) FILTER (WHERE props ->> '$.k' IS NOT NULL) AS present, count(*) AS records, min(ts) AS first_at, max(ts) AS last_at FROM {events}""", "events")
def p03(events: DataFrame) -> DataFrame:
    return records.source_profile(records.flatten_json(events, "event_id", "props"), events, "ts")


@query("p04_render_record", """SELECT event_id, '[unit_ordinal=' || row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) || ' occurred_at=' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '] fields: type=' || event_type || '; k=' || (props ->> '$.k') AS line FROM {events}""", "events")
def p04(events: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    fields = F.array(F.concat(F.lit("type="), "event_type"), F.concat(F.lit("k="), F.get_json_object("props", "$.k")))
    return events.select("event_id", records.record_line(n, F.col("ts").cast("timestamp"), fields).alias("line"))


@query("p06_temporal_bounds", """SELECT user_id, epoch(date_trunc('second', min(ts)))::BIGINT AS low, epoch(date_trunc('second', max(ts)))::BIGINT AS high FROM {events} GROUP BY user_id""", "events")
def p06(events: DataFrame) -> DataFrame:
    mark = F.concat(F.lit("[unit occurred_at="), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("] x"))
    bounds = events.select("user_id", records.temporal_bounds(mark).alias("b")).groupBy("user_id").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high"))
    return bounds.select("user_id", F.unix_timestamp("low").alias("low"), F.unix_timestamp("high").alias("high"))


@query("p07_values_only", "SELECT event_id, event_type || ' ' || (props ->> '$.k') AS text FROM {events}", "events")
def p07(events: DataFrame) -> DataFrame:
    fields = F.array(F.concat(F.lit("type="), "event_type"), F.concat(F.lit("at="), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.concat(F.lit("k="), F.get_json_object("props", "$.k")))
    line = records.record_line(F.col("event_id"), F.col("ts").cast("timestamp"), fields)
    return events.select("event_id", records.values_only(line).alias("text"))


@query("p11_semantic_row", "SELECT p_partkey, 'Sheet: parts | Row ' || p_partkey || ' | p_name: ' || p_name || ' | p_brand: ' || p_brand AS line FROM {part}", "part")
def p11(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", records.semantic_row("parts", F.col("p_partkey"), ["p_name", "p_brand"]).alias("line"))


@query("p10_header_canonical", "SELECT n_nationkey, regexp_replace(lower(trim(n_name)), '[^a-z0-9]+', '_', 'g') AS header FROM {nation}", "nation")
def p10(nation: DataFrame) -> DataFrame:
    return nation.select("n_nationkey", F.regexp_replace(F.lower(F.trim("n_name")), "[^a-z0-9]+", "_").alias("header"))


@query("p24_document_status", """SELECT d.document_id, CASE WHEN m.mutation_state IN ('failed', 'conflicted') THEN 'failed' WHEN m.queue_state = 'failed' THEN 'failed' WHEN m.queue_state = 'leased' THEN 'processing'
   WHEN d.readable_revision_id IS NOT NULL THEN 'ready' WHEN m.queue_state = 'canceled' OR m.mutation_state = 'canceled' THEN 'canceled' WHEN m.queue_state = 'queued' THEN 'queued'
   WHEN m.mutation_state IN ('accepted', 'running') THEN 'processing' WHEN m.queue_state = 'completed' THEN 'failed' ELSE 'queued' END AS status FROM {document} d LEFT JOIN {mutation} m ON m.document_id = d.document_id""", "document", "mutation")  # fmt: skip
def p24(document: DataFrame, mutation: DataFrame) -> DataFrame:
    states = document.select("document_id", "readable_revision_id").join(mutation, "document_id", "left")
    return states.select("document_id", records.document_status(F.col("mutation_state"), F.col("queue_state"), F.col("readable_revision_id")).alias("status"))


@query("p23_revision_validation", """SELECT l_orderkey, count(*) AS n, max(l_linenumber)::BIGINT AS last, count(DISTINCT l_linenumber) = count(*) AND max(l_linenumber) - min(l_linenumber) + 1 = count(*) AS contiguous FROM {lineitem} GROUP BY 1""", "lineitem")
def p23(lineitem: DataFrame) -> DataFrame:
    n = F.count("*")
    whole = (F.count_distinct("l_linenumber") == n) & (F.max("l_linenumber") - F.min("l_linenumber") + 1 == n)
    return lineitem.groupBy("l_orderkey").agg(n.alias("n"), F.max("l_linenumber").cast("bigint").alias("last"), whole.alias("contiguous"))
