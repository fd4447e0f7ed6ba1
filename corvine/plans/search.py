"""Queries of search, fusion, reranking and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import blocks, claims, filters, joins, lanes, metadata, ranking, search
from ..registry import query
from .relational import TRIGRAMS as _TRIGRAMS

_W = "regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')"
_POST = f"""p AS (SELECT doc_id, token, count(*) AS tf, min(i) AS first_at FROM (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS i
  FROM (SELECT doc_id, list_filter({_W}, lambda x: x <> '') AS w FROM {{documents}})) GROUP BY 1, 2)"""
_TERMS = """q AS (SELECT * FROM (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 3))) AS token FROM {benchmark})
  UNION SELECT 1000, 'license' UNION SELECT 1000, 'under' UNION SELECT 1001, 'the' UNION SELECT 1001, 'and' UNION SELECT 1001, 'token')"""
_HITS = f"""{_POST}, {_TERMS}, n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1),
  h AS (SELECT query_id, doc_id, count(*) AS matched, max(n.n) AS n, max(first_at) - min(first_at) AS span, sum(tf) AS tf FROM p JOIN q USING (token) JOIN n USING (query_id) GROUP BY 1, 2)"""


def _postings(documents: DataFrame) -> DataFrame:
    return search.postings(documents, "doc_id", F.col("text"))


def _words(documents: DataFrame) -> DataFrame:
    return search.words(documents, "doc_id", F.col("text"))


def _questions(benchmark: DataFrame) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= 3))
    own = benchmark.select(F.col("item_id").alias("query_id"), F.explode(words).alias("token"))
    fixed = benchmark.sparkSession.createDataFrame([(1000, "license"), (1000, "under"), (1001, "the"), (1001, "and"), (1001, "token")], "query_id bigint, token string")
    return own.unionByName(fixed)


@query("l01_lexical_lane", f"WITH {_HITS} SELECT query_id, doc_id, matched, round(matched / n * (1 + 1 / (1 + span / 100.0)) * ln(1 + tf), 6) AS score FROM h WHERE matched = n", "documents", "benchmark")
def l01(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    hits = search.lexical_lane(_words(documents), _questions(benchmark), "doc_id")
    return hits.select("query_id", "doc_id", "matched", F.round("score", 6).alias("score"))


@query("x06_token_match", f"WITH {_HITS} SELECT query_id, doc_id FROM h WHERE matched = n", "documents", "benchmark")
def x06(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search.lexical_lane(_words(documents), _questions(benchmark), "doc_id").select("query_id", "doc_id")


_CUT = "CASE WHEN length({0}) >= 4 THEN substr({0}, 1, 5) ELSE {0} END"


@query("x07_prefix_match", f"""WITH {_POST}, {_TERMS}, c AS (SELECT DISTINCT query_id, {_CUT.format('token')} AS token FROM q), n AS (SELECT query_id, count(*) AS n FROM c GROUP BY 1),
  d AS (SELECT DISTINCT doc_id, {_CUT.format('token')} AS token FROM p) SELECT query_id, doc_id FROM d JOIN c USING (token) JOIN n USING (query_id) GROUP BY query_id, doc_id HAVING count(*) = max(n)""", "documents", "benchmark")  # fmt: skip
def x07(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search.prefix_lane(_words(documents), _questions(benchmark), "doc_id").select("query_id", "doc_id")


@query("l02_relaxation_ladder", f"""WITH {_HITS}, c AS (SELECT DISTINCT query_id, substr(token, 1, 5) AS token FROM q WHERE length(token) >= 4), m AS (SELECT query_id, count(*) AS n FROM c GROUP BY 1),
  d AS (SELECT DISTINCT doc_id, {_CUT.format('token')} AS token FROM p), g AS (SELECT query_id, doc_id, count(*) AS matched, max(m.n) AS n FROM d JOIN c USING (token) JOIN m USING (query_id) GROUP BY 1, 2),
  a AS (SELECT query_id, doc_id, 0 AS pass FROM h WHERE matched = n UNION ALL SELECT query_id, doc_id, 1 FROM g WHERE matched = n UNION ALL SELECT query_id, doc_id, 2 FROM g),
  f AS (SELECT query_id, doc_id, min(pass) AS pass FROM a GROUP BY 1, 2), k AS (SELECT query_id, pass, count(*) AS n FROM f GROUP BY 1, 2),
  b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM k)
  SELECT query_id, doc_id, pass FROM f JOIN b USING (query_id, pass) WHERE prior < 8""", "documents", "benchmark")  # fmt: skip
def l02(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Exact terms, then prefixes of all terms of four characters or more, then of any."""
    return search.relaxation(_postings(documents), _questions(benchmark), "doc_id")


@query("l06_exact_fact_boost", """SELECT p_partkey, CASE WHEN p_name = 'red widget' THEN 1000000.0 ELSE 0 END + (CASE WHEN contains(p_name, 'red') THEN 1 ELSE 0 END + CASE WHEN contains(p_name, 'widget') THEN 1 ELSE 0 END)::DOUBLE AS score
  FROM {part} WHERE contains(p_name, 'red') OR contains(p_name, 'widget') ORDER BY score DESC, p_partkey LIMIT 50""", "part")  # fmt: skip
def l06(part: DataFrame) -> DataFrame:
    hits = F.contains("p_name", F.lit("red")).cast("int") + F.contains("p_name", F.lit("widget")).cast("int")
    score = F.when(F.col("p_name") == "red widget", 1_000_000.0).otherwise(0.0) + hits.cast("double")
    return part.where(hits > 0).select("p_partkey", score.alias("score")).orderBy(F.desc("score"), "p_partkey").limit(50)


@query("l09_entity_ladder", """SELECT node_id, min(step) AS step FROM (SELECT node_id, 0 AS step FROM {node} WHERE lower(label) = 'red widget' UNION ALL SELECT node_id, 2 FROM {node} WHERE starts_with(lower(label), 'red')
  UNION ALL SELECT node_id, 4 FROM {node} WHERE contains(' ' || lower(label) || ' ', ' widget ') UNION ALL SELECT node_id, 6 FROM {node} WHERE contains(lower(label), 'wid') OR contains(lower(label), 'red')) GROUP BY 1""", "node")  # fmt: skip
def l09(node: DataFrame) -> DataFrame:
    low = F.lower("label")
    step = (
        F.when(low == "red widget", 0).when(F.startswith(low, F.lit("red")), 2).when(F.contains(F.concat(F.lit(" "), low, F.lit(" ")), F.lit(" widget ")), 4)
        .when(filters.any_term(F.col("label"), ["wid", "red"]), 6)
    )
    return node.withColumn("step", step).where("step IS NOT NULL").select("node_id", "step")


@query("l10_wildcard_prefix", "SELECT node_id FROM {node} WHERE starts_with(lower(label), 'hot')", "node")
def l10(node: DataFrame) -> DataFrame:
    return node.where(F.startswith(F.lower("label"), F.lit("hot"))).select("node_id")


@query("l13_term_positions", """SELECT doc_id, score, place FROM (SELECT doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS place FROM (SELECT doc_id, source,
  10000 * (CASE WHEN instr(lower(text), 'the') > 0 THEN 1 ELSE 0 END + CASE WHEN instr(lower(text), 'license') > 0 THEN 1 ELSE 0 END)
  - least(CASE WHEN instr(lower(text), 'the') > 0 THEN instr(lower(text), 'the') ELSE 9999 END, CASE WHEN instr(lower(text), 'license') > 0 THEN instr(lower(text), 'license') ELSE 9999 END) AS score FROM {documents}) WHERE score > 0) WHERE place <= 3""", "documents")  # fmt: skip
def l13(documents: DataFrame) -> DataFrame:
    at = [F.instr(F.lower("text"), t) for t in ("the", "license")]
    score = 10_000 * sum(((a > 0).cast("int") for a in at), F.lit(0)) - F.least(*[F.when(a > 0, a).otherwise(9999) for a in at])
    scored = documents.select("doc_id", "source", score.alias("score")).where("score > 0")
    return ranking.top_per_group(scored, ["source"], [F.desc("score"), F.col("doc_id")], 3, rank="place").select("doc_id", "score", "place")


@query("l14_pattern_search", r"""SELECT doc_id, score FROM (SELECT doc_id, 3000 * (regexp_matches(text, 'license')::INT + regexp_matches(text, 'token')::INT) + 5000 * regexp_matches(text, '[A-Za-z_]+ ?= ?["][0-9a-f]+')::INT + 3500 * regexp_matches(text, '[0-9]{3}-[0-9]{4}')::INT
  + 800 * regexp_matches(text, '###')::INT AS score FROM {documents}) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 60""", "documents")  # fmt: skip
def l14(documents: DataFrame) -> DataFrame:
    flag = lambda p: F.col("text").rlike(p).cast("int")
    score = 3000 * (flag("license") + flag("token")) + 5000 * flag('[A-Za-z_]+ ?= ?["][0-9a-f]+') + 3500 * flag("[0-9]{3}-[0-9]{4}") + 800 * flag("###")
    return documents.select("doc_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(60)


@query("l18_excerpt", """SELECT doc_id, substr(text, greatest(greatest(instr(lower(text), 'license'), 1) - 80, 1), 280) AS excerpt FROM {documents} WHERE contains(lower(text), 'license')""", "documents")
def l18(documents: DataFrame) -> DataFrame:
    return documents.where(filters.any_term(F.col("text"), ["license"])).select("doc_id", search.excerpt(F.col("text"), F.lit("license")).alias("excerpt"))


@query("l12_evidence_dedupe", """SELECT digest, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, md5(lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')))) AS digest FROM {documents} WHERE contains(lower(text), 'the')) GROUP BY digest""", "documents")
def l12(documents: DataFrame) -> DataFrame:
    digest = F.md5(F.lower(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " "))))
    return documents.where(F.contains(F.lower("text"), F.lit("the"))).groupBy(digest.alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


_COS = """round(list_aggregate(list_transform(list_zip({0}, {1}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE), 'sum') / (sqrt(list_aggregate(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE), 'sum')) * sqrt(list_aggregate(list_transform({1}, lambda x: x::DOUBLE * x::DOUBLE), 'sum'))), 6)"""


@query("v01_cosine", f"SELECT a.vec_id, {_COS.format('a.embedding', 'b.embedding')} AS similarity FROM {{embeddings}} a JOIN {{embeddings}} b ON b.vec_id = a.vec_id - a.vec_id % 100", "embeddings")
def v01(embeddings: DataFrame) -> DataFrame:
    base = embeddings.select(F.col("vec_id").alias("b"), F.col("embedding").alias("e"))
    pairs = embeddings.join(base, F.col("b") == F.col("vec_id") - F.col("vec_id") % 100)
    return pairs.select("vec_id", F.round(search.cosine(F.col("embedding"), F.col("e")), 6).alias("similarity"))


@query("v02_exact_top_k", f"""SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM
  (SELECT q.vec_id AS query_id, v.vec_id, {_COS.format('q.embedding', 'v.embedding').replace(', 6)', ', 9)')} AS s FROM {{embeddings}} q JOIN {{embeddings}} v ON q.vec_id % 20 = 0)) WHERE rank <= 10""", "embeddings")  # fmt: skip
def v02(embeddings: DataFrame) -> DataFrame:
    asked = embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search.nearest(embeddings, asked, "vec_id", "embedding", 10).select("query_id", "vec_id", "rank")


@query("v06_dimension_groups", "SELECT len(embedding) AS dimensions, count(*) AS n, CASE WHEN len(embedding) <= 2000 THEN 'vector' ELSE 'halfvec' END AS storage FROM {embeddings} GROUP BY 1, 3", "embeddings")
def v06(embeddings: DataFrame) -> DataFrame:
    d = F.size("embedding")
    return embeddings.groupBy(d.alias("dimensions")).agg(F.count("*").alias("n")).withColumn("storage", F.when(F.col("dimensions") <= 2000, "vector").otherwise("halfvec"))


@query("v07_vector_coverage", "SELECT source, count(*) AS chunks, count(*) FILTER (WHERE vec_id IS NULL) AS missing FROM {documents} LEFT JOIN {embeddings} ON vec_id = doc_id GROUP BY source", "documents", "embeddings")
def v07(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    known = documents.join(embeddings.select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has")), "doc_id", "left")
    return known.groupBy("source").agg(F.count("*").alias("chunks"), F.count_if(F.col("has").isNull()).alias("missing"))


@query("v08_reuse_by_checksum", """SELECT a.doc_id, max(b.doc_id) AS reused_from FROM {documents} a JOIN {documents} b ON md5(a.text) = md5(b.text) AND b.doc_id < a.doc_id GROUP BY 1""", "documents")
def v08(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", F.md5("text").alias("h"))
    earlier = F.lag("doc_id").over(Window.partitionBy("h").orderBy("doc_id"))
    return rows.withColumn("reused_from", earlier).where("reused_from IS NOT NULL").select("doc_id", "reused_from")


_LANES = """a AS (SELECT event_id AS id, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM {events} WHERE event_type = 'click'), b AS (SELECT event_id AS id, row_number() OVER (ORDER BY user_id, event_id) AS rank FROM {events} WHERE value > 20)"""


def _lanes(events: DataFrame) -> dict[str, DataFrame]:
    click, big = events.where("event_type = 'click'"), events.where("value > 20")
    a = ranking.global_position(click, [F.desc("value"), F.col("event_id")], -F.floor("value"), "rank")
    b = ranking.global_position(big, [F.col("user_id"), F.col("event_id")], F.col("user_id"), "rank")
    return {n: df.select(F.col("event_id").alias("id"), "rank", F.lit(0).alias("query_id")) for n, df in (("lexical", a), ("vector", b))}


@query("r01_rank_fusion", f"WITH {_LANES} SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score, min(rank) AS best_rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id", "events")
def r01(events: DataFrame) -> DataFrame:
    return search.reciprocal_rank_fusion(_lanes(events), "id").select("id", F.round("score", 9).alias("score"), "best_rank")


@query("r02_document_fusion", f"""WITH {_LANES}, d AS (SELECT user_id, 'a' AS lane, min(rank) AS rank FROM a JOIN {{events}} ON event_id = id GROUP BY 1 UNION ALL SELECT user_id, 'b', min(rank) FROM b JOIN {{events}} ON event_id = id GROUP BY 1)
  SELECT user_id, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS lanes FROM d GROUP BY 1""", "events")  # fmt: skip
def r02(events: DataFrame) -> DataFrame:
    owner = events.select(F.col("event_id").alias("id"), "user_id")
    lanes = {n: df.join(owner, "id") for n, df in _lanes(events).items()}
    return search.reciprocal_rank_fusion(lanes, "user_id").select("user_id", F.round("score", 9).alias("score"), "lanes")


@query("r04_keyword_rerank", """WITH s AS (SELECT p_partkey, p_name, (p_partkey % 100) / 100.0::DOUBLE AS score FROM {part}) SELECT p_partkey, round(0.35 * score + 0.65 * (contains(p_name, 'blue')::INT + contains(p_name, 'gear')::INT) / 2.0, 9)::DOUBLE AS reranked
  FROM s ORDER BY reranked DESC, p_partkey LIMIT 30""", "part")  # fmt: skip
def r04(part: DataFrame) -> DataFrame:
    scored = part.select("p_partkey", "p_name", (F.col("p_partkey") % 100 / 100.0).alias("score"), F.col("p_partkey").alias("place"))
    hit = F.contains("p_name", F.lit("blue")).cast("int") + F.contains("p_name", F.lit("gear")).cast("int")
    ranked = scored.withColumn("reranked", F.round(0.35 * F.col("score") + 0.65 * hit / 2.0, 9))
    return ranked.orderBy(F.desc("reranked"), "place").limit(30).select("p_partkey", "reranked")


@query("r04_keyword_rerank_groups", None, "part")
def r04_groups(part: DataFrame) -> DataFrame:
    scored = part.select("p_brand", "p_partkey", "p_name", (F.col("p_partkey") % 100 / 100.0).alias("score"), F.col("p_partkey").alias("place"))
    return search.keyword_rerank(scored, F.col("p_name"), ["blue", "gear"], 5, group=["p_brand"]).select("p_brand", "p_partkey", "reranked")


@query("r07_identity_floor", "SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN 'identity' ELSE 'relevance' END AS score_kind FROM {orders}", "orders")
def r07(orders: DataFrame) -> DataFrame:
    return search.with_identity(orders, "o_totalprice").select("o_orderkey", "score_kind")


@query("r13_bounded_context", """SELECT source, doc_id FROM (SELECT source, doc_id, sum(octet_length(encode(text)) + 11) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM {documents}) WHERE used <= 22000""", "documents")
def r13(documents: DataFrame) -> DataFrame:
    return search.within_budget(documents, F.col("text"), ["doc_id"], group=["source"]).select("source", "doc_id")


@query("r15_table_rows_lane", """SELECT p_partkey, round(0.5 + 0.08 * (len(regexp_extract_all(p_name, 'red|ring'))) - 0.0001 * (p_partkey % 500), 9)::DOUBLE AS score FROM {part} WHERE regexp_matches(p_name, 'red|ring')""", "part")
def r15(part: DataFrame) -> DataFrame:
    score = 0.5 + 0.08 * F.regexp_count("p_name", F.lit("red|ring")) - 0.0001 * (F.col("p_partkey") % 500)
    return part.where(F.col("p_name").rlike("red|ring")).select("p_partkey", F.round(score, 9).alias("score"))


@query("r16_section_siblings", """SELECT DISTINCT b.l_orderkey, b.l_linenumber FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_quantity >= 50 AND b.l_linenumber BETWEEN a.l_linenumber - 3 AND a.l_linenumber + 64""", "lineitem")
def r16(lineitem: DataFrame) -> DataFrame:
    anchors = lineitem.where("l_quantity >= 50").select("l_orderkey", (F.col("l_linenumber") - 3).alias("low"), (F.col("l_linenumber") + 64).alias("high"))
    return joins.within_ranges(lineitem, anchors, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber").distinct()


@query("r25_context_balance", """SELECT c_nationkey, CASE WHEN g = 0 OR d = 0 OR abs(g - d) > 2 THEN 'skewed' ELSE 'balanced' END AS status FROM (SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal > 5000) AS g, count(*) FILTER (WHERE c_acctbal <= 5000) AS d FROM {customer} GROUP BY 1)""", "customer")
def r25(customer: DataFrame) -> DataFrame:
    g, d = F.count_if(F.col("c_acctbal") > 5000), F.count_if(F.col("c_acctbal") <= 5000)
    both = customer.groupBy("c_nationkey").agg(g.alias("g"), d.alias("d"))
    return both.select("c_nationkey", F.when((F.col("g") == 0) | (F.col("d") == 0) | (F.abs(F.col("g") - F.col("d")) > 2), "skewed").otherwise("balanced").alias("status"))


@query("r28_answer_verification", """WITH n AS (SELECT greatest(count(*), 1) AS n FROM {benchmark}), l AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS literal FROM {benchmark}),
  e AS (SELECT doc_id % n AS query_id, doc_id, lower(text) AS evidence FROM {documents}, n), c AS (SELECT l.query_id, literal, coalesce(bool_or(contains(evidence, literal)), false) AS ok FROM l LEFT JOIN e USING (query_id) GROUP BY 1, 2),
  v AS (SELECT DISTINCT item_id AS query_id FROM {benchmark} b JOIN e ON e.query_id = b.item_id AND contains(evidence, lower(b.text))), f AS (SELECT query_id FROM e JOIN {labels} USING (doc_id) GROUP BY 1 HAVING min(quality) < max(quality)),
  k AS (SELECT query_id, count(literal) AS literals, count(*) FILTER (WHERE ok) AS supported FROM (SELECT DISTINCT item_id AS query_id FROM {benchmark}) LEFT JOIN c USING (query_id) GROUP BY 1)
  SELECT query_id, literals, supported, CASE WHEN supported < literals THEN 'insufficient_evidence' WHEN query_id IN (SELECT query_id FROM f) THEN 'conflicting' WHEN query_id IN (SELECT query_id FROM v) THEN 'verified'
   WHEN supported > 0 THEN 'partially_supported' ELSE 'not_run' END AS state FROM k""", "benchmark", "documents", "labels")  # fmt: skip
def r28(benchmark: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents are evidence, dealt over all questions; evidence whose labels disagree is conflicting."""
    answers = benchmark.select(F.col("item_id").alias("query_id"), F.lower("text").alias("text"))
    literals = answers.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)))).alias("literal"))
    number = benchmark.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    evidence = documents.join(number).select("doc_id", (F.col("doc_id") % F.col("n")).alias("query_id"), F.col("text").alias("evidence"))
    verbatim = search.grounded(answers.select("query_id", F.col("text").alias("literal")), evidence).where("supported")
    opinions = evidence.join(labels.select("doc_id", "quality"), "doc_id").groupBy("query_id").agg(F.min("quality").alias("a"), F.max("quality").alias("b"))
    return claims.verification_states(answers, search.grounded(literals, evidence), verbatim, opinions.where("a < b"))


def answers(documents: DataFrame) -> DataFrame:
    """``(doc_id, text)``: every document as an answer that states its facts in code, lists and numbers, before its own text."""
    n = F.col("doc_id")
    s = lambda c: c.cast("string")
    lines = [
        F.concat(F.lit("1. Set `n_chars="), s(F.col("n_chars")), F.lit("` in `"), F.col("lang"), F.lit("` since 20"), F.lpad(s(n % 30), 2, "0"), F.lit("-"), F.lpad(s(n % 14), 2, "0"), F.lit("-11.")),
        F.concat(F.lit("2) Version v"), s(n % 4), F.lit("."), s(n % 13), F.lit(".0-rc."), s(n % 3), F.lit(" or V"), s(n % 7), F.lit("; port:80"), s(n % 90 + 10), F.lit(", at 12:30, "), s(n % 100), F.lit("% of a"), s(n), F.lit(" x=-"), s(n % 9), F.lit("/")),
        F.concat(F.lit("```sh\nrun --id "), s(n), F.lit("\n\n  stop\r\n```")),
    ]
    return documents.select("doc_id", F.concat_ws("\n", *lines, "text").alias("text"))


@query("r29_answer_claims", None, "documents")
def r29(documents: DataFrame) -> DataFrame:
    return claims.claims(answers(documents), "doc_id", "text")


@query("r32_best_score_per_chunk", "SELECT l_partkey, max(l_extendedprice) AS score, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) AS l_orderkey FROM {lineitem} GROUP BY 1", "lineitem")
def r32(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_partkey").agg(F.max("l_extendedprice").alias("score"), F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("l_orderkey"))


@query("r02_hybrid_document_search", f"""WITH {_POST}, q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '\\p{{L}}{{3,}}'))) AS token FROM {{benchmark}}), n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1),
  h AS (SELECT query_id, doc_id, round(count(*) / max(n.n) * (1 + 1 / (1 + (max(first_at) - min(first_at)) / 100.0)) * ln(1 + sum(tf)), 9) AS score FROM p JOIN q USING (token) JOIN n USING (query_id) GROUP BY 1, 2),
  s AS (SELECT b.vec_id AS query_id, v.vec_id AS doc_id, {_COS.format('b.embedding', 'v.embedding').replace(', 6)', ', 9)')} AS score FROM {{embeddings}} b JOIN {{embeddings}} v ON b.vec_id IN (SELECT item_id FROM {{benchmark}})),
  l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) FROM s),
  f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, count(*) AS lanes FROM l WHERE rank <= 96 GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM f),
  t AS (SELECT query_id, min(token) AS term FROM q GROUP BY 1)
  SELECT query_id, place::INTEGER AS place, doc_id, round(score, 9) AS score, lanes, substr(text, greatest(greatest(instr(lower(text), coalesce(term, '')), 1) - 80, 1), 280) AS excerpt FROM b JOIN {{documents}} USING (doc_id) LEFT JOIN t USING (query_id) WHERE place <= 10""", "documents", "embeddings", "benchmark")  # fmt: skip
def hybrid(documents: DataFrame, embeddings: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Lexical and vector lanes over all documents, fused, cut to ten documents per question with excerpts."""
    terms = benchmark.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))).alias("token"))
    lexical = search.best_of_any(_words(documents), terms, "doc_id", 96)
    asked = embeddings.join(benchmark.select(F.col("item_id").alias("vec_id")).distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    vector = search.nearest(embeddings, asked, "vec_id", "embedding", 96).withColumnRenamed("vec_id", "doc_id")
    fused = search.reciprocal_rank_fusion({"lexical": lexical, "vector": vector}, "doc_id")
    best = ranking.top_per_group(fused, ["query_id"], [F.desc("score"), F.col("doc_id")], 10, rank="place")
    first = terms.groupBy("query_id").agg(F.min("token").alias("term"))
    best = best.join(first, "query_id", "left")
    # ten rows of a question are held by every task, so that texts aren't moved
    shown = documents.select("doc_id", "text").join(F.broadcast(best) if search.fits(terms) else best, "doc_id")
    return shown.select("query_id", "place", "doc_id", F.round("score", 9).alias("score"), "lanes", search.excerpt(F.col("text"), F.coalesce("term", F.lit(""))).alias("excerpt"))


# ---- titles, versions, topics and excerpts

_NAMED = """d AS (SELECT document_id, library_id, concat(title, CASE WHEN document_id % 3 = 0 THEN concat(' v', document_id % 4, '.', document_id % 7, '.', document_id % 2) ELSE '' END) AS title,
  concat(lower(library_id), '/', lang, '-', document_id % 3, '.', document_id % 5, '.md') AS key FROM {document} WHERE document_state = 'active' AND readable_revision_id IS NOT NULL)"""
_ASKED = """q AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN concat('Doc web part ', item_id % 40) WHEN 1 THEN concat(' "part" ', item_id % 40, ', v', item_id % 3, '.', item_id % 5, ' doc') WHEN 2 THEN concat('1.', item_id % 7, '.0') ELSE '' END AS query FROM {benchmark})"""


def _named(document: DataFrame) -> DataFrame:
    return document.sparkSession.sql(f"WITH {_NAMED} SELECT * FROM d", document=document)


@query("l11_metadata_search", rf"""WITH {_NAMED}, {_ASKED}, l AS (SELECT query_id, lower(trim(query)) AS low FROM q WHERE trim(query) <> ''),
  w AS (SELECT query_id, low, list_filter(list_transform(regexp_split_to_array(low, '\s+'), lambda x: regexp_replace(x, '^[^\p{{L}}\p{{N}}._/-]+|[^\p{{L}}\p{{N}}._/-]+$', '', 'g')), lambda x: length(x) >= 2) AS words FROM l),
  g AS (SELECT query_id, low, list_filter(list_prepend(low, words), lambda x, i: list_position(list_prepend(low, words), x) = i)[1:8] AS generic, list_distinct(regexp_extract_all(low, '[0-9]+(?:\.[0-9]+)+')) AS found FROM w),
  t AS (SELECT query_id, generic, list_filter(found, lambda v: len(string_split(v, '.')) BETWEEN 2 AND 4 AND (len(string_split(v, '.')) > 2 OR len(list_filter(regexp_split_to_array(low, '[^\p{{L}}\p{{N}}_/-]+'), lambda x: length(x) >= 2 AND regexp_matches(x, '\p{{L}}'))) > 0)) AS version FROM g),
  s AS (SELECT query_id, document_id, title, key, list_contains(generic, lower(title)) AS et, list_contains(generic, lower(key)) AS ek, len(list_filter(version, lambda v: contains(lower(title), v))) AS vt, len(list_filter(version, lambda v: contains(lower(key), v))) AS vk,
    len(list_filter(generic, lambda v: contains(lower(title), v))) AS pt, len(list_filter(generic, lambda v: contains(lower(key), v))) AS pk, regexp_extract(title, '([0-9]+)\.([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?', ['a', 'b', 'c', 'e']) AS p FROM d, t),
  r AS (SELECT query_id, document_id, CASE WHEN et THEN 1400 WHEN ek THEN 1380 WHEN vt > 0 THEN 1320 WHEN vk > 0 THEN 1280 WHEN pt > 0 THEN 70 + 80 * least(pt, 4) ELSE 65 + 75 * least(pk, 4) END::DOUBLE AS score,
    CASE WHEN et THEN title WHEN ek THEN key WHEN vt > 0 THEN title WHEN vk > 0 THEN key WHEN pt > 0 THEN title ELSE key END AS matched, coalesce(try_cast(p.a AS BIGINT), -1) AS a, coalesce(try_cast(p.b AS BIGINT), -1) AS b, coalesce(try_cast(p.c AS BIGINT), -1) AS c, coalesce(try_cast(p.e AS BIGINT), -1) AS e
    FROM s WHERE et OR ek OR vt + vk + pt + pk > 0)
  SELECT query_id, document_id, score, matched, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, a DESC, b DESC, c DESC, e DESC, document_id DESC) AS rank FROM r) WHERE rank <= 20""", "document", "benchmark")  # fmt: skip
def l11(document: DataFrame, benchmark: DataFrame) -> DataFrame:
    questions = benchmark.sparkSession.sql(f"WITH {_ASKED} SELECT * FROM q", benchmark=benchmark)
    return metadata.metadata_search(_named(document), questions)


@query("r18_latest_versions", f"""WITH {_NAMED}, v AS (SELECT *, regexp_extract(title, ' v([0-9.]+)$', 1) AS version FROM d WHERE document_id % 3 = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY split_part(version, '.', 1)::INT DESC, split_part(version, '.', 2)::INT DESC, split_part(version, '.', 3)::INT DESC, document_id) AS document_rank FROM v),
  c AS (SELECT doc_id, i AS chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM {{documents}}) WHERE trim(t, ' ') <> '')
  SELECT library_id, document_id, version, document_rank::INTEGER AS document_rank, chunk_index, (100 + greatest(5 - r, 1) * 10 - (document_rank - 1))::DOUBLE AS score FROM k JOIN c ON doc_id = document_id WHERE document_rank <= 10 AND r <= 4""", "document", "documents")  # fmt: skip
def r18(document: DataFrame, documents: DataFrame) -> DataFrame:
    chunks = blocks.line_chunks(documents).select(F.col("doc_id").alias("document_id"), "chunk_index")
    return metadata.latest_versions(_named(document), chunks, ["library_id"], count=10, floor=100.0)


_TOPICS = """h AS (SELECT document_id % 50 AS query_id, document_id, concat(CASE document_id % 5 WHEN 0 THEN 'Workflow' WHEN 1 THEN 'workflows' WHEN 2 THEN 'Network' ELSE 'General' END, ' guide ', document_id % 50) AS title, CASE WHEN document_id % 17 = 0 THEN 0.95 ELSE 0.01 END::DOUBLE AS score FROM {document}),
  q AS (SELECT document_id AS query_id, CASE document_id % 3 WHEN 0 THEN 'Which workflaw guide?' WHEN 1 THEN 'general networt guides' ELSE concat('guide ', document_id) END AS query FROM {document} WHERE document_id < 50)"""


@query("r12_topic_pruning", f"""WITH {_TOPICS}, t AS (SELECT query_id, document_id, unnest(list_distinct(regexp_split_to_array(lower(title), '[^a-z0-9]+'))) AS w FROM h), a AS (SELECT query_id, unnest(list_distinct(regexp_split_to_array(lower(query), '[^a-z0-9]+'))) AS q FROM q),
  n AS (SELECT DISTINCT query_id, q, document_id FROM a JOIN t USING (query_id) WHERE length(q) >= 2 AND length(w) >= 2 AND (q = w OR (length(q) >= 5 AND length(w) >= 5 AND q[1] = w[1] AND levenshtein(q, w) <= 1))),
  c AS (SELECT query_id, count(DISTINCT document_id) AS n FROM h GROUP BY 1), k AS (SELECT query_id, q FROM n GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) < (SELECT any_value(c.n) FROM c WHERE c.query_id = n.query_id) AND (SELECT any_value(c.n) FROM c WHERE c.query_id = n.query_id) >= 3)
  SELECT query_id, document_id, title, score FROM h WHERE query_id NOT IN (SELECT query_id FROM k) OR score >= 0.9 OR EXISTS (SELECT 1 FROM n JOIN k USING (query_id, q) WHERE n.query_id = h.query_id AND n.document_id = h.document_id)""", "document")  # fmt: skip
def r12(document: DataFrame) -> DataFrame:
    hits, questions = (document.sparkSession.sql(f"WITH {_TOPICS} SELECT * FROM {t}".replace("0.95 ELSE 0.01 END::DOUBLE", "CAST(0.95 AS DOUBLE) ELSE CAST(0.01 AS DOUBLE) END"), document=document) for t in "hq")
    return metadata.prune_topic(hits, questions)


@query("l19_focused_excerpt", None, "documents", "benchmark")
def l19(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document for the words of the question that it is dealt to."""
    number = benchmark.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    words = benchmark.select(F.col("item_id").alias("q"), F.split("text", " ").alias("keywords"))
    dealt = documents.join(number).withColumn("q", F.col("doc_id") % F.col("n")).join(words, "q", "left")
    return search.focused_excerpts(dealt, F.col("keywords"), 280)


# ---- lanes of chunks, blocks, entities and relations, and their fusion

_SIMILARITY = f"(len(list_intersect({_TRIGRAMS.format('{0}')}, {_TRIGRAMS.format('{1}')})) / greatest(len(list_distinct(list_concat({_TRIGRAMS.format('{0}')}, {_TRIGRAMS.format('{1}')}))), 1))"

_LINED = """c AS (SELECT doc_id * 1000000 + i AS chunk_id, doc_id AS document_id, i AS chunk_index, t AS text, lang AS heading, source AS section, 0.5 + (doc_id % 5) / 10.0 AS quality
  FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM {documents}) WHERE trim(t, ' ') <> '')"""
_FILED = "d AS (SELECT document_id, title, concat(lower(library_id), '-', document_id % 90, '.md') AS file_name FROM {document} WHERE document_state = 'active' AND readable_revision_id IS NOT NULL)"
_POSED = """q AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN concat('Doc part ', item_id % 30 + 10) WHEN 1 THEN concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2)) WHEN 2 THEN concat(split_part(text, ' ', 3), ' web part') ELSE 'webmaster documents' END AS query FROM {benchmark})"""
_WORDS = """t AS (SELECT query_id, list_filter(regexp_split_to_array(lower(query), '[^\\p{L}\\p{N}_/]+'), lambda x: length(x) >= 3) AS w, list_filter(regexp_split_to_array(lower(query), '[^\\p{L}\\p{N}._/-]+'), lambda x: length(x) >= 2 AND regexp_matches(x, '[0-9]')) AS n FROM q),
  u AS (SELECT query_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS terms, list_filter(n, lambda x, i: list_position(n, x) = i) AS numbers FROM t),
  v AS (SELECT *, list_transform(list_sort(list_transform(list_filter(terms, lambda x: length(x) >= 8), lambda x: {'n': -length(x), 't': x})), lambda y: y.t)[1:4] AS longest, CASE WHEN len(numbers) > 0 THEN numbers WHEN len(terms) <= 6 THEN terms ELSE [] END AS names FROM u)"""


def _posed(benchmark: DataFrame) -> DataFrame:
    return benchmark.sparkSession.sql(f"WITH {_POSED} SELECT * FROM q", benchmark=benchmark)


@query("l03_question_terms", f"WITH {_POSED}, {_WORDS} SELECT query_id, array_to_string(terms, ' ') AS terms, array_to_string(longest, ' ') AS longest, array_to_string(names, ' ') AS name FROM v", "benchmark")
def l03(benchmark: DataFrame) -> DataFrame:
    t = lanes.question_terms(F.col("query"))
    return _posed(benchmark).select("query_id", *[F.array_join(t[c], " ").alias(c) for c in ("terms", "longest", "name")])


_HIT = """k AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(array_to_string(terms, ' '), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS token FROM v), m AS (SELECT query_id, count(*) AS n FROM k GROUP BY 1),
  x AS (SELECT id, token, count(*) AS tf, min(i) AS first_at FROM (SELECT id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS i FROM (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda y: y <> '') AS w FROM rows_)) WHERE token IN (SELECT token FROM k) GROUP BY 1, 2),
  s AS (SELECT query_id, id, (1 + 1 / (1 + (max(first_at) - min(first_at)) / 100.0)) * ln(1 + sum(tf)) AS score FROM x JOIN k USING (token) JOIN m USING (query_id) GROUP BY query_id, id HAVING count(*) = max(n))"""
_BEST = "SELECT query_id, id AS {0}, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 50"


@query("l01_chunk_lane", f"""WITH {_LINED}, {_FILED}, {_POSED}, {_WORDS}, rows_ AS (SELECT chunk_id AS id, text FROM c), {_HIT},
  f AS (SELECT *, lower(title || ' ' || file_name) AS name FROM d), b AS (SELECT query_id, document_id, CASE WHEN len(names) > 0 AND len(list_filter(names, lambda y: CASE WHEN regexp_matches(y, '[0-9]') THEN contains(' ' || name || ' ', ' ' || y || ' ') ELSE contains(name, y) END)) = len(names) THEN 'named'
     WHEN len(list_filter(terms, lambda y: contains(name, y))) > 0 OR len(list_filter(longest, lambda y: greatest({_SIMILARITY.format("title", "y")}, {_SIMILARITY.format("file_name", "y")}) >= 0.3)) > 0 THEN 'nearly' END AS kind, len(terms) AS k FROM v, f),
  l AS (SELECT s.query_id, c.chunk_id, c.document_id, score * CASE WHEN kind = 'named' THEN 8 WHEN kind = 'nearly' THEN 2 WHEN len(list_filter(terms, lambda y: contains(lower(heading), y))) > 0 THEN 3 ELSE 1 END * CASE WHEN len(list_filter(terms, lambda y: contains(lower(section), y))) > 0 THEN 1.5 ELSE 1 END * quality AS score
     FROM s JOIN c ON c.chunk_id = s.id JOIN v USING (query_id) LEFT JOIN b ON b.query_id = s.query_id AND b.document_id = c.document_id),
  g AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY (1000000 - chunk_index) * quality DESC, chunk_index) AS r, row_number() OVER (PARTITION BY document_id ORDER BY (50 - 0.001 * chunk_index) * quality DESC, chunk_index) AS r2 FROM c),
  a AS (SELECT * FROM l UNION ALL SELECT query_id, chunk_id, document_id, (1000000 - chunk_index) * quality FROM b JOIN g USING (document_id) WHERE kind = 'named' AND r <= 2
     UNION ALL SELECT query_id, chunk_id, document_id, (50 - 0.001 * chunk_index) * quality FROM b JOIN g USING (document_id) WHERE kind = 'nearly' AND k <= 6 AND r2 <= 2),
  e AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, chunk_id) AS r FROM a), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM e WHERE r <= 2)
  SELECT query_id, chunk_id, document_id, round(score, 6)::DOUBLE AS score, rank::INTEGER AS rank FROM z WHERE rank <= 50""", "documents", "document", "benchmark")  # fmt: skip
def l01_chunks(documents: DataFrame, document: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Lines as chunks, languages as headings, sources as sections."""
    lines = blocks.line_chunks(documents, carry=["lang", "source"])
    chunks = lines.select(
        (F.col("doc_id") * 1_000_000 + F.col("chunk_index")).alias("chunk_id"), F.col("doc_id").alias("document_id"), "chunk_index", F.col("content_text").alias("text"), F.col("lang").alias("heading"), F.col("source").alias("section"),
        (0.5 + (F.col("doc_id") % 5) / 10.0).alias("quality"),
    )
    filed = document.sparkSession.sql(f"WITH {_FILED} SELECT * FROM d", document=document)
    found = lanes.chunk_lane(chunks, filed, _posed(benchmark))
    return found.withColumn("score", F.round("score", 6))


@query("l05_block_lane", f"WITH {_LINED}, {_POSED}, {_WORDS}, rows_ AS (SELECT chunk_id AS id, text FROM c), {_HIT} {_BEST.format('block_id')}", "documents", "benchmark")
def l05(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows = blocks.line_chunks(documents).select((F.col("doc_id") * 1_000_000 + F.col("chunk_index")).alias("block_id"), "content_text")
    return lanes.text_lane(rows, _posed(benchmark), "block_id", F.col("content_text")).withColumn("score", F.round("score", 6))


_SOUGHT = "q AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'red widget' WHEN 1 THEN concat('Customer ', lpad(CAST(item_id AS VARCHAR(20)), 9, '0')) ELSE 'person bought' END AS query FROM {benchmark})"


@query("l07_entity_lane", f"WITH {_SOUGHT}, {_WORDS}, rows_ AS (SELECT node_id AS id, label || ' ' || node_type AS text FROM {{node}}), {_HIT} {_BEST.format('node_id')}", "node", "benchmark")
def l07(node: DataFrame, benchmark: DataFrame) -> DataFrame:
    asked = benchmark.sparkSession.sql(f"WITH {_SOUGHT} SELECT * FROM q", benchmark=benchmark)
    return lanes.text_lane(node, asked, "node_id", F.concat_ws(" ", "label", "node_type")).withColumn("score", F.round("score", 6))


@query("l08_relation_lane", f"WITH {_SOUGHT}, {_WORDS}, rows_ AS (SELECT from_node_id || '--' || relation_type || '--' || to_node_id AS id, replace(from_node_id || ' ' || relation_type || ' ' || to_node_id, '_', ' ') AS text FROM {{edge}}), {_HIT} {_BEST.format('edge_key')}", "edge", "benchmark")
def l08(edge: DataFrame, benchmark: DataFrame) -> DataFrame:
    asked = benchmark.sparkSession.sql(f"WITH {_SOUGHT} SELECT * FROM q", benchmark=benchmark)
    rows = edge.select(F.concat_ws("--", "from_node_id", "relation_type", "to_node_id").alias("edge_key"), F.replace(F.concat_ws(" ", "from_node_id", "relation_type", "to_node_id"), F.lit("_"), F.lit(" ")).alias("text"))
    # an edge's key is its text: edges of the sought relation are distinct, and no others hold what is asked
    return lanes.text_lane(rows, asked, "edge_key", F.col("text"), 50, True).withColumn("score", F.round("score", 6))


_TYPED = """e AS (SELECT event_id AS id, user_id % 20 AS query_id, user_id, value, event_type FROM {events}),
  a AS (SELECT id, query_id, CASE WHEN id % 97 = 0 THEN 200000 + value ELSE value END AS score, CASE WHEN id % 31 = 0 THEN 'query_ir_focus' ELSE 'relevance' END AS kind, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, id) AS rank FROM e WHERE event_type <> 'view'),
  b AS (SELECT id, query_id, value * 3 AS score, CASE WHEN id % 41 = 0 THEN 'content_anchor' ELSE 'relevance' END AS kind, row_number() OVER (PARTITION BY query_id ORDER BY user_id, id) AS rank FROM e WHERE event_type <> 'click')"""


@query("r01_typed_fusion", f"""WITH {_TYPED}, u AS (SELECT *, 0 AS lane, 'relevance' AS own FROM a UNION ALL SELECT *, 1, 'graph_evidence' FROM b), k AS (SELECT *, CASE WHEN kind <> 'relevance' THEN kind WHEN score >= 100000 THEN 'document_identity' ELSE own END AS k FROM u),
  p AS (SELECT *, CASE k WHEN 'relevance' THEN 0 WHEN 'graph_evidence' THEN 1 WHEN 'query_ir_focus' THEN 2 WHEN 'document_identity' THEN 3 ELSE 4 END AS p FROM k),
  f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, max(score) AS best, arg_min(k, (-p, lane, rank)) AS kind, max(p) AS p FROM p GROUP BY 1, 2), s AS (SELECT query_id, id, kind, p, CASE WHEN kind = 'relevance' THEN rrf ELSE best END AS score FROM f)
  SELECT query_id, id, kind, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, score DESC, id)::INTEGER AS place FROM s""", "events")  # fmt: skip
def r01_typed(events: DataFrame) -> DataFrame:
    a, b = (events.sparkSession.sql(f"WITH {_TYPED} SELECT * FROM {t}", events=events) for t in "ab")
    return lanes.fuse_typed(a, b, "graph_evidence").withColumn("score", F.round("score", 9))


@query("r03_entity_fusion", """WITH n AS (SELECT node_id, node_type, label, support_count, length(label) % 7 AS query_id FROM {node}), a AS (SELECT *, support_count / 10.0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY support_count DESC, node_id) AS rank FROM n WHERE node_type <> 'location'),
  b AS (SELECT *, 1.0 * support_count AS score, row_number() OVER (PARTITION BY query_id ORDER BY label, node_id) AS rank FROM n WHERE node_type <> 'person'), u AS (SELECT *, 0 AS lane FROM a UNION ALL SELECT *, 1 FROM b),
  f AS (SELECT query_id, node_id, sum(1.0::DOUBLE / (60 + rank)) AS score, max(lane) AS lane, max(score) AS raw, any_value(node_type) AS node_type, any_value(label) AS label FROM u GROUP BY 1, 2)
  SELECT query_id, node_id, round(score, 9) AS score, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, lane DESC, raw DESC, node_type, label, node_id) AS place FROM f) WHERE place <= 40""", "node")  # fmt: skip
def r03(node: DataFrame) -> DataFrame:
    n = node.withColumn("query_id", F.length("label") % 7)
    ranked = lambda df, score, order: df.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    vector = ranked(n.where("node_type <> 'location'"), F.col("support_count") / 10.0, [F.desc("support_count"), F.col("node_id")])
    lexical = ranked(n.where("node_type <> 'person'"), F.col("support_count") * 1.0, [F.col("label"), F.col("node_id")])
    return lanes.fuse_entities(vector, lexical, 40).withColumn("score", F.round("score", 9))


_CITED = """q AS (SELECT item_id AS query_id, concat('find "', split_part(text, ' ', 4), ' ', split_part(text, ' ', 5), '; ', split_part(text, ' ', 6), '" or ', chr(39), split_part(text, ' ', 2), ' the', chr(39), ' x') AS query FROM {benchmark})"""


@query("r23_content_anchors", f"""WITH {_CITED}, {_WORDS}, rows_ AS (SELECT doc_id AS id, text FROM {{documents}}), k AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(array_to_string(terms, ' '), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS token FROM v),
  w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda y: y <> '') AS w FROM rows_), x AS (SELECT DISTINCT id, unnest(w) AS token FROM w), m AS (SELECT query_id, id, count(*) AS matched FROM x JOIN k USING (token) GROUP BY 1, 2 HAVING count(*) >= 2),
  f AS (SELECT query_id, unnest([regexp_extract(query, '"([^"]*)"', 1), regexp_extract(query, chr(39) || '([^' || chr(39) || ']*)' || chr(39), 1)]) AS s FROM q), g AS (SELECT DISTINCT query_id, list_filter(regexp_split_to_array(lower(s), '[^\\p{{L}}\\p{{N}}]+'), lambda y: y <> '') AS p FROM f),
  j AS (SELECT id, ' ' || array_to_string(w, ' ') || ' ' AS line FROM w), c AS (SELECT query_id, id, count(*) AS quoted FROM g JOIN j ON len(p) >= 2 AND contains(line, ' ' || array_to_string(p, ' ') || ' ') GROUP BY 1, 2),
  z AS (SELECT query_id, id, coalesce(quoted, 0) AS quoted, coalesce(matched, 0) AS matched FROM m FULL JOIN c USING (query_id, id))
  SELECT query_id, id AS doc_id, quoted, matched, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY quoted DESC, matched DESC, id) AS rank FROM z) WHERE rank <= 50""", "documents", "benchmark")  # fmt: skip
def r23(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    asked = benchmark.sparkSession.sql(f"WITH {_CITED} SELECT * FROM q", benchmark=benchmark)
    return lanes.content_anchors(documents.select("doc_id", "text"), asked, "doc_id", F.col("text"))
