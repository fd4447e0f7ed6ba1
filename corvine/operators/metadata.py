"""Search by titles and keys, the latest versions of document families, and answers about one topic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import release_versions, version_terms
from .filters import near_token
from .ranking import top_per_group

#: Terms of a question, and bytes of terms that a task tests a name against at a time.
TERMS, TERM_BYTES = 8, 1 << 20
#: Scores: a name itself (title, key), a version in it, and other terms in it (base, each of up to four). Fixed values.
EXACT, VERSION, PARTS = (1400.0, 1380.0), (1320.0, 1280.0), ((70.0, 80.0), (65.0, 75.0))
#: Chunks of a document in a list of versions, versions asked for by default and at most. Fixed values.
CHUNKS, VERSIONS, MOST_VERSIONS = 4, 10, 20
#: A score from which a hit was meant to stay, and documents from which a topic can be told. Fixed values.
MEANT, FAMILY = 0.9, 3


def metadata_terms(query: Column) -> Column:
    """A struct of ``generic`` terms (the query itself, then its words, ``TERMS`` in all) and ``version`` terms, lower case.

    A version of two parts counts only beside a word.
    """
    low = F.lower(F.trim(query))
    edge = r"[^\p{L}\p{N}._\-/\\]+"
    words = F.transform(F.split(low, r"\s+"), lambda w: F.regexp_replace(w, f"^{edge}|{edge}$", ""))
    generic = F.slice(F.array_distinct(F.concat(F.array(low), F.filter(words, lambda w: F.length(w) >= 2))), 1, TERMS)
    beside = F.exists(F.split(low, r"[^\p{L}\p{N}_\-/]+"), lambda w: (F.length(w) >= 2) & w.rlike(r"\p{L}"))
    version = F.filter(version_terms(low), lambda v: (F.regexp_count(v, F.lit(r"\.")) >= 2) | beside)
    none = F.array().cast("array<string>")
    return F.struct(F.when(low != "", generic).otherwise(none).alias("generic"), F.when(low != "", version).otherwise(none).alias("version"))


def title_version(title: Column) -> Column:
    """The first dotted number of a title as four numbers, missing ones -1."""
    at = lambda i: F.coalesce(F.regexp_extract(title, r"([0-9]+)\.([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?", i).try_cast("bigint"), F.lit(-1).cast("bigint"))
    return F.array(*[at(i) for i in (1, 2, 3, 4)])


def metadata_search(documents: DataFrame, questions: DataFrame, limit: int = 20, id_col: str = "document_id") -> DataFrame:
    """``(query_id, id, score, matched, rank)``: documents whose title or key holds terms of each question, best first.

    ``documents``: (id, title, key); ``questions``: (query_id, query).  Ties go to the higher version in the title, then the larger id.
    Different names are tested once each, against blocks of all questions' terms of bounded size; questions meet hits by equality of the term, and
    those of the same terms find the same documents, so one of them is searched for.  A score is one of names: a question meets its best names, then their last documents.
    """
    lowered = [F.lower(F.coalesce(c, F.lit(""))).alias(n) for c, n in (("title", "_t"), ("key", "_k"))]
    said = questions.select("query_id", metadata_terms(F.col("query")).alias("m"))
    same = said.groupBy("m").agg(F.min("query_id").alias("one"), F.collect_list("query_id").alias("ids"))
    kinds = [same.select("one", F.lit(kind).alias("kind"), F.explode(f"m.{kind}").alias("term")) for kind in ("generic", "version")]
    terms = kinds[0].unionByName(kinds[1])
    distinct = terms.select("term").distinct()
    blocks = max(1, -(-(distinct.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0) // TERM_BYTES))
    held = distinct.groupBy(F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list("term").alias("all"))
    heads = documents.groupBy("title", "key").agg(F.max(id_col).alias("_head")).select("title", "key", "_head", *lowered)
    names = heads.select("_t", "_k").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    hits = names.join(held, "block").select("_t", "_k", F.explode(F.filter("all", lambda x: F.contains(F.col("_t"), x) | F.contains(F.col("_k"), x))).alias("term"))
    each = hits.join(terms, "term").groupBy("one", "_t", "_k")
    generic, version = F.col("kind") == "generic", F.col("kind") == "version"
    inside = lambda name: F.contains(F.col(name), F.col("term"))
    of = lambda name: {"exact": F.bool_or(generic & (F.col(name) == F.col("term"))), "version": F.bool_or(version & inside(name)), "parts": F.count_if(generic & inside(name))}
    found = each.agg(*[c.alias(f"{k}{name}") for name in ("_t", "_k") for k, c in of(name).items()])
    score, matched = F, F
    for kind, values in (("exact", EXACT), ("version", VERSION), ("parts", PARTS)):
        for name, shown, value in zip(("_t", "_k"), ("title", "key"), values, strict=True):
            col = F.col(f"{kind}{name}")
            given = value[0] + value[1] * F.least(col, F.lit(4)) if kind == "parts" else F.lit(value)
            score = score.when(col > 0 if kind == "parts" else col, given)
            matched = matched.when(col > 0 if kind == "parts" else col, F.col(shown))
    versioned = heads.withColumn("v", title_version(F.coalesce("title", "key")))
    scored = found.join(versioned, ["_t", "_k"]).select("one", "title", "key", "_head", score.alias("score"), F.coalesce(matched, "key").alias("matched"), "v")
    # a name behind as many whose last documents come first gives no row of the answer, nor does a document behind as many of its name
    best = top_per_group(scored, ["one"], [F.desc("score"), F.desc("v"), F.desc("_head")], limit)
    wanted = best.select("title", "key").distinct().withColumnsRenamed({"title": "_title", "key": "_key"})
    alike = F.col("title").eqNullSafe(F.col("_title")) & F.col("key").eqNullSafe(F.col("_key"))
    last = top_per_group(documents.select(id_col, "title", "key").join(wanted, alike, "left_semi"), ["title", "key"], [F.desc(id_col)], limit).withColumnsRenamed({"title": "_title", "key": "_key"})
    every = top_per_group(best.join(last, alike).select("one", id_col, "score", "matched", "v"), ["one"], [F.desc("score"), F.desc("v"), F.desc(id_col)], limit, rank="rank").drop("v")
    return every.join(same.select("one", F.explode("ids").alias("query_id")), "one").select("query_id", id_col, "score", "matched", "rank")


def latest_versions(documents: DataFrame, chunks: DataFrame, group: Sequence[str], count: int = VERSIONS, floor: float = 0.0, id_col: str = "document_id") -> DataFrame:
    """Per group the documents of the highest versions in their titles, with the first chunks of each.

    ``(group, id, version, document_rank, chunk_index, score)``: titles with a release version (``release_versions``) that doesn't
    say from which to which; ``count`` is kept between 1 and ``MOST_VERSIONS``.  Scores stand above ``floor``: first chunks of all documents, then second ones.
    """
    count = min(max(count, 1), MOST_VERSIONS)
    found = documents.withColumn("version", F.get(release_versions(F.col("title")), F.lit(0))).where(F.col("version").isNotNull() & ~F.col("title").rlike("->|=>|→|⇒"))
    parts = F.transform(F.split("version", r"\."), lambda p: p.cast("bigint"))
    best = top_per_group(found.withColumn("_v", parts), group, [F.desc("_v"), F.col(id_col)], count, rank="document_rank").drop("_v")
    first = top_per_group(chunks.select(id_col, "chunk_index"), [id_col], [F.col("chunk_index")], CHUNKS, rank="_r")
    score = floor + F.greatest(F.lit(CHUNKS) - (F.col("_r") - 1), F.lit(1)) * count - (F.col("document_rank") - 1)
    return best.join(first, id_col).select(*group, id_col, "version", "document_rank", "chunk_index", score.cast("double").alias("score"))


def prune_topic(hits: DataFrame, questions: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Hits without the tail outside the question's topic, where titles show one.

    ``hits``: (query_id, id, title, score, ...); ``questions``: (query_id, query).  A word of the question that is near a word of two or more titles, but
    not of all (of three documents or more), names a topic.  Then hits stay whose title has such a word or whose score is ``MEANT`` or more; without
    a topic, and where nothing would stay, all do.  Words meet by question and first letter.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2))
    spelt = lambda df, c, keys: df.select(*keys, F.explode(words(F.col(c))).alias("w")).withColumn("c", F.substring("w", 1, 1))
    titles = spelt(hits.select("query_id", id_col, "title").distinct(), "title", ["query_id", id_col])
    asked = spelt(questions, "query", ["query_id"]).distinct().withColumnRenamed("w", "q")
    near = asked.join(titles, ["query_id", "c"]).where(near_token(F.col("q"), F.col("w"))).select("query_id", "q", id_col).distinct()
    total = hits.groupBy("query_id").agg(F.count_distinct(id_col).alias("n"))
    topic = near.groupBy("query_id", "q").agg(F.count("*").alias("k")).join(total, "query_id").where((F.col("n") >= FAMILY) & (F.col("k") >= 2) & (F.col("k") < F.col("n")))
    inside = near.join(topic.select("query_id", "q"), ["query_id", "q"], "left_semi").select("query_id", id_col).distinct()
    pruned = topic.select("query_id").distinct().withColumn("_topic", F.lit(True))
    marked = hits.join(inside.withColumn("_in", F.lit(True)), ["query_id", id_col], "left").join(pruned, "query_id", "left")
    # two documents or more are inside every topic, so something always stays
    return marked.where(F.col("_topic").isNull() | F.col("_in") | (F.coalesce("score", F.lit(0.0)) >= MEANT)).drop("_topic", "_in")
