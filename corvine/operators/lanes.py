"""The lexical lane of chunks with what titles and headings add, typed fusion of lanes, and the terms of a question.

All questions are answered at once.  Names and terms are tested in blocks of bounded size (``met``), each different name
once; everything else meets by equality.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import trigram_similarity
from .metadata import TERM_BYTES
from .ranking import top_per_group
from .search import IDENTITY_SCORE, RRF_K, all_terms, apart, best_where_they_lie, fits, lexical_lane, words

#: Longest terms that titles are compared with, and their least length; the most terms that name a title. Fixed values.
NGRAMS, NGRAM_LENGTH, IDENTITY_TERMS = 4, 8, 6
#: Boosts of a chunk: its document is named, or nearly; its heading holds a term; its section does. Fixed values.
NAMED, NEARLY, HEADING, SECTION = 8.0, 2.0, 3.0, 1.5
#: Scores of the first chunks of documents that are named, or nearly, less a share of their place. Fixed values.
NAMED_FIRST, NEARLY_FIRST = (1_000_000.0, 1.0), (50.0, 0.001)
#: Trigram similarity from which a name is nearly a term, and chunks of one document in an answer. Fixed values.
SIMILAR, PER_DOCUMENT = 0.3, 2
#: Kinds of scores: those of higher priority come first, whatever their score. Fixed values.
PRIORITY = {
    "relevance": 0, "entity_bio": 1, "graph_evidence": 1, "source_context": 1, "focused_document": 1, "query_ir_focus": 2, "document_identity": 3, "latest_version": 3, "content_anchor": 4,
}


def question_terms(query: Column) -> Column:
    """A struct of a question's ``terms``, the ``longest`` of them, and those that would ``name`` a title, all in lower case.

    Terms are runs of letters, digits, ``_`` and ``/`` of three or more, each once.  Tokens with digits name a title; without such, all terms
    do, unless they are over ``IDENTITY_TERMS``.
    """
    low = F.lower(F.coalesce(query, F.lit("")))
    terms = F.array_distinct(F.filter(F.split(low, r"[^\p{L}\p{N}_/]+"), lambda t: F.length(t) >= 3))
    longest = F.array_sort(F.transform(F.filter(terms, lambda t: F.length(t) >= NGRAM_LENGTH), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    numbers = F.array_distinct(F.filter(F.split(low, r"[^\p{L}\p{N}._/-]+"), lambda t: (F.length(t) >= 2) & t.rlike("[0-9]")))
    name = F.when(F.size(numbers) > 0, numbers).when(F.size(terms) <= IDENTITY_TERMS, terms).otherwise(F.array().cast("array<string>"))
    return F.struct(terms.alias("terms"), F.slice(F.transform(longest, lambda x: x["t"]), 1, NGRAMS).alias("longest"), name.alias("name"))


def met(names: DataFrame, terms: DataFrame, test: Callable[[Column, Column], Column]) -> DataFrame:
    """``(name, term)``: which different names hold which terms, by ``test`` (name, term), in blocks of ``TERM_BYTES`` of terms."""
    every = terms.select("term").distinct()
    blocks = max(1, -(-(every.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0) // TERM_BYTES))
    held = every.groupBy(F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list("term").alias("all"))
    asked = names.select("name").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return asked.join(held, "block").select("name", F.explode(F.filter("all", lambda t: test(F.col("name"), t))).alias("term"))


def _stands_in(name: Column, term: Column) -> Column:
    """A term with digits must stand between blanks."""
    blank = F.lit(" ")
    return F.when(term.rlike("[0-9]"), F.contains(F.concat(blank, name, blank), F.concat(blank, term, blank))).otherwise(F.contains(name, term))


def chunk_lane(chunks: DataFrame, documents: DataFrame, questions: DataFrame, limit: int = 50) -> DataFrame:
    """``(query_id, chunk_id, document_id, score, rank)``: the best chunks for each question.

    ``chunks``: (chunk_id, document_id, chunk_index, text, heading, section, quality); ``documents``: (document_id, title, file_name);
    ``questions``: (query_id, query).  Chunks that hold all terms have their lexical score times boosts and quality.  The first
    chunks of documents that all naming terms name come before all, those of nearly named ones with a small score (for short questions).  A document has at most
    ``PER_DOCUMENT`` chunks; ties go to the smaller id.  Questions of the same terms find the same chunks: one of them is searched for.
    """
    each = questions.select("query_id", question_terms(F.col("query")).alias("t"))
    same = each.groupBy("t").agg(F.min("query_id").alias("one"), F.collect_list("query_id").alias("ids"))
    asked = same.select(F.col("one").alias("query_id"), "t.*")
    of = lambda field: asked.select("query_id", F.explode(field).alias("term"))
    name = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("file_name", F.lit(""))))
    named = documents.select("document_id", name.alias("name"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "file_name")])

    whole = met(named, of("name"), _stands_in).join(of("name"), "term").groupBy("query_id", "name").agg(F.count("*").alias("n"))
    identity = whole.join(asked.select("query_id", F.size("name").alias("k")), "query_id").where("n = k").select("query_id", "name")
    inside = met(named, of("terms"), lambda n, t: F.contains(n, t)).join(of("terms"), "term").select("query_id", "name")
    alike = named.select("name", F.explode(F.array("title", "file_name")).alias("part")).distinct()
    near = met(alike.select(F.col("part").alias("name")), of("longest"), lambda n, t: trigram_similarity(n, t) >= SIMILAR).withColumnRenamed("name", "part")
    near = near.join(of("longest"), "term").join(alike, "part").select("query_id", "name")
    soft = inside.unionByName(near).distinct().join(identity, ["query_id", "name"], "left_anti")
    kinds = identity.withColumn("kind", F.lit("named")).unionByName(soft.withColumn("kind", F.lit("nearly")))
    tokens = asked.select("query_id", F.explode("terms").alias("term")).select("query_id", F.explode(F.filter(F.split("term", r"[^\p{L}\p{N}]+"), lambda t: t != "")).alias("token")).distinct()
    few = fits(tokens)
    found = all_terms(words(chunks, "chunk_id", F.col("text"), "document_id", "heading", "section", "quality"), tokens, "chunk_id")
    said = asked.select("query_id", "terms")
    holds = lambda c: F.exists("terms", lambda t: F.contains(F.lower(F.coalesce(c, F.lit(""))), t))
    found = found.join(F.broadcast(said) if few else said, "query_id").select("query_id", "chunk_id", "document_id", "score", "quality", holds("heading").alias("_heading"), holds("section").alias("_section"))
    found = found.join(named.select("document_id", "name"), "document_id", "left").join(kinds, ["query_id", "name"], "left")
    boost = F.when(F.col("kind") == "named", NAMED).when(F.col("kind") == "nearly", NEARLY).when(F.col("_heading"), HEADING).otherwise(1.0)
    score = F.col("score") * boost * F.when(F.col("_section"), SECTION).otherwise(1.0) * F.coalesce("quality", F.lit(1.0))
    text = found.select("query_id", "chunk_id", "document_id", score.alias("score"))

    order = [F.desc("score"), F.col("chunk_id")]
    # a row that as many first chunks precede as fill the answer can't be in it: as many documents as ids have rows share two places
    most = limit * (documents.groupBy("document_id").count().agg(F.max("count")).first()[0] or 1)

    def first(kind: str, best: tuple[float, float], wanted: DataFrame) -> DataFrame:
        """A document's first chunks don't depend on the question, and those of a name are one list: questions meet the best names only, by the heads of their lists."""
        score = (best[0] - best[1] * F.col("chunk_index")) * F.coalesce("quality", F.lit(1.0))
        own = top_per_group(chunks.select("chunk_id", "document_id", "chunk_index", score.alias("score")), ["document_id"], [F.desc("score"), F.col("chunk_index"), F.col("chunk_id")], PER_DOCUMENT)
        listed = top_per_group(own.join(named.select("document_id", "name"), "document_id"), ["name"], order, most, rank="_place").select("name", "chunk_id", "document_id", "score", "_place")
        heads = wanted.where(F.col("kind") == kind).join(listed.where("_place = 1"), "name").select("query_id", "name", "score", "chunk_id")
        return top_per_group(heads, ["query_id"], order, most).select("query_id", "name").join(listed, "name").select("query_id", "chunk_id", "document_id", "score")

    short = kinds.join(asked.where(F.size("terms") <= IDENTITY_TERMS).select("query_id"), "query_id", "left_semi")
    every = text.unionByName(first("named", NAMED_FIRST, kinds)).unionByName(first("nearly", NEARLY_FIRST, short))
    best = top_per_group(top_per_group(every, ["query_id", "document_id"], order, PER_DOCUMENT), ["query_id"], order, limit, rank="rank").withColumnRenamed("query_id", "one")
    return best.join(same.select("one", F.explode("ids").alias("query_id")), "one").select("query_id", "chunk_id", "document_id", "score", "rank")


def text_lane(rows: DataFrame, questions: DataFrame, id_col: str, text: Column, limit: int = 50, own: bool = False) -> DataFrame:
    """``(query_id, id, score, rank)``: rows (blocks, entities, relations) whose text holds all terms of a question, best first; ties to the smaller id.

    Questions of the same tokens find the same rows: one of them is searched for, and its best rows are given to all.
    ``own``: rows are known to have their ids to themselves, so that this need not be found out.
    """
    tokens = questions.select("query_id", F.explode(question_terms(F.col("query"))["terms"]).alias("term"))
    tokens = tokens.select("query_id", F.explode(F.filter(F.split("term", r"[^\p{L}\p{N}]+"), lambda t: t != "")).alias("token")).distinct()
    alike = tokens.groupBy("query_id").agg(F.array_sort(F.collect_set("token")).alias("all")).groupBy("all").agg(F.min("query_id").alias("one"), F.collect_list("query_id").alias("ids"))
    asked = alike.select(F.col("one").alias("query_id"), F.explode("all").alias("token"))
    found = lexical_lane(words(rows, id_col, text), asked, id_col, "all", own)
    best = top_per_group(found.select(F.col("query_id").alias("one"), id_col, "score"), ["one"], [F.desc("score"), F.col(id_col)], limit, rank="rank")
    return best.join(alike.select("one", F.explode("ids").alias("query_id")), "one").select("query_id", id_col, "score", "rank")


_QUOTED = r"""\"([^\"]*)\"|'([^']*)'|`([^`]*)`|\u00ab([^\u00bb]*)\u00bb|\u201c([^\u201d]*)\u201d|\u2018([^\u2019]*)\u2019"""


def quoted_sequences(questions: DataFrame) -> DataFrame:
    """``(query_id, phrase, place, token, n)``: the tokens of every quotation of two or more, in order; ``phrase`` is their text."""
    quoted = F.regexp_extract_all(F.coalesce("query", F.lit("")), F.lit(_QUOTED), F.lit(0))
    tokens = F.transform(quoted, lambda q: F.filter(F.split(F.lower(q), r"[^\p{L}\p{N}]+"), lambda t: t != ""))
    each = questions.select("query_id", F.explode(F.array_distinct(F.filter(tokens, lambda t: F.size(t) >= 2))).alias("t"))
    return each.select("query_id", F.array_join("t", " ").alias("phrase"), F.size("t").alias("n"), F.posexplode("t").alias("place", "token"))


def sequence_hits(postings_: DataFrame, sequences: DataFrame, id_col: str) -> DataFrame:
    """``(query_id, phrase, id)``: rows in which the tokens of a sequence stand one after the other.

    Rows that hold all tokens are found from counts first; only their occurrences are put beside the sequences' places, and a
    sequence stands where all its tokens have one and the same start.
    """
    met = postings_.join(sequences.select("token").distinct(), "token", "left_semi")
    distinct = sequences.select("query_id", "phrase", "token", F.size(F.array_distinct(F.split("phrase", " "))).alias("k")).distinct()
    holds = met.select(id_col, "token").distinct().join(distinct, "token").groupBy("query_id", "phrase", id_col).agg(F.count("*").alias("m"), F.max("k").alias("k")).where("m = k")
    wanted = holds.select("query_id", "phrase", id_col).join(sequences, ["query_id", "phrase"])
    starts = wanted.join(met, [id_col, "token"]).groupBy("query_id", "phrase", id_col, (F.col("at") - F.col("place")).alias("start")).agg(F.count("*").alias("m"), F.max("n").alias("n"))
    return starts.where("m = n").select("query_id", "phrase", id_col).distinct()


def content_anchors(rows: DataFrame, questions: DataFrame, id_col: str, text: Column, overlap: int = 2, limit: int = 50) -> DataFrame:
    """``(query_id, id, quoted, matched, rank)``: rows that hold a quotation of the question, or ``overlap`` or more of its terms; the best ``limit``.

    Rows with more quotations come first, then those with more terms, then the smaller id.
    """
    tokens = questions.select("query_id", F.explode(question_terms(F.col("query"))["terms"]).alias("term"))
    tokens = tokens.select("query_id", F.explode(F.filter(F.split("term", r"[^\p{L}\p{N}]+"), lambda t: t != "")).alias("token")).distinct()
    sequences = quoted_sequences(questions)
    every = words(rows, id_col, text)
    own, shared = apart(every, id_col) if fits(tokens) and fits(sequences) else (None, every)
    found = []
    if shared is not None:
        post = shared.select(id_col, F.posexplode("words").alias("at", "token"))
        some = lexical_lane(post, tokens, id_col, "any").where(F.col("matched") >= overlap).select("query_id", id_col, "matched")
        quoted = sequence_hits(post, sequences, id_col).groupBy("query_id", id_col).agg(F.count("*").alias("quoted"))
        both = some.join(quoted, ["query_id", id_col], "full")
        found.append(both.select("query_id", id_col, F.coalesce("quoted", F.lit(0)).alias("quoted"), F.coalesce("matched", F.lit(0)).alias("matched")))
    if own is not None:
        best = best_where_they_lie(own, tokens, id_col, limit, sequences, overlap)
        # fewer terms than asked for count as none
        found.append(best.select("query_id", id_col, "quoted", F.when(F.col("matched") >= overlap, F.col("matched")).otherwise(0).alias("matched")))
    both = found[0].unionByName(found[-1]) if len(found) > 1 else found[0]
    return top_per_group(both, ["query_id"], [F.desc("quoted"), F.desc("matched"), F.col(id_col)], limit, rank="rank")


def fuse_typed(left: DataFrame, right: DataFrame, right_kind: str = "relevance", key: str = "id", tie: Sequence[str] = ()) -> DataFrame:
    """``(query_id, key, score, kind, place)`` of two lanes, typed reciprocal rank fusion.

    Lanes: (query_id, key, rank from 1, score, kind; null: relevance).  A relevance hit of ``IDENTITY_SCORE`` or more is an identity, and one of the right lane
    has that lane's kind.  A row has its kind of highest priority, of equal ones the first met (left, then by rank).  Relevance rows score the sum of 1 / (60 + rank), others
    their best score as it was.  Order: priority, score, then the key and ``tie``.
    """
    columns = ["query_id", key, "rank", "score", "kind", *tie]
    both = left.select(*columns, F.lit(0).alias("_lane"), F.lit("relevance").alias("_own")).unionByName(right.select(*columns, F.lit(1).alias("_lane"), F.lit(right_kind).alias("_own")))
    given = F.coalesce("kind", F.lit("relevance"))
    kind = F.when(given != "relevance", given).when(F.coalesce("score", F.lit(0.0)) >= IDENTITY_SCORE, "document_identity").otherwise(F.col("_own"))
    priority = F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("_kind"))
    fused = both.withColumn("_kind", kind).withColumn("_p", priority).groupBy("query_id", key).agg(
        F.sum(1.0 / (RRF_K + F.col("rank"))).alias("_rrf"), F.max("score").alias("_best"), F.min(F.struct(-F.col("_p"), "_lane", "rank", F.col("_kind").alias("kind"))).alias("_k"), *[F.min(t).alias(t) for t in tie]
    )
    scored = fused.select("query_id", key, F.when(F.col("_k.kind") == "relevance", F.col("_rrf")).otherwise(F.col("_best")).alias("score"), F.col("_k.kind").alias("kind"), *tie, F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("_k.kind")).alias("_p"))
    return top_per_group(scored, ["query_id"], [F.desc("_p"), F.desc(F.coalesce("score", F.lit(0.0))), F.col(key), *[F.col(t) for t in tie]], 1 << 30, rank="place").drop("_p", *tie)


def fuse_entities(vector: DataFrame, lexical: DataFrame, limit: int, key: str = "node_id") -> DataFrame:
    """``(query_id, key, score, place)`` of the ``limit`` best entities by reciprocal rank fusion.

    Lanes: (query_id, key, rank from 1, score, node_type, label).  Ties: those of the lexical lane, then the greater score of a lane, then type, label and key.
    """
    columns = ["query_id", key, "rank", "score", "node_type", "label"]
    both = vector.select(*columns, F.lit(0).alias("_lane")).unionByName(lexical.select(*columns, F.lit(1).alias("_lane")))
    fused = both.groupBy("query_id", key).agg(
        F.sum(1.0 / (RRF_K + F.col("rank"))).alias("_rrf"), F.max("_lane").alias("_lane"), F.max("score").alias("_raw"), F.max_by(F.struct("node_type", "label"), F.coalesce("score", F.lit(0.0))).alias("_e")
    )
    order = [F.desc(F.round("_rrf", 12)), F.desc("_lane"), F.desc(F.coalesce("_raw", F.lit(0.0))), F.col("_e.node_type"), F.col("_e.label"), F.col(key)]
    return top_per_group(fused, ["query_id"], order, limit, rank="place").select("query_id", key, F.col("_rrf").alias("score"), "place")
