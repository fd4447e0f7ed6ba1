"""Candidates of a graph merged into nodes, edges, evidence and what was rejected; acronyms as aliases.

Everything is grouped by stable keys and combined per task before it is shuffled; ids are
name-based UUIDs of those keys, so a second run over the same candidates gives the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import uuid5
from ..rows import flat_map
from .graph import RELATION, cut, edge_key, label_key

#: The relation of a document to what it names, the type of a label that no entity has, and the most aliases that a chunk gives a label. Fixed values.
MENTIONS, UNKNOWN_TYPE, ALIASES = "mentions", "concept", 4


class Merged:
    """``nodes``, ``edges``, ``evidence`` (one row per target and chunk), its counts per target (``targets``) and ``rejected`` relations.

    A chunk's candidates meet in one task, so what is said within a chunk is decided there; each result moves the columns that it
    needs, and is counted from what was written of it, a row per chunk.
    """

    def __init__(self, entities: DataFrame, admitted: DataFrame, refused: DataFrame) -> None:
        self._entities, self._admitted, self._refused = entities, admitted, refused

    def _keyed(self, relations: DataFrame, *more: str) -> DataFrame:
        """Entities and relations with the keys of both ends; the source of an entity (without ``to_label_key``) is its document."""
        rows = self._entities.unionByName(relations, allowMissingColumns=True).select("chunk_id", "document_id", "node_type", "label_key", "to_label_key", *more).repartition("chunk_id")
        entity = F.col("to_label_key").isNull()
        rank = F.when(F.col("node_type") == "document", 2).when(F.col("node_type") == "concept", 1).otherwise(0)
        least = lambda c: F.min(F.when(entity, F.struct(rank.alias("r"), "node_type"))).over(Window.partitionBy("chunk_id", c))["node_type"]
        rows = rows.withColumn("own", F.coalesce("to_label_key", "label_key")).withColumn("source_type", least("label_key")).withColumn("target_type", least("own"))
        kind = lambda c: F.when(entity | F.col(c).isNotNull(), F.col(c)).otherwise(UNKNOWN_TYPE)
        return rows.select(
            "chunk_id", "document_id", entity.alias("entity"), *more,
            F.when(entity, _document_key()).otherwise(F.concat_ws(":", kind("source_type"), "label_key")).alias("source_key"), F.concat_ws(":", kind("target_type"), "own").alias("target_key"),
        )

    @cached_property
    def rejected(self) -> DataFrame:
        return self._keyed(self._refused, "relation_type", "reason").where("NOT entity").select(
            "chunk_id", "document_id", "source_key", "target_key", F.col("relation_type").alias("raw_relation_type"), "reason",
            uuid5(F.concat_ws("|", F.lit("rejected"), F.col("chunk_id").cast("string"), edge_key(F.col("source_key"), F.coalesce("relation_type", F.lit("")), F.col("target_key")))).alias("rejected_id"),
        )

    @cached_property
    def nodes(self) -> DataFrame:
        """A label that stands for an entity comes before one of an end of a relation."""
        both = self._keyed(self._admitted.drop("summary"), "label", "to_label", "alias", "summary")
        none, later = F.lit(None).cast("string"), F.expr("NOT entity").alias("later")
        source = F.struct(F.col("source_key").alias("key"), F.when(F.col("entity"), F.col("document_id").cast("string")).otherwise(F.col("label")).alias("label"), none.alias("alias"), none.alias("summary"), later)
        target = F.struct(F.col("target_key").alias("key"), F.coalesce("to_label", "label").alias("label"), "alias", "summary", later)
        rows = both.select("chunk_id", F.inline(F.array(source, target))).groupBy("chunk_id", "key", "label", "alias").agg(F.min("later").alias("later"), F.min("summary").alias("summary"))
        first = F.row_number().over(Window.partitionBy("chunk_id", "key").orderBy("label", "alias")) == 1
        known = cut(rows.withColumn("first", first)).groupBy("key").agg(
            F.min(F.struct("later", "chunk_id", "label")).alias("named"), F.min(F.when(F.col("summary").isNotNull(), F.struct("chunk_id", "summary"))).alias("told"),
            F.count_if("first").alias("support_count"), F.collect_set("label").alias("labels"), F.collect_set("alias").alias("aliases"),
        )
        named = F.exists(F.concat("labels", "aliases"), lambda x: x != "")
        return known.where(named).select(
            uuid5(F.concat_ws("|", F.lit("node"), "key")).alias("node_id"), F.col("key").alias("canonical_key"), F.col("named.label").alias("label"), F.split_part("key", F.lit(":"), F.lit(1)).alias("node_type"),
            F.array_sort(F.array_remove(F.array_union("labels", "aliases"), "")).alias("aliases"), F.col("told.summary").alias("summary"), "support_count",
        )

    @cached_property
    def edges(self) -> DataFrame:
        ends = ["source_key", "relation", "target_key"]
        each = self._keyed(self._admitted, "relation", "summary").withColumns({"relation": F.coalesce("relation", F.lit(MENTIONS)), "summary": F.expr("CASE WHEN NOT entity THEN summary END")})
        known = cut(each.groupBy("chunk_id", *ends).agg(F.min("summary").alias("summary")))
        key = edge_key(F.col("source_key"), F.col("relation"), F.col("target_key"))
        node_id = lambda c: uuid5(F.concat_ws("|", F.lit("node"), c))
        return known.groupBy(*ends).agg(F.count("*").alias("support_count"), F.min(F.when(F.col("summary").isNotNull(), F.struct("chunk_id", "summary"))).alias("told")).select(
            uuid5(F.concat_ws("|", F.lit("edge"), key)).alias("edge_id"), key.alias("canonical_key"), node_id("source_key").alias("from_node_id"), node_id("target_key").alias("to_node_id"), F.col("relation").alias("relation_type"), F.col("told.summary").alias("summary"), "support_count"
        )

    @cached_property
    def _proofs(self) -> DataFrame:
        of = lambda kind, key: F.struct(F.lit(kind).alias("target_kind"), key.alias("key"))
        source, target = F.col("source_key"), F.col("target_key")
        found = F.array(of("node", source), of("node", target), of("edge", edge_key(source, F.coalesce("relation", F.lit(MENTIONS)), target)))
        return cut(self._keyed(self._admitted, "relation").select("chunk_id", "document_id", F.inline(found)).distinct())

    @cached_property
    def evidence(self) -> DataFrame:
        return self._proofs.select("target_kind", _target_id(), "chunk_id", "document_id")

    @cached_property
    def targets(self) -> DataFrame:
        """``(target_kind, target_id, evidence, documents)``: counted by keys, so that an id is made once for each target."""
        of = self._proofs.groupBy("target_kind", "key", "document_id").agg(F.count("*").alias("n"))
        return of.groupBy("target_kind", "key").agg(F.sum("n").alias("evidence"), F.count("document_id").alias("documents")).select("target_kind", _target_id(), "evidence", "documents")


def _named(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit("")))


def _document_key() -> Column:
    return F.concat_ws(":", F.lit("document"), F.col("document_id").cast("string"))


def _target_id() -> Column:
    return uuid5(F.concat_ws("|", "target_kind", "key")).alias("target_id")


def _relation(raw: Column) -> Column:
    """The trimmed relation if it is well-formed, else empty."""
    name = F.trim(F.coalesce(raw, F.lit("")))
    return F.when(name.rlike(RELATION) & (F.octet_length(name) <= 64), name).otherwise("")


def merge_candidates(entities: DataFrame, relations: DataFrame) -> Merged:
    """Merge what was found chunk by chunk.

    ``entities``: (chunk_id, document_id, label, node_type, alias, summary); ``relations``: (chunk_id, document_id, source_label,
    target_label, relation_type, summary).  A label's type is decided within its chunk: a specific one before concept, concept before
    document, then the first by name; a label that no entity of the chunk has is a concept.  Nodes are labels of one type and one key.
    Every entity gives an edge from its document; a relation gives one if it has a well-formed type and two different ends, whose
    nodes are made where entities don't have them.  A node's and an edge's support is the number of chunks that are evidence of it;
    label and summary are those of the smallest chunk that has one.  Blank labels and null chunks are left out.
    """
    found = entities.where((_named("label") != "") & F.col("chunk_id").isNotNull()).select(
        "chunk_id", "document_id", _named("label").alias("label"), label_key(_named("label")).alias("label_key"), F.lit(None).cast("string").alias("to_label_key"), "node_type", _named("alias").alias("alias"), "summary"
    )
    given = relations.where((_named("source_label") != "") & (_named("target_label") != "") & F.col("chunk_id").isNotNull())
    given = given.select("chunk_id", "document_id", _named("source_label").alias("label"), _named("target_label").alias("to_label"), "relation_type", _relation(F.col("relation_type")).alias("relation"), "summary")
    keys = F.struct(label_key(F.col("label")).alias("label_key"), label_key(F.col("to_label")).alias("to_label_key"))
    # a chunk gives a label one type, so ends are the same node if they have one label; what is left out isn't moved, and a filter of the keys would find them twice
    keyed = lambda df, keep: df.select("*", F.inline(F.filter(F.array(keys), keep)))
    admitted = keyed(given.where("relation <> ''"), lambda k: k["label_key"] != k["to_label_key"])
    loops = keyed(given.where("relation <> ''"), lambda k: k["label_key"] == k["to_label_key"]).withColumn("reason", F.lit("degenerate_self_loop"))
    refused = keyed(given.where("relation = ''"), lambda k: F.lit(True)).withColumn("reason", F.lit("empty_relation")).unionByName(loops)
    return Merged(found, admitted, refused)


# ---- acronyms

_GLOSS, _WORD = re.compile(r"\(([^)]*)\)"), re.compile(r"[^\W_]+")


def is_identifier(text: str) -> bool:
    """One token of letters, digits and ``_ - .``: with a digit or sign, a capital after a small letter, or in capitals."""
    if not text or not all(c.isalpha() or c.isnumeric() or c in "_-." for c in text):
        return False
    if any(c.isnumeric() or c in "_-." for c in text):
        return True
    return re.search(r"[^\W\d_]", text) is not None and (text.upper() == text or any(b.isupper() and any(a.islower() for a in text[:i]) for i, b in enumerate(text)))


def glosses(text: str) -> Iterator[tuple[str, str]]:
    """(short form, phrase): words right before brackets whose first letters are what stands in them."""
    at = 0
    while m := _GLOSS.search(text, at):
        at = m.end()
        short = m[1].strip()
        n = len(short)
        if n < 2 or not short.isalpha() or not is_identifier(short):
            continue
        start = m.start()
        words: list[str] = []
        reach = 40 * n
        while len(words) <= n and reach < 80 * n + start:  # one word more than needed, so that none is cut
            words = _WORD.findall(text[max(0, start - reach) : start])
            reach *= 2
        tail = words[-n:]
        if len(tail) == n and all(w[0].isalpha() for w in tail) and "".join(w[0] for w in tail).upper() == short.upper():
            yield short, " ".join(tail)


def gloss_table(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``(id, short, phrase)``, each once per chunk; null texts have none."""

    def run(key: object, text: str | None) -> Iterator[tuple]:
        yield from ((key, *g) for g in dict.fromkeys(glosses(text or "")))

    kind = chunks.schema[id_col].dataType.simpleString()
    return flat_map(chunks.select(id_col, text_col), run, f"`{id_col}` {kind}, short string, phrase string")


def acronym_aliases(found: DataFrame, nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(node_id, alias)``: short forms of nodes whose label a chunk of their evidence spells out, and phrases of nodes named by the short form.

    ``found``: (chunk_id, short, phrase); ``nodes``: (node_id, label); ``evidence``: (node_id, chunk_id).  Labels meet glosses by
    equality of their words within a chunk.  A chunk gives a node at most ``ALIASES``, the first by name.
    """
    words = lambda c: F.lower(F.array_join(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " "))
    both = found.select("chunk_id", F.explode(F.array(F.struct(F.lower("phrase").alias("said"), F.col("short").alias("alias")), F.struct(F.lower("short").alias("said"), F.col("phrase").alias("alias")))).alias("g"))
    both = both.select("chunk_id", "g.*").distinct()
    held = evidence.join(nodes.select("node_id", words(F.col("label")).alias("said")), "node_id").join(both, ["chunk_id", "said"])
    few = held.groupBy("node_id", "chunk_id").agg(F.slice(F.array_sort(F.collect_set("alias")), 1, ALIASES).alias("a"))
    return few.select("node_id", F.explode("a").alias("alias")).distinct()


def acronym_terms(label: Column, most: int = 4) -> Column:
    """First letters of two to ``most`` words of a label in a row, sorted: of its words, then of what capitals and digits part them into."""
    plain = F.filter(F.split(F.lower(label), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)
    turns = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
    parts = F.filter(F.split(F.lower(F.regexp_replace(label, turns, " ")), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)
    letters = F.transform(F.array_distinct(F.concat(plain, parts)), lambda w: F.when(w.rlike(r"^\p{L}+$"), F.substring(w, 1, 1)))

    def windows(x: Column, n: int) -> Column:
        starts = F.when(F.size(x) >= n, F.sequence(F.lit(1), F.size(x) - n + 1)).otherwise(F.array().cast("array<int>"))
        whole = F.filter(F.transform(starts, lambda i: F.slice(x, i, F.lit(n))), lambda w: F.forall(w, lambda c: c.isNotNull()))
        return F.transform(whole, lambda w: F.array_join(w, ""))

    # the words are found once: a lambda's variable has their letters
    return F.element_at(F.transform(F.array(letters), lambda x: F.array_sort(F.array_distinct(F.concat(*[windows(x, n) for n in range(2, most + 1)])))), 1)
