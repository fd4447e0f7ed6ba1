"""The library's face: one object over a set of canonical tables.

Every method returns a DataFrame.  Models are callables that the caller injects; nothing here
calls out by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import blocks, claims, facts, graph, lanes, metadata, ranking, search
from .sources import snapshot

#: Modes of retrieval. Fixed values.
MODES = ("document", "local", "global", "hybrid", "mix")


@dataclass(frozen=True)
class Question:
    """A typed question: what is asked for, and how to look for it."""

    text: str
    mode: str = "hybrid"
    top_k: int = 10
    keywords: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    literals: tuple[str, ...] = ()
    confidence: float = 0.25

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode}")

    def terms(self) -> list[str]:
        """Keywords if given, else the text's words of three letters or more, once each."""
        import re

        words = self.keywords or tuple(re.findall(r"[\w/]{3,}", self.text.lower()))
        return list(dict.fromkeys(words))

    def candidates(self) -> int:
        """Rows to fetch before fusion: thrice the answer in mixed modes, 96 at most."""
        return max(self.top_k, min(3 * self.top_k, 96)) if self.mode in ("hybrid", "mix") else self.top_k


@dataclass
class Engine:
    """Queries over documents, vectors and a graph.

    ``embed`` turns a text into a vector; without it only the lexical lane runs.
    """

    documents: DataFrame
    vectors: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    embed: Callable[[str], Sequence[float]] | None = None
    _cached: dict[str, DataFrame] = field(default_factory=dict)

    def chunks(self) -> DataFrame:
        return blocks.chunks(self.documents)

    def blocks(self) -> DataFrame:
        return blocks.blocks(self.documents)

    def facts(self) -> DataFrame:
        return facts.aggregate(facts.extract(blocks.line_chunks(self.documents), ["doc_id", "chunk_index"], "content_text"), ["doc_id"], "chunk_index")

    def search(self, question: Question | str) -> DataFrame:
        """Documents for one question: lexical and vector lanes, fused, best first, with excerpts."""
        q = Question(question) if isinstance(question, str) else question
        spark, terms = self.documents.sparkSession, q.terms()
        asked = spark.createDataFrame([(0, t) for t in terms], "query_id int, token string")
        # only documents that hold a term are turned into postings
        near = self.documents.where(F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower("text"), t))) if terms else self.documents.limit(0)
        postings = search.postings(near, "doc_id", F.col("text"))
        lanes = search.ladder([search.lexical_lane(postings, asked, "doc_id", m) for m in ("all", "any")], "doc_id")
        lanes = ranking.top_per_group(lanes, ["query_id"], [F.col("pass"), F.desc("score"), F.col("doc_id")], q.candidates(), rank="rank")
        found = {"lexical": lanes}
        if self.vectors is not None and self.embed is not None and q.mode != "document":
            vector = spark.createDataFrame([(0, [float(x) for x in self.embed(q.text)])], "query_id int, q array<double>")
            found["vector"] = search.nearest(self.vectors, vector, "doc_id", "embedding", q.candidates())
        fused = search.reciprocal_rank_fusion(found, "doc_id")
        best = fused.orderBy(F.desc("score"), "doc_id").limit(q.top_k)
        return best.join(self.documents.select("doc_id", "text"), "doc_id").select(
            "doc_id", "score", "lanes", search.excerpt(F.col("text"), F.lit(terms[0] if terms else "")).alias("excerpt")
        ).orderBy(F.desc("score"), "doc_id")

    def page(self, after: object = None, size: int = 50, id_col: str = "doc_id") -> DataFrame:
        """A page of documents, the largest ids first, and one row more if another page follows."""
        return ranking.keyset_page(self.documents, [id_col], None if after is None else [after], size)

    def titles(self, query: str, limit: int = 20) -> DataFrame:
        """Documents (with the columns title and key) whose title or key holds terms of a query, best first."""
        asked = self.documents.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
        return metadata.metadata_search(self.documents.select("doc_id", "title", "key"), asked, limit, "doc_id").drop("query_id")

    def find_entities(self, query: str, limit: int = 50) -> DataFrame:
        """Nodes whose label and type hold all terms of a query, best first."""
        asked = self.nodes.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
        return lanes.text_lane(self.nodes, asked, "node_id", F.concat_ws(" ", "label", "node_type"), limit).drop("query_id")

    def find_relations(self, query: str, limit: int = 50) -> DataFrame:
        """Relations whose ends' labels and type hold all terms of a query, best first: ``(edge_key, score, rank)``."""
        label = lambda s: self.nodes.select(F.col("node_id").alias(f"{s}_node_id"), F.col("label").alias(f"{s}_label"))
        named = self.edges.join(label("from"), "from_node_id").join(label("to"), "to_node_id")
        named = named.withColumn("edge_key", graph.edge_key(F.col("from_node_id"), F.col("relation_type"), F.col("to_node_id")))
        asked = self.edges.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
        text = F.replace(F.concat_ws(" ", "from_label", "relation_type", "to_label"), F.lit("_"), F.lit(" "))
        return lanes.text_lane(named, asked, "edge_key", text, limit).drop("query_id")

    def _tables(self) -> dict[str, DataFrame]:
        known = {"documents": self.documents, "vectors": self.vectors, "nodes": self.nodes, "edges": self.edges}
        return {name: df for name, df in known.items() if df is not None}

    def export(self, path: str) -> None:
        """A snapshot of all tables."""
        snapshot.export(self._tables(), path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, embed: Callable[[str], Sequence[float]] | None = None) -> Engine:
        """The engine over a snapshot."""
        return cls(**snapshot.import_(spark, path), embed=embed)

    def entities(self, prefix: str = "", limit: int = 50) -> DataFrame:
        return self.nodes.where(F.startswith(F.lower("label"), F.lit(prefix.lower()))).orderBy(F.desc("support_count"), "label", "node_id").limit(limit)

    def neighbourhood(self, node_ids: Sequence[str], hops: int = 2) -> DataFrame:
        return graph.traverse(self.edges, list(node_ids), hops)

    def related(self, node_ids: Sequence[str], limit: int = 20) -> DataFrame:
        """Nodes that a walk from the given ones visits most."""
        return graph.personalised_pagerank(self.edges, list(node_ids)).orderBy(F.desc("score"), "node_id").limit(limit)

    def communities(self) -> DataFrame:
        return graph.label_propagation(self.edges)

    def verify(self, question: Question, evidence: DataFrame, answer: str = "") -> DataFrame:
        """``(literals, supported, state)`` of an answer: its claims and the question's literals must occur in ``evidence`` (doc_id, text)."""
        spark = self.documents.sparkSession
        told = spark.createDataFrame([(0, answer)], "query_id int, text string")
        given = spark.createDataFrame([(0, x) for x in question.literals], "query_id int, literal string")
        texts = evidence.select(F.lit(0).alias("query_id"), F.col("text").alias("evidence"))
        every = claims.claims(told, "query_id", "text").select("query_id", "literal").unionByName(given).distinct()
        verbatim = search.grounded(told.select("query_id", F.trim("text").alias("literal")).where("literal <> ''"), texts).where("supported")
        states = claims.verification_states(told, search.grounded(every, texts), verbatim, told.limit(0))
        return states.select("literals", "supported", "state")
