"""Lexical and vector search, fusion, reranking and context assembly.

Corpora are searched by equality of tokens: queries are a small table of terms that is joined
with the corpus's postings, so one job serves a batch of questions.  Vectors of queries
meet all rows in one pass; the best rows are kept per task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..rows import flat_map, small_batches
from .ranking import top_per_group

#: Added to the rank in reciprocal rank fusion, and the score from which a hit is an identity. Fixed values.
RRF_K, IDENTITY_SCORE = 60, 100_000.0


def postings(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``(id, at, token)``: every token of every text and its place."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return df.select(id_col, F.posexplode(words).alias("at", "token"))


def words(df: DataFrame, id_col: str, text: Column, *carry: str) -> DataFrame:
    """``(id, words)``: the tokens of every text in order, a row per text; null texts have none."""
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return df.select(id_col, *carry, F.coalesce(found, F.array().cast("array<string>")).alias("words"))


def _occurrences(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(id_col, F.posexplode("words").alias("at", "token"))


def repeated(rows: DataFrame, id_col: str) -> DataFrame | None:
    """Ids that several rows have, and null; none if every row has its own id."""
    again = rows.groupBy(id_col).agg(F.count("*").alias("_n")).where((F.col("_n") > 1) | F.col(id_col).isNull()).select(F.col(id_col).alias("_again"))
    return None if again.isEmpty() else again


def apart(rows: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows that have their ids to themselves, and those that share one (none, if there are no such)."""
    again = repeated(rows, id_col)
    if again is None:
        return rows, None
    same = F.col(id_col).eqNullSafe(F.col("_again"))
    return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")


def prefix_key(token: Column, cut: int = 5) -> Column:
    """Tokens of four characters or more cut to a prefix; shorter ones whole."""
    return F.when(F.length(token) >= 4, F.substring(token, 1, cut)).otherwise(token)


def term_hits(postings_: DataFrame, terms: DataFrame, id_col: str, prefixes: bool = False) -> DataFrame:
    """``(id, token, tf, first_at)`` of the tokens that some term equals, or with ``prefixes`` has the prefix of.

    Occurrences go to their row's task once, so that whatever is counted per row and question needs no further shuffle.
    """
    key = prefix_key(F.col("token")) if prefixes else F.col("token")
    keys = terms.select(key.alias("_key")).distinct()
    met = postings_.withColumn("_key", key).join(F.broadcast(keys) if fits(terms) else keys, "_key", "left_semi")
    return met.repartition(_parts(met), id_col).groupBy(id_col, "token").agg(F.count("*").alias("tf"), F.min("at").alias("first_at"))


def _parts(df: DataFrame) -> int:
    """Tasks whose rows become many more, one for each question: as many as are set, not put together by their small input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fits(terms: DataFrame) -> bool:
    """Whether the terms of questions may be held by every task."""
    return terms.agg(F.coalesce(F.sum(F.octet_length("token") + 24), F.lit(0))).first()[0] <= LITERAL_BYTES


#: Questions whose seldomest terms are looked up in every row; more meet rows by a join.
LOOKED_UP = 4096


def _questions(terms: DataFrame) -> int:
    return terms.select("query_id").distinct().count()


def _score(matched: Column, n: Column, span: Column, tf: Column) -> Column:
    return matched / n * (1 + 1 / (1 + span / 100.0)) * F.log1p(tf)


def _all_terms(postings_: DataFrame, terms: DataFrame, id_col: str) -> DataFrame:
    """As ``lexical_lane`` of mode ``all``: a row meets only the questions whose seldomest term it holds, and is tested for the others where it lies."""
    known, few = terms.select("token").distinct(), fits(terms)
    met = postings_.join(F.broadcast(known) if few else known, "token", "left_semi")
    often = met.groupBy("token").agg(F.count("*").alias("_often"))
    asked = terms.distinct().join(often, "token", "left").groupBy("query_id").agg(
        F.collect_list("token").alias("_all"), F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("n"), "token")).alias("_least")
    )
    # a question with a term that no row holds finds nothing
    asked = asked.where("_least.n > 0").select("query_id", "_all", F.col("_least.token").alias("_key"))
    asked = F.broadcast(asked) if few else asked
    held = met.repartition(id_col).groupBy(id_col).agg(F.collect_list(F.struct("token", "at")).alias("_h"))
    pairs = held.withColumn("_key", F.explode(F.array_distinct(F.col("_h.token")))).join(asked, "_key").where(F.size(F.array_except("_all", F.col("_h.token"))) == 0)
    own = F.filter("_h", lambda x: F.array_contains("_all", x["token"]))
    firsts = F.transform("_all", lambda t: F.array_min(F.transform(F.filter("_o", lambda x: x["token"] == t), lambda x: x["at"])))
    each = pairs.select("query_id", id_col, "_all", own.alias("_o")).select("query_id", id_col, F.size("_all").cast("bigint").alias("matched"), F.size("_o").alias("_tf"), firsts.alias("_f"))
    score = _score(F.col("matched"), F.col("matched"), F.array_max("_f") - F.array_min("_f"), F.col("_tf"))
    return each.select("query_id", id_col, "matched", score.alias("score"))


def _all_words(rows: DataFrame, terms: DataFrame, id_col: str) -> DataFrame:
    """As ``_all_terms`` for ``words`` of rows with ids of their own: no row is moved, and what it holds is tested where it lies.

    Other columns of ``rows`` are kept.  The questions' seldomest terms that rows hold, one for each, are looked up in every row.
    """
    known = terms.select("token").distinct()
    often = rows.select(F.explode(F.array_distinct("words")).alias("token")).join(F.broadcast(known), "token").groupBy("token").agg(F.count("*").alias("_often"))
    asked = terms.distinct().join(often, "token", "left").groupBy("query_id").agg(
        F.collect_list("token").alias("_all"), F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("n"), "token")).alias("_least")
    )
    asked = asked.where("_least.n > 0").select("query_id", "_all", F.col("_least.token").alias("_key"))
    keys = asked.agg(F.collect_set("_key").alias("_keys"))
    own = [c for c in rows.columns if c != "words"]
    held = rows.crossJoin(F.broadcast(keys)).select(*own, "words", F.explode(F.array_intersect("words", "_keys")).alias("_key"))
    pairs = held.join(F.broadcast(asked), "_key").where(F.size(F.array_except("_all", "words")) == 0)
    tf = F.size(F.filter("words", lambda w: F.array_contains("_all", w)))
    firsts = F.transform("_all", lambda t: F.array_position("words", t))
    each = pairs.select("query_id", *own, F.size("_all").cast("bigint").alias("matched"), tf.alias("_tf"), firsts.alias("_f"))
    score = _score(F.col("matched"), F.col("matched"), F.array_max("_f") - F.array_min("_f"), F.col("_tf"))
    return each.select("query_id", *own, "matched", score.alias("score"))


def all_terms(rows: DataFrame, terms: DataFrame, id_col: str, own_ids: bool = False) -> DataFrame:
    """As ``lexical_lane`` of mode ``all`` for ``words``, with the other columns of ``rows``: those with an id of their own aren't moved."""
    held = fits(terms) and _questions(terms) <= LOOKED_UP
    own, shared = (None, rows) if not held else (rows, None) if own_ids else apart(rows, id_col)
    parts = [_all_words(own, terms, id_col)] if own is not None else []
    if shared is not None:
        carried = shared.drop("words")
        found = _all_terms(_occurrences(shared, id_col), terms, id_col)
        parts.append(found.join(carried, id_col) if len(carried.columns) > 1 else found)
    return parts[0].unionByName(parts[-1]) if len(parts) > 1 else parts[0]


def lexical_lane(found: DataFrame, terms: DataFrame, id_col: str, mode: str = "all", own_ids: bool = False) -> DataFrame:
    """``(query_id, id, matched, score)`` by token equality.

    ``found``: postings, hits that ``term_hits`` counted for these terms, or ``words``, by which rows with an id of their own
    aren't moved (``own_ids``: all are known to have one).  ``terms``: (query_id, token).  ``all`` keeps rows that hold every term (AND), ``any`` those with one.  The score is the share of terms matched, times what their nearness
    adds: one over one plus the span between the first places of the terms, in words of 100.
    """
    if "words" in found.columns:
        return all_terms(found.select(id_col, "words"), terms, id_col, own_ids) if mode == "all" else lexical_lane(_occurrences(found, id_col), terms, id_col, mode)
    if mode == "all" and "tf" not in found.columns:
        return _all_terms(found, terms, id_col)
    hits = found if "tf" in found.columns else term_hits(found, terms, id_col)
    wanted = terms.distinct().withColumn("_n", F.count("*").over(Window.partitionBy("query_id")))
    each = hits.join(F.broadcast(wanted) if fits(terms) else wanted, "token").groupBy("query_id", id_col).agg(
        F.count("*").alias("matched"), F.max("_n").alias("_n"), (F.max("first_at") - F.min("first_at")).alias("_span"), F.sum("tf").alias("_tf")
    )
    each = each.where(F.col("matched") == F.col("_n")) if mode == "all" else each
    return each.select("query_id", id_col, "matched", _score(F.col("matched"), F.col("_n"), F.col("_span"), F.col("_tf")).alias("score"))


#: Scores closer than this may be put in another order by rounding; ids of a task's best rows are kept for each of them.
CLOSE = 2e-9
#: Cells of a block of rows and terms.
CELLS = 1 << 21


class _Best:
    """A question's best ``k`` rows of a task, and those whose value is within ``close`` of the last of them.

    Of rows of one value the ``k`` smallest ids suffice, however many there are.
    """

    def __init__(self, k: int, close: float):
        self.k, self.close, self.least, self.parts, self.n = k, close, -np.inf, [], 0

    def add(self, value: np.ndarray, ids: np.ndarray, *fields: np.ndarray) -> None:
        keep = np.flatnonzero(value >= self.least - self.close)
        if len(keep):
            self.parts.append([x[keep] for x in (value, ids, *fields)])
            self.n += len(keep)
            if self.n > 8 * self.k + 256:
                self.cut()

    def cut(self) -> list[np.ndarray]:
        all_ = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        order = np.argsort(all_[1], kind="stable")
        order = order[np.argsort(-all_[0][order], kind="stable")]
        value = all_[0][order]
        start = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        place = np.arange(len(value)) - np.repeat(start, np.diff(np.r_[start, len(value)]))
        order, value = order[place < self.k], value[place < self.k]
        if len(value) >= self.k:
            self.least = value[self.k - 1]
            order = order[value >= self.least - self.close]
        self.parts, self.n = [[x[order] for x in all_]], len(order)
        return self.parts[0]


def _quoted(token: np.ndarray, row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Rows in which the tokens of a phrase stand one after the other."""
    n = len(phrase)
    at = np.flatnonzero(token[: len(token) - n + 1] == phrase[0]) if len(token) >= n else np.empty(0, dtype=int)
    for i in range(1, n):
        at = at[token[at + i] == phrase[i]]
    return np.unique(row[at[row[at] == row[at + n - 1]]])


def best_where_they_lie(rows: DataFrame, terms: DataFrame, id_col: str, k: int, phrases: DataFrame | None = None, overlap: int = 1) -> DataFrame:
    """``(query_id, id, matched, quoted, _n, _span, _tf)``: for each question a superset of its best ``k`` rows, of which each task gives few.

    ``rows``: ``words`` of rows with ids of their own; ``terms``: (query_id, token), held by every task; ``phrases``: (query_id, phrase, place,
    token).  Best are rows of the highest score of ``lexical_lane`` in mode ``any``, or with ``phrases`` those that hold most phrases, then
    most terms, ``overlap`` at least if none; of equal ones those of smaller ids.
    """
    of = terms.distinct().groupBy("query_id").agg(F.collect_list("token").alias("all"))
    if phrases is not None:
        told = phrases.groupBy("query_id", "phrase").agg(F.transform(F.array_sort(F.collect_set(F.struct("place", "token"))), lambda x: x["token"]).alias("p"))
        of = of.join(told.groupBy("query_id").agg(F.collect_list("p").alias("phrases")), "query_id", "full")
    asked = [(r["query_id"], r["all"] or [], (r["phrases"] or []) if phrases is not None else []) for r in of.collect()]
    vocabulary = sorted({t for _, all_, told in asked for x in (all_, *told) for t in x})
    shared = rows.sparkSession.sparkContext.broadcast((asked, vocabulary))
    kinds = terms.schema["query_id"].dataType.simpleString(), rows.schema[id_col].dataType.simpleString()
    made = T._parse_datatype_string(f"query_id {kinds[0]}, `{id_col}` {kinds[1]}, matched bigint, quoted bigint, _n bigint, _span bigint, _tf bigint")
    close, by_phrase = (0.0, True) if phrases is not None else (CLOSE, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, vocabulary = shared.value
        number, values = {t: i for i, t in enumerate(vocabulary)}, pa.array(vocabulary, pa.string())
        wanted = [np.array([number[t] for t in all_], dtype=np.int64) for _, all_, _ in asked]
        phrases = [[np.array([number[t] for t in p], dtype=np.int64) for p in told] for _, _, told in asked]
        best, kind = [_Best(k, close) for _ in asked], None
        step = max(1, CELLS // max(len(vocabulary), 1))
        for batch in batches:
            kind = batch.schema.field(0).type
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                ids, lists, n = part.column(0).to_numpy(zero_copy_only=False), part.column(1), part.num_rows
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                token = pc.fill_null(pc.index_in(lists.flatten(), value_set=values), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(n), sizes)
                at = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                known = np.flatnonzero(token >= 0)
                columns, c = np.unique(token[known], return_inverse=True)
                place = np.full(len(vocabulary), -1)
                place[columns] = np.arange(len(columns))
                cell = c * n + row[known]
                tf = np.bincount(cell, minlength=n * len(columns)).reshape(len(columns), n)
                first = np.full(n * len(columns), 1 << 40)
                np.minimum.at(first, cell, at[known])
                first = first.reshape(len(columns), n)
                for q, own in enumerate(wanted):
                    held = place[own]
                    held = held[held >= 0]
                    where = first[held]
                    matched = (tf[held] > 0).sum(axis=0)
                    quoted = np.zeros(n, dtype=np.int64)
                    for p in phrases[q]:
                        if (place[p] >= 0).all():
                            quoted[_quoted(token, row, p)] += 1
                    keep = np.flatnonzero((matched >= overlap) | (quoted > 0))
                    if not len(keep):
                        continue
                    where, times, m = where[:, keep], tf[held][:, keep].sum(axis=0), matched[keep]
                    span = np.where(where < 1 << 40, where, -1).max(axis=0, initial=-1) - where.min(axis=0, initial=1 << 40)
                    span = np.where(m > 0, span, 0)
                    value = quoted[keep] * float(1 << 20) + np.where(m >= overlap, m, 0) if by_phrase else m / max(len(own), 1) * (1 + 1 / (1 + span / 100.0)) * np.log1p(times)
                    best[q].add(value, ids[keep], m, quoted[keep], span, times)
        for (query, all_, _), b in zip(asked, best, strict=True):
            if b.n:
                _, ids, m, quoted, span, times = b.cut()
                columns = [pa.array([query] * len(ids)), pa.array(ids, kind), m, quoted, np.full(len(ids), len(all_)), span, times]
                arrow = to_arrow_schema(made)
                yield pa.RecordBatch.from_arrays([(x if isinstance(x, pa.Array) else pa.array(x)).cast(f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    small_batches(rows.sparkSession)
    return rows.select(id_col, "words").mapInArrow(run, made)


def best_of_any(rows: DataFrame, terms: DataFrame, id_col: str, k: int) -> DataFrame:
    """``(query_id, id, score, rank)``: the best ``k`` rows by ``lexical_lane`` in mode ``any``, scores rounded to nine places; ties to the smaller id.

    ``rows``: ``words``.  Where every task can hold the questions, rows with an id of their own aren't moved, and a task gives its best rows only.
    """
    own, shared = apart(rows, id_col) if fits(terms) else (None, rows)
    found = [lexical_lane(shared, terms, id_col, "any").select("query_id", id_col, "score")] if shared is not None else []
    if own is not None:
        score = _score(F.col("matched"), F.col("_n"), F.col("_span"), F.col("_tf"))
        found.append(best_where_they_lie(own, terms, id_col, k).select("query_id", id_col, score.alias("score")))
    every = found[0].unionByName(found[-1]) if len(found) > 1 else found[0]
    every = every.withColumn("score", F.round("score", 9))
    return top_per_group(every, ["query_id"], [F.desc("score"), F.col(id_col)], k, rank="rank")


def prefix_lane(found: DataFrame, terms: DataFrame, id_col: str, mode: str = "all") -> DataFrame:
    """As ``lexical_lane`` with terms of four characters or more cut to a prefix (``prefix_key``); shorter ones exact."""
    key = prefix_key(F.col("token")).alias("token")
    cut = terms.select("query_id", key).distinct()
    if "words" in found.columns:
        return lexical_lane(found.withColumn("words", F.transform("words", lambda w: prefix_key(w))), cut, id_col, mode)
    if "tf" not in found.columns:
        return lexical_lane(found.select(id_col, "at", key), cut, id_col, mode)
    hits = found.select(id_col, key, "tf", "first_at").groupBy(id_col, "token").agg(F.sum("tf").alias("tf"), F.min("first_at").alias("first_at"))
    return lexical_lane(hits, cut, id_col, mode)


def ladder(passes: Sequence[DataFrame], id_col: str, enough: int = 8) -> DataFrame:
    """Exact, then relaxed passes: a pass counts for a query only while those before it gave too few.

    A row keeps its first pass.  All passes are in one plan; the running number of distinct
    hits per query decides, from a table of counts per query and pass.
    """
    rows = None
    for i, p in enumerate(passes):
        part = p.withColumn("pass", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    first = top_per_group(rows, ["query_id", id_col], [F.col("pass")], 1)
    counts = first.groupBy("query_id", "pass").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("query_id").orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = counts.withColumn("_before", before).where(F.col("_before") < enough).select("query_id", "pass")
    return first.join(used, ["query_id", "pass"])


def relaxation(postings_: DataFrame, terms: DataFrame, id_col: str, enough: int = 8) -> DataFrame:
    """``(query_id, id, pass)`` of exact terms (0), prefixes of all terms of four characters or more (1) and of any (2), as ``ladder`` has them.

    How many rows the first two passes give is counted by themselves; all three are then decided together, where a row's tokens lie.
    """
    longer = terms.where(F.length("token") >= 4)
    strict = [lane(postings_, t, id_col).select("query_id", id_col, F.lit(i).alias("pass")) for i, (lane, t) in enumerate([(lexical_lane, terms), (prefix_lane, longer)])]
    first = strict[0].unionByName(strict[1]).groupBy("query_id", id_col).agg(F.min("pass").alias("pass"))
    counts = first.groupBy("query_id").agg(F.count_if(F.col("pass") == 0).alias("_exact"), F.count("*").alias("_both"))
    word = lambda kind, token: F.struct(F.lit(kind).alias("kind"), token.alias("word"))
    of = lambda df, kind, token: df.select("query_id", word(kind, token).alias("w")).distinct().withColumn("_k", F.count("*").over(Window.partitionBy("query_id")))
    wanted = of(terms, 0, F.col("token")).unionByName(of(longer, 1, prefix_key(F.col("token")))).join(counts, "query_id", "left")
    wanted = wanted.select("query_id", "w", "_k", F.coalesce("_exact", F.lit(0)).alias("_exact"), F.coalesce("_both", F.lit(0)).alias("_both"))
    tokens = term_hits(postings_, terms, id_col, prefixes=True)
    words = tokens.select(id_col, F.explode(F.array(word(0, F.col("token")), word(1, prefix_key(F.col("token"))))).alias("w")).groupBy(id_col, "w").agg(F.count("*").alias("_n"))
    of_kind = lambda kind: F.count_if(F.col("w.kind") == kind)
    size = lambda kind: F.max(F.when(F.col("w.kind") == kind, F.col("_k")))
    each = words.join(F.broadcast(wanted) if fits(terms) else wanted, "w").groupBy("query_id", id_col).agg(
        of_kind(0).alias("_e"), of_kind(1).alias("_p"), size(0).alias("_ne"), size(1).alias("_np"), F.first("_exact").alias("_exact"), F.first("_both").alias("_both")
    )
    stage = F.when(F.col("_e") == F.col("_ne"), 0).when(F.col("_p") == F.col("_np"), 1).when(F.col("_p") > 0, 2)
    before = F.when(F.col("pass") == 0, 0).when(F.col("pass") == 1, F.col("_exact")).otherwise(F.col("_both"))
    return each.withColumn("pass", stage).where(F.col("pass").isNotNull() & (before < enough)).select("query_id", id_col, "pass")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for empty or unequal lengths or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


#: Rows of a block of vectors and of a block of questions.
VECTORS, QUESTIONS = 8192, 512


def _block_best(k: int, names: tuple[str, str]):
    """The best ``k`` of one block of vectors for each question of one block, by one matrix product per length."""

    def units(rows: pd.Series) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        sizes = np.array([0 if v is None else len(v) for v in rows])
        out = {}
        for n in set(sizes.tolist()) - {0}:
            at = np.flatnonzero(sizes == n)
            m = np.array([rows.iloc[i] for i in at], dtype=float)
            norm = np.sqrt((m * m).sum(axis=1))
            out[n] = (at[norm > 0], m[norm > 0] / norm[norm > 0, None])
        return sizes, out

    def run(questions: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        found = []
        asked, held = units(questions["q"])[1], units(vectors["v"])[1]
        ids, names_ = vectors["id"].to_numpy(), questions["query_id"].to_numpy()
        for n in asked.keys() & held.keys():
            (at, left), (place, right) = asked[n], held[n]
            for i, scores in zip(at, left @ right.T, strict=True):
                near = np.round(scores, 9)
                keep = np.arange(len(near))
                if len(keep) > k:
                    keep = np.flatnonzero(near >= np.partition(near, len(near) - k)[len(near) - k])
                best = keep[np.lexsort((ids[place[keep]], -near[keep]))[:k]]
                found += [(names_[i], ids[place[j]], float(scores[j]), float(near[j])) for j in best]
        return pd.DataFrame(found, columns=[*names, "near"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """Exact top ``k`` by cosine: ``(query_id, id, score, rank)``, ties (to nine decimals) to the smaller id.

    ``queries``: (query_id, q).  Questions and vectors meet in a grid of blocks of bounded size; each
    block gives its best rows only.  Empty, null and zero vectors and those of another length score nothing.
    """
    parts, groups = max(1, -(-vectors.count() // VECTORS)), max(1, -(-queries.count() // QUESTIONS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group")).withColumn("part", every(parts))
    right = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int").alias("part")).withColumn("group", every(groups))
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()
    run = _block_best(k, ("query_id", id_col, "score"))
    both = left.groupBy("group", "part").cogroup(right.groupBy("group", "part"))
    scored = both.applyInPandas(run, f"query_id {kinds[0]}, `{id_col}` {kinds[1]}, score double, near double")
    return top_per_group(scored, ["query_id"], [F.desc("near"), F.col(id_col)], k, rank="rank").select("query_id", id_col, "score", "rank")


def reciprocal_rank_fusion(lanes: dict[str, DataFrame], key: str, group: Sequence[str] = ("query_id",), first: int = 1) -> DataFrame:
    """Sum over lanes of 1 / (60 + best rank); lanes have ``key`` and ``rank`` (from 1).

    ``first`` is the rank that counts for the best: 1, or 0 for zero-based fusion plus one.
    """
    rows = None
    for name, df in lanes.items():
        part = df.groupBy(*group, key).agg(F.min("rank").alias("rank")).withColumn("lane", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    share = 1.0 / (RRF_K + F.col("rank") - 1 + first)
    return rows.groupBy(*group, key).agg(F.sum(share).alias("score"), F.min("rank").alias("best_rank"), F.count("*").alias("lanes"))


def with_identity(scored: DataFrame, score: str = "score") -> DataFrame:
    """Marks hits of identity: their scores stand above all others, whatever the lane."""
    return scored.withColumn("score_kind", F.when(F.col(score) >= IDENTITY_SCORE, "identity").otherwise("relevance"))


def keyword_rerank(df: DataFrame, text: Column, keywords: Sequence[str], limit: int, group: Sequence[str] = (), order: str = "place") -> DataFrame:
    """0.35 of the score and 0.65 of the share of keywords found; unchanged if no more rows than the limit.

    Ties keep their earlier order.
    """
    if not keywords:
        return df.withColumn("reranked", F.col("score"))
    hit = sum((F.contains(F.lower(text), F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))
    n = F.count("*").over(Window.partitionBy(*[F.col(g) for g in group] or [F.lit(0)]))
    ranked = df.withColumn("reranked", F.when(n <= limit, F.col("score")).otherwise(0.35 * F.col("score") + 0.65 * hit / len(keywords)))
    return top_per_group(ranked, list(group) or [F.lit(0)], [F.desc("reranked"), F.col(order)], limit)


def diversify(df: DataFrame, document: str, place: str, cap: Column | int) -> DataFrame:
    """At most ``cap`` rows of a document, the best placed ones."""
    return top_per_group(df, [document], [F.col(place)], cap)


def excerpt(text: Column, term: Column, before: int = 80, after: int = 200) -> Column:
    """The text around a term's first place; its start where the term is missing."""
    at = F.greatest(F.call_function("instr", F.lower(text), F.lower(term)), F.lit(1))
    start = F.greatest(at - before, F.lit(1))
    return F.substring(text, start, F.lit(before + after))


def _cut(text: str, most: int) -> str:
    return text if len(text) <= most else text[:most] + "..."


def focused_lines(text: str, keywords: Sequence[str], most: int) -> str:
    """The line with most characters of keywords and its neighbours, up to five or the budget; without a hit the text's start."""
    lines = [x for x in map(str.strip, text.strip().splitlines()) if x]
    wanted = [k.strip().lower() for k in keywords if len(k.strip()) >= 3]
    score = [sum(min(24, len(k)) for k in wanted if k in x.lower()) for x in lines]
    if not any(score):
        return _cut(text.strip(), most) if lines else ""
    at = score.index(max(score))
    for radius in range(len(lines)):
        shown = lines[max(0, at - radius) : at + radius + 1]
        joined = " ".join(shown)
        if len(joined) >= most or len(shown) >= 5 or len(shown) == len(lines):
            break
    return _cut(joined, most)


def focused_excerpts(df: DataFrame, keywords: Column, most: int = 280, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, excerpt)`` of every text for the keywords in its row; null texts give an empty one."""

    def run(key: object, text: str | None, wanted: list[str] | None) -> Iterator[tuple]:
        yield key, focused_lines(text or "", wanted or [], most)

    kind = df.schema[id_col].dataType.simpleString()
    return flat_map(df.select(id_col, text_col, keywords.alias("keywords")), run, f"`{id_col}` {kind}, excerpt string")


def within_budget(df: DataFrame, line: Column, order: Sequence[str], budget: int = 22_000, extra: int = 11, group: Sequence[str] = ()) -> DataFrame:
    """Lines in order until the first one that would overflow; each costs its bytes and ``extra``."""
    w = Window.partitionBy(*group).orderBy(*order) if group else Window.orderBy(*order)
    return df.withColumn("used", F.sum(F.octet_length(line) + extra).over(w)).where(F.col("used") <= budget)


#: Bytes of literals that every task may hold.
LITERAL_BYTES = 32 << 20


def grounded(literals: DataFrame, corpus: DataFrame) -> DataFrame:
    """For each (query_id, literal) whether any evidence text of the query holds it.

    A text is tested where it lies against its query's literals, which are broadcast up to ``LITERAL_BYTES`` in all and
    joined beyond; only the literals found are shuffled, combined per task first.
    """
    asked = literals.groupBy("query_id").agg(F.collect_set("literal").alias("_all"))
    size = literals.agg(F.coalesce(F.sum(F.octet_length("literal") + 16), F.lit(0))).first()[0]
    held = corpus.join(F.broadcast(asked) if size <= LITERAL_BYTES else asked, "query_id").select("query_id", "_all", F.lower("evidence").alias("_text"))
    found = held.select("query_id", F.explode(F.filter("_all", lambda x: F.contains(F.col("_text"), F.lower(x)))).alias("literal")).distinct()
    known = literals.join(found.withColumn("supported", F.lit(True)), ["query_id", "literal"], "left")
    return known.select("query_id", "literal", F.coalesce("supported", F.lit(False)).alias("supported")).distinct()
