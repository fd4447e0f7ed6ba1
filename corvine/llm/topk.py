"""Exact top-k by inner product: the three-phase uniform threshold algorithm.

Vectors are cut into ``slices`` of their dimensions.  A slice's part of a score is a local
score, and the score is the sum over the slices.

1. Each slice gives its ``k`` best candidates per query.  Their full scores are taken, and
   the ``k``-th best of these, ``t``, is a safe cutoff: the true ``k``-th score is no less.
2. ``t / slices`` goes to every slice.  A candidate of score ``t`` or more has a local score
   of at least that in some slice, so all candidates at or over it suffice.
3. The full scores of those candidates are resolved exactly where the block lies, which gives its ``k`` best; the best of all
   blocks stay.

Queries are a stated part of the rows.  They meet the candidates in blocks: a grid of
query groups and candidate groups, each of bounded size, dealt out by a hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a block of candidates and of a block of queries.
CANDIDATES, QUERIES = 8192, 512


def quantise(vector: Column, factor: int) -> Column:
    """floor(factor * x) of every component, each taken as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor))


def _usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def _inner(a: str, b: str) -> Column:
    parts = F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0).cast("bigint")))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s + x)


def _matrix(rows: pd.Series, width: int, dtype: type = np.int64) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=dtype)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    # the product of doubles is exact while sums stay below 2**53
    exact = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, left.shape[1]) < 2.0**53
    return (left.astype(float) @ right.T.astype(float)).astype(np.int64) if exact else left @ right.T


def _best(scores: np.ndarray, allowed: np.ndarray, k: int, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, candidate) of the ``k`` best allowed scores of each row, ties to the smaller id."""
    q, c = [], []
    for i in range(len(scores)):
        keep = np.flatnonzero(allowed[i])
        if len(keep) > k:
            least = np.partition(scores[i, keep], len(keep) - k)[len(keep) - k]
            keep = keep[scores[i, keep] >= least]
        best = keep[np.lexsort((own[keep], ids[keep], -scores[i, keep]))[:k]]
        q += [i] * len(best)
        c += best.tolist()
    return np.array(q, dtype=int), np.array(c, dtype=int)


def _listed(k: int):
    """Phase 1 of one block of queries, one of candidates and one slice: the ``k`` best local scores of each query."""

    def run(key: tuple, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query": [], "candidate": [], "slice": [], "part": []})
        width = max(max(map(len, queries["v"])), max(map(len, candidates["v"])), 1)
        scores = _scores(_matrix(queries["v"], width), _matrix(candidates["v"], width))
        asks, own = queries["row"].to_numpy(), candidates["row"].to_numpy()
        q, c = _best(scores, asks[:, None] != own[None, :], k, candidates["id"].to_numpy(), own)
        return pd.DataFrame({"query": asks[q], "candidate": own[c], "slice": key[0], "part": scores[q, c]})

    return run


def _sufficient(k: int, slices: int, step: int):
    """Phases 2 and 3 of a block: candidates with a local score of the cutoff's share in some slice, resolved; the ``k`` best of each query."""

    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query_id": [], "query": [], "id": [], "candidate": [], "score": []})
        width = slices * step
        left, right = _matrix(queries["v"], width), _matrix(candidates["v"], width)
        asks, own, ids = queries["row"].to_numpy(), candidates["row"].to_numpy(), candidates["id"].to_numpy()
        total, enough = np.zeros((len(left), len(right)), dtype=np.int64), np.zeros((len(left), len(right)), dtype=bool)
        for s in range(slices):
            part = _scores(left[:, s * step : (s + 1) * step], right[:, s * step : (s + 1) * step])
            enough |= part * slices >= queries["cutoff"].to_numpy()[:, None]
            total += part
        q, c = _best(total, enough & (asks[:, None] != own[None, :]), k, ids, own)
        return pd.DataFrame({"query_id": queries["id"].to_numpy()[q], "query": asks[q], "id": ids[c], "candidate": own[c], "score": total[q, c]})

    return run


def top_k(
    df: DataFrame, *, queries: Column, k: int = 5, factor: int = 256, slices: int = 2, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` best candidates of every query row.

    ``queries`` says which rows are queries (null: no); candidates are all rows but the query's
    own.  The score is the inner product of quantised vectors, the shorter one filled with
    zeros; ties go to the smaller id.  Rows whose vector is null or has a null or
    non-finite component take no part.  With fewer candidates than ``k``, all are given.  Rows that
    repeat an id count as rows of their own.
    """
    rows = df.where(_usable(F.col(vector_col))).select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(queries, F.lit(False)).alias("asks"),
        quantise(F.col(vector_col), factor).alias("v"),
    )
    rows = materialize(rows, "vectors")
    n, asking, width = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v"))).first()
    parts, groups = max(1, -(-n // CANDIDATES)), max(1, -(-asking // QUERIES))
    step = max(1, -(-(width or 0) // slices))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    candidates = rows.select("id", "row", "v", dealt(parts).alias("part")).withColumn("group", every(groups))
    asked = rows.where("asks").select("id", "row", "v", dealt(groups).alias("group")).withColumn("part", every(parts))

    def sliced(df: DataFrame) -> DataFrame:
        pick = F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda s: F.struct(s.alias("slice"), F.slice("v", s * step + 1, F.lit(step)).alias("v")))
        return fresh(df.select("id", "row", "group", "part", F.explode(pick).alias("s")).select("id", "row", "group", "part", "s.*"))

    # both sides come from one table: new column identities keep them apart in the cogroup
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    vectors = rows.select(F.col("row").alias("candidate"), F.col("id"), F.col("v").alias("cv"))
    asks = rows.where("asks").select(F.col("row").alias("query"), F.col("v").alias("qv"))
    # phase 1: as many pairs as lists are long
    keys = ["slice", "group", "part"]
    listed = sliced(asked).groupBy(keys).cogroup(sliced(candidates).groupBy(keys)).applyInPandas(_listed(k), "query bigint, candidate bigint, slice int, part bigint")
    top = Window.partitionBy("query", "slice").orderBy(F.desc("part"), "candidate")
    listed = listed.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select("query", "candidate").distinct()
    first = listed.join(vectors, "candidate").join(asks, "query").withColumn("score", _inner("qv", "cv"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id", "candidate")
    first = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k)
    cutoff = materialize(first.select(F.col("query").alias("row"), F.col("score").alias("cutoff")), "cutoffs")
    # phases 2 and 3: without k candidates there is no cutoff, and all rows suffice
    told = asked.join(cutoff, "row", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(-(1 << 62)).cast("bigint")))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"query_id {kind}, query bigint, id {kind}, candidate bigint, score bigint"
    keys = ["group", "part"]
    resolved = fresh(told).groupBy(keys).cogroup(fresh(candidates).groupBy(keys)).applyInPandas(_sufficient(k, slices, step), schema)
    ranked = resolved.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
e AS (SELECT vec_id, unnest(v) AS x, unnest(range(0, len(v))) AS i FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM e q JOIN e c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY 1, 2
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
