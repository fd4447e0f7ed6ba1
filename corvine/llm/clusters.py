"""Centroid clustering by Sort-means, in whole numbers.

Each round the driver holds the centroids alone: it orders, for each centroid, the others by
their distance from it.  A vector starts at the centroid of its previous assignment, at
distance d, and looks at the others in that order; by the triangle inequality one that lies
strictly beyond 2 d from the start cannot win, nor can any after it, so the scan stops there.

Vectors are dealt into buckets once and stay there.  A round reads them beside the previous
assignments (buckets of the same key, so nothing is shuffled) and writes assignments and, per
task and centroid, a row of sums; only those sums are aggregated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, shared_dir, small_batches
from .topk import quantise

#: Numbers of all centroids together, which the driver and every task hold.
CENTROID_NUMBERS = 1 << 22
#: Quantised components are smaller than this, so that squared distances fit 64 bits.
LARGEST = 1 << 27


def scan_orders(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others by distance (ties: smaller number first), and those squared distances."""
    k = len(centroids)
    order, far = np.zeros((k, max(0, k - 1)), dtype=np.int64), np.zeros((k, max(0, k - 1)), dtype=np.int64)
    for c in range(k):
        d = ((centroids - centroids[c]) ** 2).sum(axis=1)
        others = np.array([j for j in np.argsort(d, kind="stable") if j != c], dtype=np.int64)
        order[c], far[c] = others, d[others]
    return order, far


def assign(vectors: np.ndarray, previous: np.ndarray, centroids: np.ndarray, order: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number) and squared distance of each vector, scanned from ``previous``."""
    best, least = previous.copy(), np.zeros(len(vectors), dtype=np.int64)
    for c in range(len(centroids)):
        rows = np.flatnonzero(previous == c)
        x = vectors[rows]
        own = ((x - centroids[c]) ** 2).sum(axis=1)
        d, name, at = own.copy(), np.full(len(rows), c), np.arange(len(rows))
        for j, beyond in zip(order[c], far[c], strict=True):
            at = at[beyond <= 4 * own[at]]  # strictly beyond twice the distance: neither this one nor those after it
            if not len(at):
                break
            other = ((x[at] - centroids[j]) ** 2).sum(axis=1)
            wins = (other < d[at]) | ((other == d[at]) & (j < name[at]))
            d[at[wins]], name[at[wins]] = other[wins], j
        best[rows], least[rows] = name, d
    return best, least


def _round(centroids: np.ndarray):
    order, far = scan_orders(centroids)
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count, inertia = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            name, d = assign(x, batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), centroids, order, far)
            np.add.at(sums, name, x)
            count += np.bincount(name, minlength=k)
            np.add.at(inertia, name, d)
            nothing = pa.nulls(len(d), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(name, pa.int32()), pa.array(d), nothing, pa.nulls(len(d), pa.list_(pa.int64()))], names=NAMES
            )
        met = np.flatnonzero(count)
        if len(met):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(met), pa.int64()), pa.array(met, pa.int32()), pa.array(inertia[met]), pa.array(count[met]), pa.array(sums[met].tolist(), pa.list_(pa.int64()))],
                names=NAMES,
            )

    return run


NAMES = ["row", "cluster", "distance", "n", "sums"]
SCHEMA = "row bigint, cluster int, distance bigint, n bigint, sums array<bigint>"


def cluster_vectors(
    df: DataFrame, *, k: int = 8, rounds: int = 10, factor: int = 1024, width: int = 64, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for every vector kept.

    Kept are vectors of exactly ``width`` components, none null or non-finite, each turned into
    floor(factor * x); 2**27 and more in size is an error.  The first centroids are the ``k`` vectors with the
    smallest SHA-256 of ``seed:id`` (equal ids: the smaller vector first; null ids are none).
    Each of ``rounds`` rounds assigns all vectors (ties: smaller number) and sets every centroid
    that has vectors to the floor of their mean; then vectors are assigned once more.  Rows that
    repeat an id are vectors of their own; with fewer vectors there are fewer centroids; with
    none, or only null ids, no rows.  Other columns of ``df`` don't matter.
    """
    spark = df.sparkSession
    if k * width > CENTROID_NUMBERS:
        raise ValueError(f"k * width must be at most {CENTROID_NUMBERS}: every task holds the centroids")
    shared_dir(spark)
    small_batches(spark)
    fit = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    vector = F.col(vector_col)
    fitting = F.when(vector.isNotNull() & (F.size(vector) == width), F.forall(vector, fit)).otherwise(False)
    small = lambda x: F.when(F.abs(x) * factor < LARGEST, x).otherwise(F.raise_error(F.lit("a component is too large")).cast("double"))
    kept = df.where(fitting).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), quantise(F.transform(vector, lambda x: small(x.cast("double"))), factor).alias("v")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = bucketed(kept.repartition(parts, "row"), "vectors", "row")
    name: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.where(F.col("id").isNotNull()).orderBy(name, "v").limit(k).collect()
    kinds = df.schema[id_col].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"`{id_col}` {kinds}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    centroids = np.array([r.v for r in first], dtype=np.int64)
    met = vectors.select("row", "v", F.lit(0).alias("cluster"))
    for turn in range(rounds + 1):
        done = bucketed(met.mapInArrow(_round(centroids), SCHEMA), "assigned", "row")
        told = done.where("row IS NULL")
        if turn == rounds:
            break
        sums = told.select("cluster", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x"))
        counts = {r.cluster: r.n for r in told.groupBy("cluster").agg(F.sum("n").alias("n")).collect()}
        for r in sums.collect():  # k * width numbers
            centroids[r.cluster, r["at"]] = r.x // counts[r.cluster]
        met = vectors.select("row", "v").join(done.where("row IS NOT NULL").select("row", "cluster"), "row")
    inertia = {r.cluster: r.d for r in told.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    facts = [(c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    last = done.where("row IS NOT NULL").select("row", "cluster", "distance")
    ids = vectors.select("row", F.col("id").alias(id_col))
    return ids.join(last, "row").join(F.broadcast(facts), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10) -> str:
    """The same clusters in SQL, a step per round."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c := c.c)) AS m
  FROM v CROSS JOIN c{i} c GROUP BY r)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v
    FROM (SELECT a.m.c AS c, i, sum(x) AS s, count(*) AS n FROM a{i} a JOIN e USING (r) GROUP BY 1, 2) GROUP BY c) n USING (c))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
e AS MATERIALIZED (SELECT r, unnest(v) AS x, unnest(range(0, 64)) AS i FROM v),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM v WHERE vec_id IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id), v) <= {k}
),
{", ".join(steps)}
SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.c)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia,
  sha256(list_aggregate(c{rounds}.v, 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} ON c{rounds}.c = a.m.c
"""


ORACLE = oracle()
