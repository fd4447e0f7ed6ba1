"""Ranked lexical search, repeated passages and centroid clusters against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvine.llm import clusters, lexical, repeats

# ---- ranked lexical search


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_search(docs, items, k):
    """docs, items: (id, text); the rows of an item add up."""
    held = [(i, Counter(words(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(words(text))
    out = []
    for item, query in asked.items():
        scores = []
        for i, c in held:
            if c:
                m = 100 - 25 + 25 * sum(c.values()) * n // total
                s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, q in query.items() if w in c)
                if s > 0:
                    scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_search_on_edge_cases(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)] + ["Über", "ÀB", "the", "x1"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 30)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, " -- "), (7, "w1 w1 w2"), (7, "w1 w1 w2"), (None, "w3 w3 w4"), (None, "w3 w3 w4"), (303, "the " * 200_000 + "w5")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 9)))) for i in range(25)]
    items += [(25, None), (26, "nowhere found"), (27, "w1 W1 w1"), (27, "w2"), (None, "w3"), (28, "The the-the")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit("clash")).withColumn("term", F.lit(1)).repartition(5)
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    index = lexical.build_index(df, shard_bytes=2000)
    assert index.rows.select("shard").distinct().count() > 5
    assert found(lexical.search(index, asked, k=6), ["item_id", "rank", "doc_id", "score"]) == brute_search(docs, items, 6)
    assert lexical.search(index, asked.limit(0)).count() == 0
    assert lexical.search(lexical.build_index(df.limit(0)), asked).count() == 0


def test_search_in_blocks_with_salts(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERIES", 4)
    monkeypatch.setattr(lexical, "SHARDS_PER_SALT", 2)
    docs = [(i, f"common w{i % 7} w{i % 11}") for i in range(200)]
    items = [(i, f"common w{i % 13} common") for i in range(30)]
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id int, text string").repartition(3), shard_bytes=300)
    out = lexical.search(index, spark.createDataFrame(items, "item_id bigint, text string"), k=5)
    assert dict(out.dtypes)["doc_id"] == "int"
    assert found(out, ["item_id", "rank", "doc_id", "score"]) == brute_search(docs, items, 5)


@given(st.lists(st.integers(0, 2**62), max_size=60))
def test_packed_numbers(numbers):
    data, ends = lexical.pack(np.array(numbers, dtype=np.int64))
    assert lexical.unpack(data).tolist() == numbers and (not numbers or ends[-1] == len(data))


@given(st.lists(st.dictionaries(st.integers(0, 60), st.integers(0, 4), min_size=1), max_size=6), st.integers(1, 5))
def test_heap_merge(lists, k):
    pairs = [(sorted(x), [x[d] for d in sorted(x)]) for x in lists]
    sums = Counter()
    for x in lists:
        sums.update(x)
    best = sorted(((s, d) for d, s in sums.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]
    assert sorted(lexical.best_of_shard(pairs, k), key=lambda x: (-x[0], x[1])) == best


# ---- repeated passages


def brute_repeats(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        starts = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), starts, hashlib.sha256(kept).hexdigest()))
    return out


COLUMNS = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def check_repeats(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("body", F.lit("clash")).withColumn("tid", F.lit(1)).repartition(3)
    out = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in repeats.remove_repeats(df, **how).collect()}
    assert out == dict(enumerate(brute_repeats(texts, how["length"])))


def test_repeats_on_edge_cases(spark):
    rng = random.Random(2)
    sentence = lambda n: " ".join(rng.choice(["alpha", "béta", "gamma", "delta", "o", "ε"]) for _ in range(n))
    shared, other = sentence(30), sentence(12)
    texts = [None, "", "short", shared, shared, "x" + shared + "y", sentence(50), "a" * 700, "a" * 20, "ab" * 300, other + sentence(3) + other, shared[:60] + other]
    texts += [sentence(5) + shared[10:90] + sentence(5) for _ in range(12)] + [None, "\0" * 70, "\0" * 50]
    check_repeats(spark, texts, length=20)
    check_repeats(spark, texts, length=50)


def test_crowded_names_are_split(spark):
    rng = random.Random(3)
    core = "".join(rng.choice("abcdef ") for _ in range(36))
    texts = [f"{rng.random()}{core[:rng.randrange(20, 37)]}{rng.random()}" for _ in range(150)] + [f"{i % 9} and {core} or {i % 5}" for i in range(60)] + ["z" * 3000] * 2
    check_repeats(spark, texts, length=30, block_bytes=125)


def test_repeats_of_a_long_text_and_none(spark):
    rng = random.Random(4)
    part = "".join(rng.choice("abcdefghij ") for _ in range(5000))
    body = part + "".join(rng.choice("abcdefghij ") for _ in range(200_000)) + "#" + part[1000:]
    df = spark.createDataFrame([(1, body)], "doc_id bigint, text string")
    row = repeats.remove_repeats(df, length=200, keep_text=True).first()
    assert (row.n_removed, row.n_spans, len(row.kept)) == (8000, 2, len(body) - 8000)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


@settings(deadline=None, max_examples=150)
@given(st.lists(st.tuples(st.text("ab", max_size=40), st.integers(1, 2)), min_size=1, max_size=6), st.integers(1, 20))
def test_interval_expansion(pieces, length):
    bodies, counts = [p.encode() for p, _ in pieces], [c for _, c in pieces]
    seen = Counter()
    for b, c in zip(bodies, counts, strict=True):
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += c
    expected = [i + length <= len(b) and seen[b[i : i + length]] > 1 for b in bodies for i in range(len(b) + 1)]
    assert repeats.repeated_starts(bodies, counts, length).tolist() == expected


# ---- clusters


def brute_clusters(rows, k, rounds, factor, width):
    kept = [(i, tuple(math.floor(x * factor) for x in v)) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [list(v) for _, v in seeds]
    if not centroids:
        return []
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for turn in range(rounds + 1):
        named = [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for j in range(len(centroids)):
                mine = [v for (_, v), (_, n) in zip(kept, named, strict=True) if n == j]
                if mine:
                    centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    inertia = Counter()
    for d, j in named:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(kept, named, strict=True)), key=repr)


def check_clusters(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("cluster", F.lit("clash")).withColumn("row", F.lit(1)).repartition(3)
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    out = clusters.cluster_vectors(df, **how)
    assert found(out, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]) == brute_clusters(rows, factor=1024, **how)


def test_clusters_on_edge_cases(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(3 * (i % 4), 1) for _ in range(3)]) for i in range(200)]
    rows += [(200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, None, 2.0]), (204, [1.0, math.nan, 2.0]), (205, [math.inf, 0.0, 0.0]), (None, [0.5, 0.5, 0.5]), (7, [9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0])]
    check_clusters(spark, rows, k=8, rounds=10, width=3)
    check_clusters(spark, rows[:3] + rows[-3:], k=8, rounds=2, width=3)  # fewer vectors than centroids
    check_clusters(spark, [(i, [0.0, float(i % 2), 0.0]) for i in range(12)], k=5, rounds=3, width=3)  # equal vectors, empty centroids
    assert clusters.cluster_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert clusters.cluster_vectors(spark.createDataFrame([(None, [1.0, 2.0])], "vec_id bigint, embedding array<float>"), width=2).count() == 0


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(-9, 9), min_size=2, max_size=2), min_size=1, max_size=40), st.lists(st.lists(st.integers(-9, 9), min_size=2, max_size=2), min_size=1, max_size=7), st.randoms())
def test_scan_finds_the_nearest(vectors, centroids, rng):
    x, c = np.array(vectors, dtype=np.int64), np.array(centroids, dtype=np.int64)
    start = np.array([rng.randrange(len(c)) for _ in x])
    name, d = clusters.assign(x, start, c, *clusters.scan_orders(c))
    assert list(zip(d.tolist(), name.tolist(), strict=True)) == [min((int(((v - w) ** 2).sum()), j) for j, w in enumerate(c)) for v in x]
