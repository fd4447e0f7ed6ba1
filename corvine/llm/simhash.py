"""SimHash near-duplicates, linked by pivot distance tables.

Fingerprints that differ in at most two bits agree on at least two of four 16-bit bands,
that is, have distance 0 there to each other and so equal distances to any reference.  Rows
meet on the six pairs of bands.  Among those that meet, a table of Hamming distances to
reference fingerprints (pivots), precomputed per fingerprint, discards a pair as soon as
the distances to some pivot differ by more than two (triangle inequality); the exact
distance verifies the rest.  Pivot distances alone cannot bring rows together at scale:
they lie within a few bits of 32, so a window of two around one keeps half of all rows.

Equal fingerprints are one node.  Where more than ``CROWD`` nodes meet on one pair of
bands, pairs are not compared: each of these nodes goes to the 65 points at most one bit
away, and nodes that share a point, hence differ in at most two bits, are tied to the least
of them.  Two fingerprints share such a point exactly if they differ in at most two bits,
so no link is lost, and a point has at most 65 nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialize
from .components import components, merged

SEED = 42
#: Bits in which linked fingerprints may differ; bands and balls below are made for it.
REACH = 2
BANDS, BAND_BITS = 4, 16
CROWD = 64
#: Reference fingerprints, eight to a packed table column.
PIVOTS = [xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(16)]
#: Shingles whose hashes are held at a time.
BLOCK = 1 << 16


def fingerprint(text: str, words_per_shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles (see ``fingerprints``), unsigned."""
    words = text.encode("utf-8").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    data = b" ".join(words)
    first = [0, *accumulate(len(w) + 1 for w in words)]
    span = min(words_per_shingle, len(words))
    total, votes = len(words) - span + 1, np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, BLOCK):
        stop = min(at + BLOCK, total)
        h = np.array([digest(data[s : e - 1], SEED) for s, e in zip(first[at:stop], first[at + span : stop + span])], dtype=">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > total).tobytes(), "big")


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """``(id, fp)`` of every whole text, ``fp`` as a signed 64-bit number.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are so many
    consecutive words, repeats included; a shorter text is one shingle, and one without
    words (or null) has fingerprint zero.  A bit is set if it is set in over half of the
    shingles' XXH64 hashes.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, text in rows:
            fp = fingerprint(text or "", words_per_shingle)
            yield key, fp - (fp >> 63 << 64)

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, text_col), run, f"`{id_col}` {kind}, fp bigint")


def _long(x: int) -> Column:
    return F.lit(x - (x >> 63 << 64)).cast("bigint")


def pivot_table(fp: Column) -> list[Column]:
    """Distances to all pivots, eight in a number of eight bytes each."""
    out = []
    for i in range(0, len(PIVOTS), 8):
        parts = [F.shiftleft(F.bit_count(fp.bitwiseXOR(_long(p))).cast("bigint"), 8 * k) for k, p in enumerate(PIVOTS[i : i + 8])]
        packed = parts[0]
        for x in parts[1:]:
            packed = packed.bitwiseOR(x)
        out.append(packed)
    return out


def _near(a: str, b: str) -> Column:
    """Is the greatest difference of the pivot distances within reach?"""
    keep = F.lit(True)
    for i in range(len(PIVOTS)):
        part = [F.shiftrightunsigned(F.col(f"{t}.pivots{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(255).cast("bigint")) for t in (a, b)]
        keep = keep & (F.abs(part[0] - part[1]) <= REACH)
    return keep


def _band_keys(fp: Column, bands: int = BANDS, bits: int = BAND_BITS, together: int = BANDS - REACH) -> list[Column]:
    """Numbers that are equal for fingerprints equal on some bands, a different one per choice of bands."""
    mask = (1 << bits) - 1
    band = [F.shiftrightunsigned(fp, bits * i).bitwiseAND(F.lit(mask).cast("bigint")) for i in range(bands)]
    out = []
    for n, chosen in enumerate(combinations(range(bands), together)):
        key = F.lit(n).cast("bigint")
        for i in chosen:
            key = F.shiftleft(key, bits).bitwiseOR(band[i])
        out.append(key)
    return out


def link(nodes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect all nodes within reach of each other.

    ``nodes``: (node, fp), one row per fingerprint.  Each link is between fingerprints that
    differ in at most ``REACH`` bits, and any two such are connected by links.
    """
    fp = F.col("fp")
    keyed = nodes.select("node", "fp", *[c.alias(f"pivots{i}") for i, c in enumerate(pivot_table(fp))], F.explode(F.array(*_band_keys(fp))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(keyed.join(sizes, "key"), "met")
    few = met.where(F.col("n") <= CROWD)
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(
        b,
        (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & _near("a", "b") & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= REACH),
    ).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    many = met.where(F.col("n") > CROWD).select("node", "fp").distinct()
    near = F.array(fp, *[fp.bitwiseXOR(_long(1 << i)) for i in range(64)])
    ball = many.select("node", F.explode(near).alias("point"))
    ties = ball.select(F.col("node").alias("a"), F.min("node").over(Window.partitionBy("point")).alias("b")).where("a != b")
    return pairs.unionByName(ties)


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """``(id, fp, component_id)``: a row per document with the least id that links reach.

    Documents without words share fingerprint zero and are linked like any others.  Ids
    must be whole numbers; a row with a null id is kept with what its text gives and counts
    for no component's id unless no other row has its fingerprint.  Repeated rows give
    repeated results; rows that repeat an id with another text go by their own text, and don't
    tie its component to the other's.
    """
    done = materialize(fingerprints(df, id_col=id_col, text_col=text_col, words_per_shingle=words_per_shingle), "fingerprints")
    # fingerprints are the nodes, so that an id that repeats doesn't tie two of them
    nodes = materialize(done.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    found = components(link(nodes.where(F.col("least").isNotNull()).select(F.col("fp").alias("node"), "fp")))
    parts = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    parts = materialize(parts, "parts")
    labels = parts.join(parts.groupBy("part").agg(F.min("least").alias("component_id")), "part").select("fp", "component_id")
    return done.join(labels, "fp").select(id_col, "fp", "component_id")


# ---- near copies of lower similarity: several fingerprints of one text

#: Fingerprints of a text, and of one at a fuller key.
SKETCHES, FINE = 8, 32
#: Keys that texts meet on, and least hashes (MinHash) that a key is made of.  A key is equal for
#: texts of similarity s with probability s**6: of pairs at 0.8 all 24 differ in 7 of 10,000.
KEYS, LEAST = 24, 6
#: Texts at a key that links leave apart are compared pair by pair up to this number; more go by prefixes.
FEW = 32
#: Hubs more that texts of a fuller key are compared with.
HUBS = 8
#: Shingles whose frequency orders the prefixes (8 bytes each, broadcast); the order changes no result.
COMMON = 1 << 16
#: Constants that make fingerprints from one hash (splitmix64), and orders of hashes. Fixed values.
_STEP, _MIX = 0x9E3779B97F4A7C15, ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))
_STEPS = np.array([[_STEP * k & (1 << 64) - 1] for k in range(FINE)], dtype=np.uint64)
_ORDERS = np.array([[xxhash.xxh64_intdigest(b"order %d" % i, SEED), xxhash.xxh64_intdigest(b"factor %d" % i, SEED) | 1] for i in range(KEYS * LEAST)], dtype=np.uint64)


def shingle_hashes(text: str, words_per_shingle: int = 5) -> np.ndarray:
    """XXH64 hashes of a text's distinct shingles, in order; none without words."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    data = b" ".join(words)
    first = [0, *accumulate(len(w) + 1 for w in words)]
    span = min(words_per_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(data[s : e - 1], SEED) for s, e in zip(first, first[span:])], dtype=np.uint64))


def sketch(hashes: np.ndarray, sketches: int = SKETCHES) -> list[int]:
    """So many independent 64-bit SimHashes of distinct shingles (up to ``FINE``), signed; zeros without any."""
    votes = np.zeros((sketches, 64), dtype=np.int64)
    block = BLOCK * SKETCHES // sketches
    for at in range(0, len(hashes), block):
        z = hashes[None, at : at + block] + _STEPS[:sketches]
        for shift, factor in _MIX:
            z = (z ^ z >> np.uint64(shift)) * np.uint64(factor)
        for k in range(sketches):
            votes[k] += np.unpackbits(z[k].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes), axis=1).view(">i8").ravel().astype(np.int64).tolist()


def meeting_keys(hashes: np.ndarray) -> list[int]:
    """Keys of distinct shingles, signed; none without any."""
    if not len(hashes):
        return []
    least = np.full(len(_ORDERS), (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(hashes), BLOCK >> 5):
        np.minimum(least, ((hashes[None, at : at + (BLOCK >> 5)] ^ _ORDERS[:, :1]) * _ORDERS[:, 1:]).min(axis=1), out=least)
    found = [xxhash.xxh64_intdigest(least[LEAST * i : LEAST * (i + 1)].tobytes(), i) for i in range(KEYS)]
    return [x - (x >> 63 << 64) for x in found]


def most_bits(similarity: float, sketches: int = SKETCHES, deviations: float = 4) -> int:
    """Bits in which texts of that Jaccard similarity differ, and so many standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * sketches
    return round(n * p + deviations * math.sqrt(n * p * (1 - p)))


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The shingles one of which any set of that similarity must hold among its own such shingles.

    Sets are ordered alike: shingles that aren't in ``common`` first, by hash, then those of
    ``common``, seldom ones first.  Two sets of the similarity share all but so few shingles that
    the first of those they share lies in both prefixes.
    """
    n = len(hashes) - math.ceil(similarity * len(hashes)) + 1
    if not len(common):
        return hashes[:n]
    by_hash = np.argsort(common)
    at = by_hash[np.minimum(np.searchsorted(common, hashes, sorter=by_hash), len(common) - 1)]
    rank = np.where(common[at] == hashes, at, -1)
    return hashes[np.argsort(rank, kind="stable")[:n]]


def _apart(one: str, two: str, sketches: int) -> Column:
    """Bits in which two columns of so many fingerprints differ."""
    return sum((F.bit_count(F.get(one, F.lit(k)).bitwiseXOR(F.get(two, F.lit(k)))) for k in range(sketches)), F.lit(0))


def pairs_of_prefixes(posted: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: nodes of different parts that a shingle of both prefixes allows the similarity.

    ``posted``: (node, part, shingle, at, size), a row per shingle of a prefix, ``at`` its place in the order
    of the set, ``size`` that of the set; and maybe ``fine``, its fingerprints, whose distance is then tested where a pair meets.  Sets whose first common shingle is at a place share at most what
    follows in either, so the place bounds their similarity (and every similar pair meets at that shingle).
    Of the nodes at a shingle, those of its most frequent part aren't compared with each other.
    """
    tally = posted.groupBy("shingle", "part").agg(F.count("*").alias("n"))
    mixed = tally.groupBy("shingle").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    met = posted.join(mixed.select("shingle", "main"), "shingle")
    x, y = met.where("part <> main").alias("x"), met.alias("y")
    of = lambda name: (F.col(f"x.{name}"), F.col(f"y.{name}"))
    (xs, ys), (xa, ya), (xp, yp), (xn, yn) = map(of, ("size", "at", "part", "node"))
    shared = F.least(xs - xa, ys - ya)
    on = (F.col("x.shingle") == F.col("y.shingle")) & (xp != yp) & (F.least(xs, ys) >= similarity * F.greatest(xs, ys))
    near = _apart("x.fine", "y.fine", FINE) <= most_bits(similarity, FINE) if "fine" in posted.columns else F.lit(True)
    return x.join(y, on & ((1 + similarity) * shared + 1e-6 >= similarity * (xs + ys)) & near).select(F.greatest(xn, yn).alias("a"), F.least(xn, yn).alias("b")).distinct()


def near_copies(df: DataFrame, *, similarity: float = 0.8, words_per_shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, component_id)`` of texts linked by the Jaccard similarity of their sets of shingles.

    Texts meet on keys of least hashes, sized for 0.8 (``KEYS``).  Those that meet on a
    key are first all compared with the least of them, the hub: that links a crowd of copies by as
    many pairs as it has rows; at keys with more than ``FEW`` texts, ``HUBS`` more of them are hubs.  What that leaves apart at a key is then decided: every pair, where
    at most ``FEW`` are left; texts of fuller keys meet anew, and exactly, on the seldom shingles of
    their prefixes, so that a passage which many share makes no pairs (``pairs_of_prefixes``); more fingerprints of
    these are compared at the shingle where two meet, so that near misses aren't carried further.
    Distances of several independent fingerprints (a table: each text's distance to its hubs, then
    the pair's) only discard pairs, four standard deviations beyond the similarity; the sets of
    shingles (as 64-bit hashes) of the others are compared, and nothing is linked on an estimate.
    Sets are made only for texts that meet another one.
    Ids must be whole numbers.  Null texts count as empty; texts without words are copies of each
    other; a row with a null id keeps what its text gives; repeated rows give repeated results.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, text in rows:
            hashes = shingle_hashes(text or "", words_per_shingle)
            yield key, xxhash.xxh3_128_digest(hashes.tobytes()), len(hashes), sketch(hashes), meeting_keys(hashes)

    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))
    done = materialize(map_rows(texts, run, f"`{id_col}` {kind}, digest binary, size int, fps array<bigint>, keys array<bigint>"), "sketches")
    # equal sets of shingles are one node
    nodes = materialize(done.groupBy("digest").agg(F.min(id_col).alias("node"), *[F.first(c).alias(c) for c in ("size", "fps", "keys")]), "nodes")
    keyed = nodes.where("node IS NOT NULL").select(F.explode("keys").alias("key"), "node")
    a, b = (nodes.select(F.col("node").alias(n), F.col("fps").alias(f"f{n}"), F.col("size").alias(f"n{n}")) for n in "ab")
    reach = most_bits(similarity)

    def measured(pairs: DataFrame) -> DataFrame:
        """Their distances, and whether these and the sizes of the sets allow the similarity."""
        near = (F.col("bits") <= reach) & (F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
        return pairs.join(a, "a").join(b, "b").withColumn("bits", _apart("fa", "fb", SKETCHES)).select("a", "b", "bits", near.alias("near"))

    def sets_of(asked: DataFrame) -> DataFrame:
        """(node, shingles) of nodes, from their texts; other texts that repeat a node's id are left out."""
        known = materialize(nodes.select("node", "digest").join(asked, "node", "left_semi"), "asked").hint("merge")
        digest = lambda hashes: xxhash.xxh3_128_digest(hashes.tobytes())

        def make(rows: Iterator[tuple]) -> Iterator[tuple]:
            for node, wanted, text in rows:
                hashes = shingle_hashes(text or "", words_per_shingle)
                if digest(hashes) == wanted:
                    yield node, hashes.view(np.int64)

        made = map_rows(known.join(texts, "node").select("node", "digest", "text"), make, f"node {kind}, shingles array<bigint>")
        return made.groupBy("node").agg(F.first("shingles").alias("shingles"))

    def alike(pairs: DataFrame) -> DataFrame:
        """Those whose sets of shingles have the similarity."""
        one, two = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"s{n}")) for n in "ab")
        both = F.size(F.array_intersect("sa", "sb"))
        close = both >= similarity * (F.size("sa") + F.size("sb") - both)
        return materialize(pairs.join(one, "a").join(two, "b").where(close).select("a", "b").distinct(), "close")

    hubs = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1").select("key", "hub")
    met = materialize(keyed.join(hubs, "key").select("key", "node", "hub"), "met")
    tables = materialize(measured(met.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()), "tables")
    # texts that meet no other need no set; the texts are read and moved once
    sets = materialize(sets_of(tables.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "sets")
    found = materialize(components(alike(tables.where("near").select("a", "b"))), "found")
    # fuller keys: so many hubs more, each compared with all that links don't connect to it yet
    parts = met.join(found, "node", "left").withColumn("part", F.coalesce("component", "node"))
    chosen = [F.min_by(F.struct("node", "part"), F.xxhash64(F.lit(i), "node")).alias(f"h{i}") for i in range(HUBS)]
    full = parts.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("least"), F.max("part").alias("most"), *chosen).where((F.col("n") > FEW) & (F.col("least") < F.col("most")))
    asked = parts.join(full.select("key", F.explode(F.array(*[f"h{i}" for i in range(HUBS)])).alias("h")), "key").where("part <> h.part")
    again = measured(asked.select(F.greatest("node", "h.node").alias("a"), F.least("node", "h.node").alias("b")).distinct())
    found = materialize(merged(found, alike(materialize(again.where("near").select("a", "b"), "again"))), "found")
    # what the hubs left apart: pairs at a key that no links connect
    known = met.join(found, "node", "left").withColumn("part", F.coalesce("component", "node"))
    split = known.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count("*").alias("n")).where("least < most").select("key", "n")
    left = materialize(known.join(split, "key").join(tables.select(F.col("a").alias("node"), F.col("b").alias("hub"), "bits"), ["node", "hub"], "left").select("key", "node", "part", F.coalesce("bits", F.lit(0)).alias("bits"), "n"), "left")

    x, y = left.where(F.col("n") <= FEW).alias("x"), left.where(F.col("n") <= FEW).alias("y")
    apart_at_key = (F.col("x.node") < F.col("y.node")) & (F.col("x.part") != F.col("y.part")) & (F.abs(F.col("x.bits") - F.col("y.bits")) <= reach)
    others = x.join(y, (F.col("x.key") == F.col("y.key")) & apart_at_key).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    others = measured(others).where("near").select("a", "b")
    crowd = materialize(left.where(F.col("n") > FEW).select("node", "part").distinct(), "crowd")
    if not crowd.isEmpty():
        few = sets.join(crowd.select("node"), "node", "left_semi")
        counted = few.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
        order = [r.shingle for r in counted.orderBy(F.desc("n"), "shingle").limit(COMMON).select("shingle").collect()]
        shared = df.sparkSession.sparkContext.broadcast(np.array(order[::-1], dtype=np.int64).view(np.uint64))

        def prefixes(rows: Iterator[tuple]) -> Iterator[tuple]:
            for node, shingles in rows:
                hashes = np.array(shingles, dtype=np.int64).view(np.uint64)
                fine = sketch(hashes, FINE)
                for at, x in enumerate(prefix(hashes, similarity, shared.value).view(np.int64).tolist()):
                    yield node, x, at, len(shingles), fine

        posted = materialize(map_rows(few.select("node", "shingles"), prefixes, f"node {kind}, shingle bigint, at int, size int, fine array<bigint>").join(crowd, "node"), "posted")
        others = others.unionByName(pairs_of_prefixes(posted, similarity)).distinct()
    found = merged(found, alike(materialize(others, "others")))
    labels = nodes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    return done.join(labels, "digest").select(id_col, "component_id")
