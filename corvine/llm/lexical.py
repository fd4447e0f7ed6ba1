"""Ranked lexical search: documents at a time, over compressed postings in shards.

A task cuts the documents it holds into shards of some megabytes and sorts each by id.  Of a
shard the index has a row per term (gaps of the documents' places and term frequencies as
variable-length numbers) and one row for its documents' ids and lengths; nothing is shuffled.

A search joins the queries' terms to the index and walks each shard on its own: a heap merges a
query's postings by document, and a bounded heap keyed by score, then id, keeps its best.
While that heap is full, lists whose largest parts together can't lift a document over its
least score are left out of the merge and only looked up.  The shards' best are merged last.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_rows, materialize

#: Bytes of text of a shard; queries that walk a shard in one task; shards for each salt of a term.
SHARD_BYTES, QUERIES, SHARDS_PER_SALT = 16 << 20, 512, 64
#: Bytes outside terms become spaces, A-Z small; all bytes of characters beyond ASCII belong to terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_FOLD).split()


def pack(numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers as variable-length bytes (seven bits each, low ones first), and where each one ends."""
    numbers = numbers.astype(np.uint64)
    size = np.ones(len(numbers), dtype=np.int64)
    for s in range(7, 64, 7):
        size += numbers >= np.uint64(1 << s)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for i in range(int(size.max(initial=0))):
        has = size > i
        low = (numbers[has] >> np.uint64(7 * i)) & np.uint64(127)
        out[(ends - size)[has] + i] = low.astype(np.uint8) | np.where(size[has] > i + 1, 128, 0).astype(np.uint8)
    return out.tobytes(), ends


def unpack(data: bytes) -> np.ndarray:
    """The numbers that ``pack`` wrote."""
    raw = np.frombuffer(data, dtype=np.uint8)
    last = raw < 128
    number = np.concatenate(([0], np.cumsum(last)[:-1])) if len(raw) else np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate(([True], last[:-1]))) if len(raw) else np.zeros(0, dtype=np.int64)
    shift = (np.arange(len(raw)) - starts[number]) * 7
    out = np.zeros(int(last.sum()), dtype=np.int64)
    np.add.at(out, number, (raw & 127).astype(np.int64) << shift)
    return out


def _documents(ids: list, lengths: list[int]) -> bytes:
    known = np.array([i is not None for i in ids], dtype=np.uint8)
    return known.tobytes() + np.array([i or 0 for i in ids], dtype=np.int64).tobytes() + np.array(lengths, dtype=np.int64).tobytes()


def _shard(docs: list[tuple]) -> Iterator[tuple]:
    """Rows (term, n, total, postings) of one shard of (id, text) pairs; the documents' row has no term."""
    docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
    number: dict[bytes, int] = defaultdict(lambda: len(number))
    named, tfs, counts, lengths = [], [], [], []
    for _, text in docs:
        words = terms(text)
        tf = Counter(words)
        named.append(np.fromiter((number[w] for w in tf), dtype=np.int64, count=len(tf)))
        tfs.append(np.fromiter(tf.values(), dtype=np.int64, count=len(tf)))
        counts.append(len(tf))
        lengths.append(len(words))
    yield "", sum(n > 0 for n in lengths), sum(lengths), _documents([d[0] for d in docs], lengths)
    term, tf, place = np.concatenate(named), np.concatenate(tfs), np.repeat(np.arange(len(docs)), counts)
    if not len(term):
        return
    order = np.argsort(term, kind="stable")
    term, tf, place = term[order], tf[order], place[order]
    starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    gaps = place.copy()
    gaps[1:] -= place[:-1]
    gaps[starts] = place[starts]
    data, ends = pack(np.stack([gaps, tf], axis=1).ravel())
    bounds = np.append(starts, len(term))
    cut = np.concatenate(([0], ends[2 * bounds[1:] - 1]))
    words = list(number)
    for i in range(len(starts)):
        yield words[term[starts[i]]].decode(), int(bounds[i + 1] - bounds[i]), None, data[cut[i] : cut[i + 1]]


@dataclass(frozen=True)
class Index:
    """Postings ``(shard, term, n, total, postings)``; the row of no term has a shard's documents."""

    rows: DataFrame
    id_type: str


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """Index every whole text: terms are runs of digits, letters A-Z (lower-cased) and characters beyond ASCII.

    Null texts have no term.  Ids are whole numbers; null ones come after all others.  Rows that
    repeat an id are documents of their own.  Other columns of ``docs`` don't matter.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        first = TaskContext.get().partitionId() << 32
        held, size, shards = [], 0, 0
        for key, text in rows:
            held.append((key, text))
            size += len(text)
            if size >= shard_bytes:
                yield from ((first + shards, *r) for r in _shard(held))
                held, size, shards = [], 0, shards + 1
        if held:
            yield from ((first + shards, *r) for r in _shard(held))

    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = map_rows(docs.select(F.col(id_col).cast("bigint"), body), run, "shard bigint, term string, n bigint, total bigint, postings binary")
    return Index(materialize(rows, "postings"), docs.schema[id_col].dataType.simpleString())


def best_of_shard(lists: list[tuple[list[int], list[int]]], k: int) -> list[tuple[int, int]]:
    """The ``k`` best (score, place) of postings lists (places ascending, their parts), scores above 0, ties to the smaller place."""
    lists = sorted(([d, p, max(p)] for d, p in lists if d), key=lambda x: x[2])
    bound = [0]
    for x in lists:
        bound.append(bound[-1] + x[2])
    at = [0] * len(lists)
    merge = [(d[0], i) for i, (d, _, _) in enumerate(lists)]
    heapq.heapify(merge)
    kept: list[tuple[int, int]] = []  # (score, -place): the least is the worst
    left_out = least = 0  # lists before left_out can't reach a place among the kept by themselves
    while merge:
        doc, score = merge[0][0], 0
        while merge and merge[0][0] == doc:
            i = merge[0][1]
            docs, parts, _ = lists[i]
            score += parts[at[i]]
            at[i] += 1
            if at[i] < len(docs):
                heapq.heapreplace(merge, (docs[at[i]], i))
            else:
                heapq.heappop(merge)
        for i in range(left_out - 1, -1, -1):
            if score + bound[i + 1] <= least:
                break
            docs, parts, _ = lists[i]
            at[i] = bisect_left(docs, doc, at[i])
            if at[i] < len(docs) and docs[at[i]] == doc:
                score += parts[at[i]]
        if score <= least:  # later places lose ties
            continue
        if len(kept) < k:
            heapq.heappush(kept, (score, -doc))
        else:
            heapq.heapreplace(kept, (score, -doc))
        if len(kept) == k and kept[0][0] > least:
            least = kept[0][0]
            out = left_out
            while out < len(lists) and bound[out + 1] <= least:
                out += 1
            if out > left_out:
                left_out = out
                merge = [x for x in merge if x[1] >= out]
                heapq.heapify(merge)
    return [(s, -d) for s, d in kept]


def _walk(k: int, documents: int, total: int, item: pa.DataType):
    names = ["item", "known", "doc", "score"]

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["term", "w", "postings", "askers"]).to_pylist()
        found: list[tuple] = []
        about = [r["postings"] for r in rows if r["term"] == ""]
        if about and len(rows) > 1:
            n = len(about[0]) // 17
            known = np.frombuffer(about[0], dtype=np.uint8, count=n)
            ids, lengths = np.frombuffer(about[0][n:], dtype=np.int64).reshape(2, n)
            m = 75 + (25 * lengths * documents) // total
            asked: dict[object, list] = defaultdict(list)
            for r in rows:
                if r["term"] == "":
                    continue
                gaps, tf = unpack(r["postings"]).reshape(-1, 2).T
                place = np.cumsum(gaps)
                part = r["w"] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[place]))
                places = place.tolist()
                by_count: dict[int, list[int]] = {}
                for a in r["askers"]:
                    if a["n"] not in by_count:
                        by_count[a["n"]] = (a["n"] * part).tolist()
                    asked[a["item"]].append((places, by_count[a["n"]]))
            for name, lists in asked.items():
                found += [(name, bool(known[d]), int(ids[d]), s) for s, d in best_of_shard(lists, k)]
        columns = list(zip(*found, strict=True)) or [(), (), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (item, pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=names)

    return run


def search(index: Index, queries: DataFrame, *, k: int = 20, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(item, rank, id, score)``: each item's ``k`` best documents with a score above 0; all, if fewer.

    N counts documents with a term, L all their terms, df a term's documents.  A term weighs
    floor(1000 ln((2 N + 2) / (2 df + 1))), a document of n terms has m = 75 + 25 n N div L, and a term's part is its weight
    times (10**9 tf) div (1000 tf + 12 m), for each time the item's text holds it.  Equal
    scores go to the smaller id, null ids last.  Rows of one item add up; null texts have no term.
    """
    spark = index.rows.sparkSession
    sums = index.rows.where("term = ''").agg(F.sum("n"), F.sum("total"), F.count("*")).first()
    documents, total, shards = (x or 0 for x in sums)
    item_type = queries.schema[item_col].dataType

    def words(rows: Iterator[tuple]) -> Iterator[tuple]:
        for item, text in rows:
            yield from ((item, w.decode(), n) for w, n in Counter(terms(text)).items())

    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    asked = map_rows(queries.select(F.col(item_col).alias("item"), body), words, f"item {item_type.simpleString()}, term string, n bigint")
    asked = materialize(asked.groupBy("item", "term").agg(F.sum("n").alias("n")), "asked")
    blocks = max(1, -(-asked.select("item").distinct().count() // QUERIES))
    weigh = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1))).cast("bigint")
    weights = index.rows.where("term <> ''").groupBy("term").agg(F.sum("n").alias("df")).join(asked.select("term").distinct(), "term").select("term", weigh.alias("w"))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")
    askers = asked.groupBy(block, "term").agg(F.collect_list(F.struct("item", "n")).alias("askers")).join(weights, "term")
    askers = materialize(askers, "askers")
    # a frequent term has a row in every shard: its rows go to several keys
    salts = max(1, shards // SHARDS_PER_SALT)
    salted = askers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    held = index.rows.where("term <> ''").withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(salts)).cast("int")).join(salted, ["term", "salt"])
    columns = ["shard", "block", "term", "w", "postings", "askers"]
    about = index.rows.where("term = ''").select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "term", F.lit(0).cast("bigint").alias("w"), "postings",
        F.lit(None).cast(askers.schema["askers"].dataType).alias("askers"),
    )
    walked = (
        held.select(*columns).unionByName(about).groupBy("shard", "block")
        .applyInArrow(_walk(k, documents, max(1, total), to_arrow_type(item_type)), f"item {item_type.simpleString()}, known boolean, doc bigint, score bigint")
    )
    found = walked.select("item", F.when(F.col("known"), F.col("doc")).alias("doc"), "score")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("doc").cast(index.id_type).alias(id_col), "score")


#: Terms as in ``terms``.
_TERMS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS words FROM documents),
s AS MATERIALIZED (SELECT count(*) FILTER (len(words) > 0) AS docs, sum(len(words))::BIGINT AS total FROM t),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
p AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
d AS (SELECT r, doc_id, 100 - 25 + ((25 * len(words) * docs) // total) AS m FROM t, s WHERE len(words) > 0),
x AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, sum(q.n * w.w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (r) GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 20
"""
