"""Repeated passages: bytes under a string of some length that also starts elsewhere.

Windows (strings of ``length`` bytes) that are equal meet, since each is named by the least hash
of the strings of ``anchor`` bytes in it.  Windows in a row with one name are a piece of a text;
names met at one place are dropped.  Equal pieces of one name become one with a count,
and whole names go to blocks of bounded size.  There the Burrows-Wheeler transform of the pieces is
searched backward, breadth first: a queue of intervals, each the suffixes that begin with one
string, is extended by a byte at a time, which gives the common prefixes of neighbouring
suffixes by increasing value.  It stops at ``length``: suffixes whose common prefix has no value by
then share a window.

A name whose pieces exceed a few blocks is split: its pieces are texts of their own, named by longer
anchors, up to whole windows.  Equal windows keep equal names at every step, so nothing is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE_ROWS, bucketed, map_rows, materialize, small_batches

#: Bytes of a block, so many of which a name may have before it is split, and the most windows of a piece.
BLOCK_BYTES, BLOCKS, WINDOWS = 1 << 18, 4, 512
#: Anchors of the steps, as shares of the window's length; the last one is the window itself.
ANCHORS = (0.32, 0.65, 0.85, 1.0)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The least (``np.minimum``) or greatest of each ``width`` numbers in a row."""
    if width == 1:
        return x
    count = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, x[-1])
    full[: len(x)] = x
    rows = full.reshape(-1, width)
    before = best.accumulate(rows, axis=1).ravel()
    after = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(after[:count], before[width - 1 : width - 1 + count])


class Anchors:
    """Names of the windows of texts; keeps the powers that it needs."""

    def __init__(self, length: int, anchor: int) -> None:
        self.length, self.anchor, self.width = length, anchor, length - anchor + 1
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def hashes(self, text: bytes) -> np.ndarray:
        """Mixed polynomial hashes of the strings of ``anchor`` bytes."""
        a, k, n = np.frombuffer(text, dtype=np.uint8).astype(np.uint64), self.anchor, len(text)
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((a + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        for shift in (32, 29):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def names(self, text: bytes) -> np.ndarray:
        """The name of each window: the least hash in it."""
        return slide(self.hashes(text), self.width, np.minimum)

    def met(self, text: bytes) -> np.ndarray:
        """The name at each place that names a window: one that comes twice may have equal windows, in one piece too."""
        if len(text) < self.length:
            return np.zeros(0, dtype=np.int64)
        h, none = self.hashes(text), np.zeros(self.width - 1, dtype=np.uint64)
        names = slide(h, self.width, np.minimum)
        return h[slide(np.concatenate((none, names, none)), self.width, np.maximum) == h].view(np.int64)

    def pieces(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names, first windows and numbers of windows of the runs of windows with one name, ``WINDOWS`` at most each."""
        if len(text) < self.length:
            return (np.zeros(0, dtype=np.int64),) * 3
        names = self.names(text).view(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        size = np.diff(np.append(starts, len(names)))
        parts = -(-size // WINDOWS)
        at = np.repeat(starts, parts) + WINDOWS * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
        return names[at], at, np.minimum(WINDOWS, np.repeat(starts + size, parts) - at)


#: Rows of an Arrow batch made of arrays.
ARRAY_ROWS = 1 << 16


def flat_arrays(df: DataFrame, fn: Callable[..., tuple], schema: str) -> DataFrame:
    """Rows made from each row of ``df``: ``fn`` gives a column each, an array first; numbers stand for equal values."""
    kinds = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kinds)

        def made(held: list[tuple]) -> pa.RecordBatch:
            sizes = [len(h[0]) for h in held]
            columns = [np.concatenate(c) if isinstance(c[0], np.ndarray) else np.repeat(np.array(c), sizes) for c in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        held, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                for row in zip(*(c.to_pylist() for c in batch.slice(i, SLICE_ROWS).columns), strict=True):
                    held.append(fn(*row))
                    size += len(held[-1][0])
                    if size >= ARRAY_ROWS:
                        yield made(held)
                        held, size = [], 0
        if size:
            yield made(held)
        pa.default_memory_pool().release_unused()  # the process serves further tasks

    small_batches(df.sparkSession)
    return df.mapInArrow(run, kinds)


def transform(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the pieces (a separator after each, all different) by their first ``length`` symbols, and their symbols.

    Prefix doubling; only suffixes that are still tied are sorted again.
    """
    joined = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8)
    n = len(joined)
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    symbol = joined.astype(np.uint16) + np.uint16(1)
    symbol[ends] = 0
    left = np.repeat(ends, np.diff(np.concatenate(([-1], ends)))) - np.arange(n)  # symbols before the separator
    key = np.zeros(n, dtype=np.int64)
    for i in range(7):  # 7 symbols of 9 bits
        key <<= 9
        if i < n:
            key[: n - i] |= np.where(left[: n - i] >= i, symbol[i:], 0).astype(np.int64)
    order = np.argsort(key, kind="stable")
    # suffixes that reach their separator differ from all others; equal keys stay in text order
    ranked = key[order]
    new = np.concatenate(([True], (ranked[1:] != ranked[:-1]) | (left[order[1:]] < 7)))
    rank = np.empty(n, dtype=np.int64)
    firsts = np.flatnonzero(new)
    rank[order] = np.repeat(firsts, np.diff(np.append(firsts, n)))
    done = 7
    while done < length:
        size = np.diff(np.append(firsts, n))
        tied = np.flatnonzero(np.repeat(size > 1, size))  # places in the order
        if not len(tied):
            break
        at = order[tied]
        pair = (rank[at] << 32) | rank[at + done]
        turn = np.argsort(pair, kind="stable")
        order[tied] = at[turn]
        pair = pair[turn]
        split = tied[np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))]
        fresh = np.zeros(n, dtype=bool)
        fresh[firsts] = True
        fresh[split] = True
        firsts = np.flatnonzero(fresh)
        rank[order] = np.repeat(firsts, np.diff(np.append(firsts, n)))
        done *= 2
    return order, symbol


def repeated_starts(pieces: list[bytes], counts: list[int], length: int) -> np.ndarray:
    """Whether a window of ``length`` bytes starts at each place of the joined pieces (one separator each) that occurs twice or more.

    A piece with a count stands for that many equal ones.
    """
    order, symbol = transform(pieces, length)
    order = order.astype(np.int32)
    n, m = len(order), len(pieces)
    last = symbol[order - 1]  # the transform; the separator before the first symbol is the last one
    by_symbol = np.argsort(last, kind="stable")
    by_symbol = by_symbol.astype(np.int32)
    mapped = np.empty(n, dtype=np.int32)  # where the suffix one symbol longer is
    mapped[by_symbol] = np.arange(n, dtype=np.int32)
    earlier, later = np.full(n, -1, dtype=np.int32), np.full(n, n, dtype=np.int32)  # the neighbours in the transform with the same symbol
    same = last[by_symbol[1:]] == last[by_symbol[:-1]]
    earlier[by_symbol[1:][same]], later[by_symbol[:-1][same]] = by_symbol[:-1][same], by_symbol[1:][same]
    known = np.zeros(n + 1, dtype=bool)
    known[[0, n]] = True
    low, high = np.zeros(1, dtype=np.int32), np.full(1, n, dtype=np.int32)
    for _ in range(length):
        # all suffixes of the queue's intervals, and which interval each is in
        size = high - low
        where = np.repeat(low - (np.cumsum(size, dtype=np.int32) - size), size) + np.arange(int(size.sum()), dtype=np.int32)
        first = where[earlier[where] < np.repeat(low, size)]
        final = where[later[where] >= np.repeat(high, size)]
        start, end = np.sort(mapped[first]), np.sort(mapped[final]) + 1
        # separators are different symbols that no string goes across; each is an interval at the very first step
        if not known[1]:
            seps = np.arange(m, dtype=np.int32)
            start, end = np.concatenate((seps, start[start >= m])), np.concatenate((seps + 1, end[start >= m]))
        fresh = ~known[end] & ((start >= m) | ~known[1])
        low, high = start[fresh], end[fresh]
        known[high] = True
        if not len(low):
            break
    bounds = np.flatnonzero(known)
    weights = np.repeat(np.asarray(counts, dtype=np.int64), [len(p) + 1 for p in pieces])[order]
    held = np.add.reduceat(weights, bounds[:-1]) >= 2
    out = np.zeros(n, dtype=bool)
    out[order] = np.repeat(held, np.diff(bounds))
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    left = np.repeat(ends, np.diff(np.concatenate(([-1], ends)))) - np.arange(n)
    return out & (left >= length)


def runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


SPANS = "array<struct<at: int, until: int>>"


def _blocks(length: int, block_bytes: int):
    """Over pieces (name, digest, body, count) with names together: spans of window starts that are repeated."""

    def search(held: list[tuple]) -> Iterator[tuple]:
        flags = repeated_starts([h[2] for h in held], [h[3] for h in held], length)
        at = 0
        for name, digest, body, _ in held:
            spans = list(zip(*runs(flags[at : at + len(body)]), strict=True))
            at += len(body) + 1
            if spans:
                yield name, digest, [{"at": a, "until": b} for a, b in spans]

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, size = [], 0
        for _, group in groupby(rows, key=lambda row: row[0]):
            group = list(group)
            more = sum(len(row[2]) + 1 for row in group)
            if held and size + more > block_bytes:
                yield from search(held)
                held, size = [], 0
            held += group
            size += more
        if held:
            yield from search(held)

    return run


def _spans(texts: DataFrame, length: int, step: int, block_bytes: int) -> DataFrame:
    """``(tid, check, spans)``: starts of repeated windows in ``texts`` (tid, check, body, copies), which are all different."""
    anchor = max(1, round(ANCHORS[step] * length))

    anchors = Anchors(length, anchor)

    def places(tid: int, check: int, body: bytes, copies: int) -> tuple:
        return (*anchors.pieces(body), tid, check, copies)

    def keys(body: bytes, copies: int) -> tuple:
        return anchors.met(body), copies

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        for tid, check, body, found in rows:
            for p in found:
                piece = body[p["at"] : p["at"] + p["n"] + length - 1]
                yield p["name"], hashlib.sha256(piece).digest()[:16], tid, check, p["at"], p["copies"], piece

    counted = flat_arrays(texts.select("body", "copies"), keys, "name bigint, copies bigint")
    again = counted.groupBy("name").agg(F.sum("copies").alias("n")).where("n > 1").select("name")
    met = flat_arrays(texts.select("tid", "check", "body", "copies"), places, "name bigint, at int, n int, tid bigint, check int, copies bigint")
    met = met.join(again, "name", "left_semi")
    # a text's places: bounded by its own length
    listed = met.groupBy("tid", "check").agg(F.collect_list(F.struct("name", "at", "n", "copies")).alias("found"))
    pieces = map_rows(
        texts.select("tid", "check", "body").join(listed, ["tid", "check"]).select("tid", "check", "body", "found"), cut,
        "name bigint, digest binary, tid bigint, check int, at int, copies bigint, piece binary",
    )
    pieces = materialize(pieces, "pieces")
    alike = materialize(pieces.groupBy("name", "digest").agg(F.max("piece").alias("piece"), F.sum("copies").alias("copies")), "alike")
    sizes = alike.groupBy("name").agg(F.sum(F.octet_length("piece") + 1).alias("bytes"))
    total, most = sizes.agg(F.sum("bytes"), F.max("bytes")).first()
    single = alike
    split = None
    if step + 1 < len(ANCHORS) and (most or 0) > BLOCKS * block_bytes:
        large = materialize(sizes.where(F.col("bytes") > BLOCKS * block_bytes).select("name"), "large")
        single = alike.join(large, "name", "left_anti")
        inner = alike.join(large, "name").select("name", "digest", F.col("piece").alias("body"), "copies")
        # a piece is known by its name and digest; one and the same piece may have several names
        inner = inner.select(F.xxhash64("name", "digest").alias("tid"), F.hash("digest", "name").alias("check"), "body", "copies", "name", "digest")
        inner = bucketed(inner.repartition("tid", "check"), "inner", "tid", "check")
        deeper = _spans(inner, length, step + 1, block_bytes)
        split = deeper.join(inner.select("tid", "check", "name", "digest"), ["tid", "check"]).select("name", "digest", "spans")
    parts = max(1, -(-(total or 0) // (16 * block_bytes)))
    ordered = single.select("name", "digest", "piece", "copies").repartition(parts, "name").sortWithinPartitions("name")
    marks = map_rows(ordered, _blocks(length, block_bytes), f"name bigint, digest binary, spans {SPANS}")
    marks = materialize(marks if split is None else marks.unionByName(split), "marks")
    moved = F.transform("spans", lambda s: F.struct((s["at"] + F.col("at")).alias("at"), (s["until"] + F.col("at")).alias("until")))
    back = pieces.select("name", "digest", "tid", "check", "at").join(marks, ["name", "digest"]).select("tid", "check", moved.alias("spans"))
    return back.groupBy("tid", "check").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(
    df: DataFrame, *, length: int = 200, block_bytes: int = BLOCK_BYTES, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row, and with ``keep_text`` the bytes ``kept``.

    Bytes are those of the text in UTF-8; null texts count as empty.  A byte goes if a string of ``length`` bytes over it
    starts anywhere else too, in the same text (overlaps count) or another; strings never cross
    texts and are judged on the input.  Rows that repeat are texts of their own, so both lose all bytes
    of a text that is long enough; null ids are kept as they are.  ``n_spans`` counts the maximal runs removed.
    Texts are told apart by 96 bits of their SHA-256.  Other columns of ``df`` don't matter.
    """

    def finish(rows: Iterator[tuple]) -> Iterator[tuple]:
        for tid, check, body, spans in rows:
            edge = np.zeros(len(body) + 1, dtype=np.int64)
            for s in spans or ():
                edge[s["at"]] += 1
                edge[s["until"] + length - 1] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(body, dtype=np.uint8)[~gone].tobytes()
            yield tid, check, len(body), int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(kept).hexdigest(), kept if keep_text else None

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    part = lambda at: F.conv(F.substring(F.sha2("body", 256), at, 16), 16, -10).cast("bigint")
    rows = df.select(F.col(id_col).alias("id"), text.alias("body")).select("id", "body", part(1).alias("tid"), F.shiftright(part(17), 32).cast("int").alias("check"))
    texts = bucketed(rows.groupBy("tid", "check").agg(F.max("body").alias("body"), F.count("*").alias("copies")), "texts", "tid", "check")
    spans = _spans(texts, length, 0, block_bytes)
    done = texts.select("tid", "check", "body").join(spans, ["tid", "check"], "left").select("tid", "check", "body", "spans")
    done = map_rows(done, finish, "tid bigint, check int, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]
    done = materialize(done.select("tid", "check", *columns), "kept")
    return rows.select("id", "tid", "check").join(done, ["tid", "check"]).select(F.col("id").alias(id_col), *columns)


ORACLE = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
m AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM m)),
s AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, g),
k AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, list(b ORDER BY a) AS ends, list(a ORDER BY a) AS starts FROM s GROUP BY r
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE list_aggregate(list_transform(range(0, n_spans + 1), lambda j:
    substr(h, 2 * (CASE WHEN j = 0 THEN 0 ELSE ends[j] END) + 1,
      2 * ((CASE WHEN j = n_spans THEN length(h) // 2 ELSE starts[j + 1] END) - (CASE WHEN j = 0 THEN 0 ELSE ends[j] END)))), 'string_agg', '') END)) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
