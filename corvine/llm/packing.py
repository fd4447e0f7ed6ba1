"""Best-fit packing of token sequences under several capacities.

Every piece of a document asks for three resources of a sequence: tokens, one document
slot, and attention cost (its length squared).  A piece goes to the open sequence that
has room in all three and fits best; otherwise it opens one.

Sequences are filled where the documents lie: a task packs its pieces in blocks, gives out
the sequences that are full enough and carries the rest into its next block.  Only the few
pieces left at the end of each task are shuffled and packed together, so neither the
number of sequences nor the work depends on one task or on the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize
from .tokens import library_encoder, share_library


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds, and how the fit is judged.

    ``weights`` are those of tokens, documents and attention cost, each as a share of its
    capacity.  ``fit`` is ``"norm"`` (least weighted norm of what would stay free) or
    ``"dot"`` (greatest weighted dot product of the free shares and the demand, relative
    to the free shares' norm).
    """

    tokens: int = 4096
    documents: int = 4096
    cost: float = 4096.0**2
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    fit: str = "norm"

    def __post_init__(self) -> None:
        if self.tokens < 1 or self.documents < 1 or self.cost < self.tokens**2:
            raise ValueError("a sequence must hold one piece of full length")
        if self.fit not in ("norm", "dot"):
            raise ValueError(f"unknown fit {self.fit}")


def fill(lengths: list[int], capacity: Capacity) -> list[list[int]]:
    """Assign pieces to sequences, long ones first; gives the pieces' numbers per sequence."""
    limit = np.array([[capacity.tokens], [capacity.documents], [capacity.cost]], dtype=float)
    weights = np.array(capacity.weights)
    needs = np.array([lengths, np.ones(len(lengths)), np.square(lengths, dtype=float)]) / limit
    free = np.empty((3, max(16, len(lengths))))
    bins: list[list[int]] = []
    closed = 0  # sequences before this one have no room for any piece that is left
    least = min(lengths, default=0)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = needs[:, i : i + 1]
        while closed < len(bins) and free[0, closed] * capacity.tokens < least - 0.5:
            closed += 1
        rest = free[:, closed : len(bins)]
        after = rest - need
        full = after.min(axis=0, initial=np.inf) < -1e-12
        if not full.all():
            if capacity.fit == "norm":
                cost = weights @ (after * after)
            else:
                cost = -(weights @ (rest * need)) / np.sqrt(weights @ (rest * rest) + 1e-30)
            cost[full] = np.inf
            at = closed + int(cost.argmin())
            bins[at].append(i)
            free[:, at] -= need[:, 0]
        else:
            free[:, len(bins)] = 1.0 - need[:, 0]
            bins.append([i])
    return bins


#: Pieces that a task packs at a time, and pieces per group of the final packing.
BLOCK, FINAL_BLOCK = 4096, 16384
#: A sequence with at most this share of its tokens free is given out at once.
SLACK = 0.002


def _placed(items: list[tuple], found: list[list[int]], number: Iterator[int]) -> Iterator[tuple]:
    for members in found:
        sequence, offset = next(number), 0
        for i in members:
            yield (*items[i], sequence, offset)
            offset += items[i][3]


def pack_documents(
    df: DataFrame, path: str, *, end_id: int, capacity: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pack all texts of ``df`` into sequences; a row per piece.

    A document is its text's ids, merged by the tokenizers library, and ``end_id``; those longer than ``capacity.tokens`` are
    cut into pieces of that length, the last one shorter.  Result: id, ``piece`` (from 0),
    ``start`` (ids of the document before it), ``length``, ``ids_crc32`` (of the
    little-endian 32-bit ids), ``sequence_id``, ``offset`` (gapless from 0 within the
    sequence), and with ``with_ids`` the piece's ``ids`` as binary.  Null texts count as
    empty and give a piece of ``end_id`` alone; rows with equal or null ids are packed each.
    """
    shared, end = share_library(df, path), end_id.to_bytes(4, "little")
    size = capacity.tokens

    def pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
        encode = library_encoder(shared).encode
        for key, text in rows:
            ids = encode(text or "") + end
            for k, at in enumerate(range(0, len(ids), 4 * size)):
                part = ids[at : at + 4 * size]
                yield key, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None

    def local(rows: Iterator[tuple]) -> Iterator[tuple]:
        first = TaskContext.get().partitionId() << 33
        number = iter(range(first, first + (1 << 33), 2))
        held: list[tuple] = []

        def settle() -> Iterator[tuple]:
            """Give out the full sequences of what is held and hold the rest."""
            nonlocal held
            found = fill([x[3] for x in held], capacity)
            free = [size - sum(held[i][3] for i in members) for members in found]
            full = [m for m, rest in zip(found, free, strict=True) if rest <= SLACK * size]
            rest = sorted((rest, m) for m, rest in zip(found, free, strict=True) if rest > SLACK * size)
            while rest and sum(len(m) for _, m in rest) > BLOCK // 2:
                full.append(rest.pop(0)[1])  # the fullest go, so that what is held stays bounded
            yield from _placed(held, full, number)
            held = [held[i] for _, m in rest for i in m]

        for piece in pieces(rows):
            if piece[3] == size:
                yield (*piece, next(number), 0)
                continue
            held.append(piece)
            if len(held) >= BLOCK:
                yield from settle()
        if held:
            yield from settle()
        yield from ((*piece, None, None) for piece in held)

    def final(rows: Iterator[tuple]) -> Iterator[tuple]:
        first = TaskContext.get().partitionId() << 33
        number = iter(range(first + 1, first + (1 << 33), 2))
        items = [row[:6] for row in rows]
        yield from _placed(items, fill([x[3] for x in items], capacity), number)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, sequence_id bigint, offset bigint"
    done = materialize(map_rows(df.select(id_col, text_col), local, schema), "packed")
    left = done.where(F.col("sequence_id").isNull())
    groups = -(-left.count() // FINAL_BLOCK)
    if groups:
        left = left.repartition(groups, F.xxhash64(id_col, "piece", "ids_crc32", "length"))
        done = done.where(F.col("sequence_id").isNotNull()).unionByName(map_rows(left, final, schema))
    return done if with_ids else done.drop("ids")
