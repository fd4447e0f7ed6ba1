"""Operators over token ids: encode, decode and count whole texts.

Texts are encoded where they lie (one narrow pass, no shuffle).  The vocabulary file is
read by the driver and broadcast; its size is fixed by the tokenizer, not by the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import tokenizers
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import kept, map_rows


def share(df: DataFrame, path: str) -> Broadcast:
    """Broadcast the vocabulary at ``path``, its whole tokens proved, to the workers of ``df``'s session."""
    vocabulary = bpe.Vocabulary.load(path)
    vocabulary.proved = bpe.Encoder(vocabulary).prove()
    return df.sparkSession.sparkContext.broadcast((path, vocabulary))


def share_library(df: DataFrame, path: str) -> Broadcast:
    """Broadcast the vocabulary at ``path`` and its file's text, from which a worker makes the library's model."""
    return df.sparkSession.sparkContext.broadcast((path, bpe.Vocabulary.load(path), Path(path).read_text(encoding="utf-8")))


def library_encoder(shared: Broadcast) -> bpe.Encoder:
    """The worker process's encoder whose pre-tokens the tokenizers library merges; texts are cut and words kept as by ``encoder``."""
    key, vocabulary, text = shared.value

    def make() -> bpe.Encoder:
        merge = tokenizers.Tokenizer.from_str(text).model.tokenize
        return bpe.Encoder(vocabulary, lambda symbols: [t.id for t in merge(symbols)])

    return kept(("library", key), make)


def encoder(shared: Broadcast) -> bpe.Encoder:
    """The worker process's encoder for a shared vocabulary."""
    key, vocabulary = shared.value
    return kept(("encoder", key), lambda: bpe.Encoder(vocabulary))


def decoder(shared: Broadcast) -> bpe.Decoder:
    key, vocabulary = shared.value
    return kept(("decoder", key), lambda: bpe.Decoder(vocabulary))


def encode_documents(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """Token ids of every whole text, as ``(id, n_tokens, ids)``; with ``decode`` also ``decoded``.

    ``ids`` is binary: little-endian unsigned 32-bit integers.  ``decoded`` is what the ids
    decode to, special tokens kept: for a vocabulary without a decoder, the tokens' strings
    joined by blanks.  Null texts count as empty (no ids, empty text); rows with a null id
    are kept; other columns of ``df`` are ignored; repeated rows give repeated results.
    """
    shared = share(df, path)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        enc = encoder(shared)
        dec = decoder(shared) if decode else None
        for key, text in rows:
            ids = enc.encode(text or "")
            yield (key, len(ids) // 4, ids) + ((dec.decode(ids).decode("utf-8"),) if dec else ())

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids binary" + (", decoded string" if decode else "")
    return map_rows(df.select(id_col, text_col), run, schema)


def decode_ids(df: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of binary token ids, as ``(id, decoded)``; null ids decode to the empty text."""
    shared = share(df, path)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        dec = decoder(shared)
        for key, ids in rows:
            yield key, dec.decode(ids or b"").decode("utf-8")

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, ids_col), run, f"`{id_col}` {kind}, decoded string")


def count_tokens(df: DataFrame, path: str, *, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of every whole text: ``(id, n_bytes, n_tokens, over_limit)``.

    Pre-tokens that are proved to be single tokens count one without any merging; only the
    others are encoded.  Null texts count as empty (0 bytes, 0 tokens).
    """
    shared = share(df, path)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        count = encoder(shared).count
        for key, size, text in rows:
            yield key, size, count(text)

    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = map_rows(df.select(id_col, F.octet_length(text).cast("bigint"), text), run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
