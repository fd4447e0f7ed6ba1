"""BPE operators against the tokenizers library, and packing against its rules."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvine.llm import bpe, packing, tokens

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
PARTS = ["a", "The", " ", "  ", "\n", "\t", "\xa0", ".", "!!", "'s", "ñ", "é", "́", "1", "2²", "日本", "\x1c", "\x00", "Σ", "ab", "<|endoftext|>", "\r\n", "\U0001f642", "x" * 90]


@pytest.fixture(scope="module", params=[WORD, BYTE], ids=["word", "byte"])
def both(request):
    vocabulary = bpe.Vocabulary.load(request.param)
    return Tokenizer.from_file(request.param), bpe.Encoder(vocabulary), bpe.Decoder(vocabulary)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
@example("")
@example("ΑΣ ΟΔΟΣ Σ İstanbul ǅ ẞß ŉ ﬁ")
@example("aaaa " * 40 + "b" * 700)
def test_equals_the_library(both, text):
    library, encoder, decoder = both
    ids = library.encode(text, add_special_tokens=False).ids
    found = encoder.encode(text)
    assert np.frombuffer(found, "<u4").tolist() == ids
    assert encoder.count(text) == len(ids)
    if encoder.vocabulary.lowercase:
        assert decoder.decode(found).decode() == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, max_size=30))
def test_backtracking_equals_merging(both, text):
    _, encoder, _ = both
    symbols = encoder.symbols(text)
    assert [encoder._string[i] for i in encoder.word_ids(text)] == bpe.merge_word(symbols, encoder._ranks)


def test_small_caches_change_nothing(both, monkeypatch):
    library, encoder, _ = both
    for name in ("WORD_CACHE", "CHUNK_CACHE", "PAIR_CACHE"):
        monkeypatch.setattr(bpe, name, 3)
    small = bpe.Encoder(encoder.vocabulary)
    text = "One two, three. Four five two one three!" * 5
    assert small.encode(text) == encoder.encode(text) and small.count(text) == encoder.count(text)


def test_decoder_blocks(both, monkeypatch):
    _, encoder, decoder = both
    ids = encoder.encode("Some words to decode, in blocks of three. " * 9)
    whole = decoder.decode(ids)
    monkeypatch.setattr(bpe.Decoder, "BLOCK", 3)
    assert decoder.decode(ids) == whole


def documents(spark):
    rows = [(1, "Hello there, world."), (2, None), (3, ""), (4, "word " * 9000), (1, "Hello there, world."), (None, "x y")]
    return spark.createDataFrame([(*r, "extra", 7) for r in rows], "doc_id bigint, text string, n_tokens string, ids int")


def test_operators(spark):
    library = Tokenizer.from_file(WORD)
    found = tokens.encode_documents(documents(spark), WORD, decode=True).collect()
    assert len(found) == 6 and sorted(r.n_tokens for r in found) == [0, 0, 2, 5, 5, 9000]
    for r in found:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    again = tokens.decode_ids(spark.createDataFrame(found), WORD).collect()
    assert {hashlib.sha256(r.decoded.encode()).hexdigest() for r in again} == {hashlib.sha256(r.decoded.encode()).hexdigest() for r in found}
    counts = tokens.count_tokens(documents(spark), BYTE, limit=512).collect()
    assert sorted((r.n_bytes, r.over_limit) for r in counts) == [(0, False), (0, False), (3, False), (19, False), (19, False), (45000, True)]
    assert tokens.count_tokens(documents(spark).limit(0), BYTE, limit=1).count() == 0


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity.tokens and len(members) <= capacity.documents and sum(r.length**2 for r in members) <= capacity.cost
    return len(bins)


@pytest.mark.parametrize("capacity", [packing.Capacity(), packing.Capacity(fit="dot"), packing.Capacity(512, 3, 512**2 * 1.0), packing.Capacity(256, 8, 256**2 * 1.0, (1.0, 0.5, 0.5))])
def test_packing(spark, sf, capacity):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(documents(spark).select("doc_id", "text", F.lit("").alias("lang"), F.lit("").alias("source"), F.lit(0).cast("bigint").alias("n_chars")))
    rows = packing.pack_documents(docs.repartition(3), WORD, end_id=1, capacity=capacity, with_ids=True).collect()
    library = Tokenizer.from_file(WORD)
    expected = sorted((r.doc_id if r.doc_id is not None else -1, [*library.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect())
    found = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in expected)
    single = [r for r in rows if r.doc_id is not None and r.doc_id > 4]
    for r in sorted(single, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(found.setdefault(r.doc_id, []))
        found[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert found == {k: ids for k, ids in expected if k > 4}
    bins = check_packing(rows, capacity)
    if capacity == packing.Capacity():
        assert bins <= -(-sum(r.length for r in rows) // 4096) + 1


def test_packing_of_nothing(spark):
    assert packing.pack_documents(documents(spark).limit(0), WORD, end_id=1).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80), st.sampled_from(["norm", "dot"]))
def test_fill_respects_every_capacity(lengths, fit):
    capacity = packing.Capacity(100, 4, 10_000.0, fit=fit)
    bins = packing.fill(lengths, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    for b in bins:
        assert sum(lengths[i] for i in b) <= 100 and len(b) <= 4 and sum(lengths[i] ** 2 for i in b) <= 10_000
    # no two sequences could be one
    assert not any(sum(lengths[i] for i in a + b) <= 50 and len(a + b) <= 2 for a in bins for b in bins if a is not b)


def test_pairs_decided_by_last_merges(both):
    enc = both[1]
    known = list(enc.whole)
    draw = random.Random(7)
    alike = [t for t in known if len(set(t)) <= 2]  # runs of one character, where equal merges compete
    for pool in (known, alike):
        for _ in range(3000):
            a, b = draw.choice(pool), draw.choice(pool)
            if ord(a[-1]) < 0x400:  # a marked symbol ends its word
                assert enc.compatible(enc._id[a], enc._id[b]) == (bpe.merge_word([*a, *b], enc._ranks) == [a, b])
