"""Byte-pair encoding: a backtracking encoder and an offset-table decoder.

A word is turned into symbols (one per byte, the last one marked where the vocabulary
uses an end-of-word suffix).  An Aho-Corasick automaton gives the longest vocabulary
string at a position.  The encoder then takes the longest start of it that may stand after
the token before it, and steps back where none fits.  Two tokens may be neighbours when
the merges, run on the two strings joined, give exactly these two; the answers are kept
in a pair table, and so is the first start that fits, for a token and the longest string after it.  A chain of tokens is the merge result exactly when all its neighbours
are compatible, so the outcome equals that of the merges while each position is
given up at most once.  The answer for a pair comes from the last merges of both strings (``compatible``).

Everything here is plain Python over one word or one text; ``operators`` in
``tokens.py`` run it inside Spark tasks.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import regex

#: Shift that marks a symbol as the last one of its word.
_LAST = 0x400
#: Entries that a worker keeps of words, of blank-separated chunks and of token pairs before it starts afresh.
WORD_CACHE = 250_000
CHUNK_CACHE = 400_000
PAIR_CACHE = 500_000
#: What the tokenizers' regex engine takes as white space.
_SPACE = r"\t-\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in out)
    return [s for _, s in sorted((out | {b: chr(256 + i) for i, b in enumerate(hidden)}).items())]


@dataclass
class Vocabulary:
    """What of a tokenizer file the encoder and decoder need; small, so it can be broadcast."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    suffix: str
    specials: dict[str, int]
    lowercase: bool
    pattern: str
    #: Strings proved to encode alone as one token, where that was done (``Encoder.prove``), and their last merges.
    proved: dict[str, tuple[str, str] | None] | None = None

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        """Read a byte-level BPE file of the two layouts supported.

        Either the pre-tokenizer is the byte-level one with its own pattern and nothing is
        normalised, or texts are NFC-normalised and lower-cased and a ``Split`` pattern
        says what to keep.  Other layouts are refused rather than encoded wrongly.
        """
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        suffix = model.get("end_of_word_suffix") or ""
        if pre["type"] == "ByteLevel" and pre["use_regex"] and spec["normalizer"] is None:
            letters = rf"[^{_SPACE}\p{{L}}\p{{N}}]+"
            pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?{letters}|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
            return cls(model["vocab"], merges, suffix, specials, False, pattern)
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if pre["type"] == "Sequence" and kinds == ["NFC", "Replace", "Lowercase"]:
            pattern = pre["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", _SPACE)
            return cls(model["vocab"], merges, suffix, specials, True, pattern)
        raise ValueError(f"unsupported tokenizer layout in {path}")

    @property
    def size(self) -> int:
        return max([*self.ids.values(), *self.specials.values()], default=-1) + 1

    def strings(self) -> list[str]:
        """The vocabulary's string of each id, as decoding without a decoder shows it."""
        out = [""] * self.size
        for text, i in (*self.ids.items(), *self.specials.items()):
            out[i] = text
        return out


def merge_word(symbols: list[str], ranks: dict[tuple[str, str], int], seen: list[tuple[str, str]] | None = None) -> list[str]:
    """Apply merges by rank, leftmost first: the definition that the encoder must equal.  ``seen`` takes them down."""
    parts = list(symbols)
    while len(parts) > 1:
        least = at = -1
        for i in range(len(parts) - 1):
            rank = ranks.get((parts[i], parts[i + 1]), -1)
            if rank >= 0 and (at < 0 or rank < least):
                least, at = rank, i
        if at < 0:
            break
        if seen is not None:
            seen.append((parts[at], parts[at + 1]))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Encoder:
    """Encodes texts with one vocabulary; one instance per worker process.

    ``merge`` gives a pre-token's ids from its byte symbols, in place of the backtracking of this module.
    """

    def __init__(self, vocabulary: Vocabulary, merge: Callable[[str], list[int]] | None = None):
        self.vocabulary, self._merge = vocabulary, merge
        self._bytes = byte_symbols()
        self._table = dict(enumerate(self._bytes))
        suffix = vocabulary.suffix
        fold = lambda t: t[: -len(suffix) - 1] + chr(ord(t[-len(suffix) - 1]) + _LAST) if suffix and t.endswith(suffix) and len(t) > len(suffix) else t
        self._ranks = {(fold(a), fold(b)): i for i, (a, b) in reversed(list(enumerate(vocabulary.merges)))}
        self._id = {fold(t): i for t, i in vocabulary.ids.items()}
        self._string = {i: t for t, i in self._id.items()}
        self._pairs: dict[int, bool] = {}
        self._fits: dict[int, int] = {}
        self._words = _Cache(lambda word: array("I", self.word_ids(word)).tobytes(), WORD_CACHE)
        self._chunks = _Cache(self._chunk_ids, CHUNK_CACHE)
        self._chunk_counts = _Cache(lambda chunk: sum(map(self._counts.__getitem__, self._pieces(chunk))), CHUNK_CACHE)
        self._split = regex.compile(vocabulary.pattern).findall
        self._special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(vocabulary.specials, key=len, reverse=True)) + ")") if vocabulary.specials else None

    @functools.cached_property
    def whole(self) -> dict[str, tuple[str, str] | None]:
        """Vocabulary strings proved to encode alone as one token, and the last merge of each."""
        return self.vocabulary.proved if self.vocabulary.proved is not None else self.prove()

    def prove(self) -> dict[str, tuple[str, str] | None]:
        """Strings that are their own merge result; those that merges cannot reach, or reach differently, are left out."""
        out = {}
        for t in self._id:
            seen: list[tuple[str, str]] = []
            if merge_word(t, self._ranks, seen) == [t]:
                out[t] = seen[-1] if seen else None
        return out

    @functools.cached_property
    def _automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for t in self.whole:
            out.add_word(t, self._id[t])
        out.make_automaton()
        return out

    @functools.cached_property
    def _size(self) -> list[int]:
        """Symbols of each token's string."""
        return [len(self._string.get(i, "")) for i in range(self.vocabulary.size)]

    @functools.cached_property
    def _shorter(self) -> list[int]:
        """For each token the longest other one that its string starts with, or -1."""
        out = [-1] * self.vocabulary.size
        for t in self.whole:
            start = next((t[:k] for k in range(len(t) - 1, 0, -1) if t[:k] in self.whole), None)
            out[self._id[t]] = self._id[start] if start else -1
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Do the merges of both strings joined give just these two tokens?

        Only a merge across the border can prevent it.  The parts that stand at the border are the ends of
        ``left`` and the starts of ``right`` through their last merges; two of them stand there together until
        the earlier of the merges that take them up.  They join if their own merge comes before that one; of
        equal merges the leftmost goes first, so the right part's waits and the left part's doesn't.
        """
        known = self._pairs.get(left << 20 | right)
        if known is None:
            if len(self._pairs) >= PAIR_CACHE:
                self._pairs.clear()
            known = self._pairs[left << 20 | right] = self._apart(self._string[left], self._string[right])
        return known

    def _apart(self, a: str, b: str) -> bool:
        ranks, last = self._ranks, self.whole
        until_a = until_b = len(ranks) + len(self.vocabulary.merges)
        while True:
            rank = ranks.get((a, b), -1)
            if 0 <= rank < until_a and rank <= until_b:
                return False
            # back to the state before the later of the two last merges
            of_a, of_b = last[a], last[b]
            if of_a is None and of_b is None:
                return True
            if of_b is None or (of_a is not None and ranks[of_a] > ranks[of_b]):
                until_a, a = ranks[of_a], of_a[1]
            else:
                until_b, b = ranks[of_b], of_b[0]

    def first_fit(self, left: int, token: int) -> int:
        """The longest start of ``token``, itself included, that may stand after ``left``; -1 if none may."""
        known = self._fits.get(left << 20 | token)
        if known is None:
            if len(self._fits) >= PAIR_CACHE:
                self._fits.clear()
            known = token
            while known >= 0 and not self.compatible(left, known):
                known = self._shorter[known]
            self._fits[left << 20 | token] = known
        return known

    def symbols(self, word: str) -> str:
        # ASCII letters stand for themselves
        out = word if word.isascii() and word.isalpha() else word.encode("utf-8").decode("latin-1").translate(self._table)
        return out[:-1] + chr(ord(out[-1]) + _LAST) if self.vocabulary.suffix else out

    def word_ids(self, word: str) -> list[int]:
        """Tokens of one non-empty pre-token."""
        if self._merge is not None:
            return self._merge(word if word.isascii() and word.isalpha() else word.encode("utf-8").decode("latin-1").translate(self._table))
        text = self.symbols(word)
        if text in self.whole:
            return [self._id[text]]
        size, fits, longest = self._size, self._fits, self._automaton.iter_long
        ahead = longest(text)
        last = next(ahead)[1]
        chain, at, n = [last], size[last], len(text)
        while at < n:
            top = next(ahead)[1]
            fit = fits.get(last << 20 | top)
            if fit is None:
                fit = self.first_fit(last, top)
            if fit < 0:
                return self._step_back(text, chain, at)
            chain.append(fit)
            at += size[fit]
            if fit != top:
                ahead = longest(text, at)
            last = fit
        return chain

    def _step_back(self, text: str, chain: list[int], at: int) -> list[int]:
        """Go on from a chain after which nothing fits: each position is given up at most once."""
        size, shorter, n = self._size, self._shorter, len(text)
        dead = bytearray(n + 1)
        while chain:
            dead[at] = 1
            token = shorter[last := chain.pop()]
            at -= size[last]
            while True:
                if token >= 0 and chain:
                    token = self.first_fit(chain[-1], token)
                if token < 0:
                    break
                end = at + size[token]
                if dead[end]:
                    token = shorter[token]
                    continue
                chain.append(token)
                if end == n:
                    return chain
                at = end
                token = next(self._automaton.iter_long(text, at))[1]
        raise ValueError("a byte is missing from the vocabulary")

    def _chunk_ids(self, chunk: str) -> bytes:
        if self.vocabulary.lowercase:  # words are kept once, bare, whatever stands after them
            if chunk.isalpha():
                return array("I", self.word_ids(chunk)).tobytes()
            if chunk[-1:] in (",", ".") and chunk[:-1].isalpha():
                return self._chunks[chunk[:-1]] + self._chunks[chunk[-1]]
        return b"".join(map(self._words.__getitem__, self._pieces(chunk)))

    def _pieces(self, chunk: str) -> list[str]:
        """Pre-tokens; the usual chunk, letters and at most a stop or comma, needs no pattern."""
        word = chunk[:-1] if chunk[-1:] in (",", ".") else chunk
        if word[word[:1] == " " and not self.vocabulary.lowercase :].isalpha():
            return [word, chunk[-1]] if word is not chunk else [chunk]
        return self._split(chunk)

    @staticmethod
    def _fold(text: str) -> str:
        # without capital sigma, lower() looks at single characters only, as the library does
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _through(self, text: str, cache: "_Cache") -> Iterable:
        """What ``cache`` holds for the parts of a text, cut where no pre-token can span.

        Pre-tokens of a lower-casing vocabulary hold no white space.  Those of a byte-level
        one take at most one blank in front, so a cut before a blank is safe unless the
        blank stands in a run of blanks; such texts go whole.
        """
        if self.vocabulary.lowercase:
            return map(cache.__getitem__, self._fold(text).replace("\n", " ").split(" "))
        if "  " in text:
            return (cache.make(text),)
        return map(cache.__getitem__, text.replace(" ", "\x00 ").split("\x00")) if "\x00" not in text else (cache.make(text),)

    def _parts(self, text: str) -> list[str]:
        """The text cut at special tokens, which stay as parts of their own."""
        return [text] if self._special is None or not any(s in text for s in self.vocabulary.specials) else self._special.split(text)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        specials = self.vocabulary.specials
        return b"".join(
            specials[part].to_bytes(4, "little") if part in specials else b"".join(self._through(part, self._chunks))
            for part in self._parts(text)
        )

    def count(self, text: str) -> int:
        """Tokens of a whole text: pre-tokens that are whole tokens count one, the rest is merged."""
        specials = self.vocabulary.specials
        return sum(1 if part in specials else sum(self._through(part, self._chunk_counts)) for part in self._parts(text))

    @functools.cached_property
    def _counts(self) -> dict[str, int]:
        back = {s: bytes([b]) for b, s in enumerate(self._bytes)}
        out = _Cache(lambda word: len(self.word_ids(word)), WORD_CACHE)
        for t in self.whole:
            shown = t if not self.vocabulary.suffix else t[:-1] + chr(ord(t[-1]) - _LAST) if ord(t[-1]) >= _LAST else None
            try:
                out.fix(b"".join(back[c] for c in shown or "").decode("utf-8"), 1)
            except UnicodeDecodeError:
                pass  # part of a character: never a pre-token of its own
        return out


class _Cache(dict):
    """Values made on demand, in two generations.

    When the young one is full it becomes the old one, and what is still asked for moves
    back; so common words survive while seldom ones go, in bounded memory.
    """

    #: Longer strings are made each time: they seldom come again.
    LONGEST = 64

    def __init__(self, make: Callable[[str], object], limit: int):
        self.make, self._limit, self._fixed, self._old = make, limit, {}, {}

    def fix(self, key: str, value: object) -> None:
        self._fixed[key] = self[key] = value

    def __missing__(self, key: str) -> object:
        out = self._old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self._limit + len(self._fixed):
                self._old = self.copy()
                self.clear()
                self.update(self._fixed)
            self[key] = out
        return out


class Decoder:
    """Ids back to text by one blob of strings and a table of offsets into it."""

    #: Ids decoded at once, so that a very long text needs no large index array.
    BLOCK = 1 << 16

    def __init__(self, vocabulary: Vocabulary, joint: str = " "):
        # every string carries the joint in front of it; the first one's is cut off
        coded = [(joint + s).encode("utf-8") for s in vocabulary.strings()]
        self._joint = len(joint.encode("utf-8"))
        self._blob = np.frombuffer(b"".join(coded), dtype=np.uint8)
        self._size = np.array([len(c) for c in coded], dtype=np.int64)
        self._start = np.cumsum(self._size) - self._size

    def decode(self, packed: bytes) -> bytes:
        """UTF-8 of the tokens' strings with the joint between them."""
        ids = np.frombuffer(packed, dtype="<u4")
        out = b"".join(self._block(ids[i : i + self.BLOCK]) for i in range(0, len(ids), self.BLOCK))
        return out[self._joint :]

    def _block(self, ids: np.ndarray) -> bytes:
        size = self._size[ids]
        shift = self._start[ids] - (np.cumsum(size) - size)
        return self._blob[np.repeat(shift, size) + np.arange(int(size.sum()))].tobytes()
