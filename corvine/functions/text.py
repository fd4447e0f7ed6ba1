"""Text functions as columns."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


@pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC-normalised, lower-cased text; Spark has no normalisation of its own."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower())


@pandas_udf(T.StringType())
def unaccent(text: pd.Series) -> pd.Series:
    """Text without combining marks."""
    strip = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", strip(t)))


@pandas_udf(T.StringType())
def repair_mojibake(text: pd.Series) -> pd.Series:
    """UTF-8 that was read as Latin-1, span by span; what doesn't decode stays."""

    def one(t: str | None) -> str | None:
        if t is None or not any("\x80" <= c <= "\xff" for c in t):
            return t
        out, span = [], []

        def flush() -> None:
            raw = "".join(span)
            try:
                out.append(raw.encode("latin-1").decode("utf-8"))
            except UnicodeDecodeError:
                out.append(raw)
            span.clear()

        for c in t:
            if c <= "\xff":
                span.append(c)
            else:
                flush()
                out.append(c)
        flush()
        return "".join(out)

    return text.map(one)


def tokens(text: Column, least: int = 1) -> Column:
    """Distinct lower-case runs of letters and digits, in order of their first place."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= least))


def slug(text: Column) -> Column:
    """Lower case, runs of other characters as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def simhash(df: DataFrame, keys: list[str], text: str, words: int = 3) -> DataFrame:
    """``keys`` and a 64-bit ``simhash`` over word shingles, for equality (not for distances).

    Shingles are hashed in the JVM and their bits voted in Arrow batches; rows stay where they are.
    """
    parts = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    n = F.greatest(F.size("_w") - words + 1, F.lit(1))
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, F.lit(words)), " ")))
    rows = df.select(*keys, parts.alias("_w")).select(*keys, hashes.alias("_h"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, VOTED_ROWS):
                part = batch.slice(at, VOTED_ROWS)
                lists = part.column(len(keys))
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                bits = np.unpackbits(flat.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
                votes = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64)
                found = np.packbits(2 * votes > sizes[:, None], axis=1).view(">i8").ravel().astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(found)], names=[*keys, "simhash"])

    return rows.mapInArrow(vote, T.StructType([*df.select(*keys).schema.fields, T.StructField("simhash", T.LongType())]))


#: Rows whose bits are counted at a time.
VOTED_ROWS = 1024


def near_duplicate_flag(fingerprint: Column, digest: Column, scope: list[str], order: str) -> Column:
    """Does an earlier row of the scope have this fingerprint but another digest?"""
    first = F.first(digest).over(Window.partitionBy(*scope, fingerprint).orderBy(order))
    return first != digest


#: Languages in the order they are tried: each needs all of the groups, a group any of its texts; the last list must be absent. Fixed values.
_CLASS = [["class "], ["{"], ["public ", "private "]]
LANGUAGES = [
    ("rust", [["fn "], ["-> ", "pub ", "let "]], []), ("python", [["def "], [":"]], ["{"]), ("go", [["func "], ["package "]], []),
    ("typescript", [["function ", "const ", "=> {"], [": string", ": number", "interface "]], []), ("javascript", [["function ", "const ", "=> {"]], []),
    ("java", [*_CLASS, ["package "], ["import java"]], []), ("cpp", [*_CLASS, ["#include", "std::"]], []), ("csharp", [*_CLASS, ["using "], ["namespace "]], []),
    ("php", [["<?php"]], []), ("php", [["function "], ["$"]], []), ("ruby", [["require "], ["end\n"]], []), ("swift", [["import Swift"]], []), ("swift", [["func "], ["->"]], ["pub "]),
    ("kotlin", [["fun "], ["val "]], []), ("elixir", [["defmodule "]], []), ("elixir", [["def "], ["do\n"]], []), ("dockerfile", [["FROM "], ["RUN "]], []), ("yaml", [["---"], [": "]], ["{"]),
    ("json", [["\":\n"]], []), ("terraform", [["resource "], ["provider "]], []), ("sql", [["CREATE TABLE", "SELECT "]], []),
]


def guess_language(text: str, lines: int = 50) -> str:
    """As ``code_language``, of one text."""
    sample = "\n".join(text.split("\n")[:lines])
    for name, groups, absent in LANGUAGES:
        if all(any(t in sample for t in some) for some in groups) and not any(t in sample for t in absent) or (name == "json" and sample.startswith("{")):
            return name
    return ""


def code_language(text: Column, lines: int = 50) -> Column:
    """The first language whose marks the text's first lines hold; empty if none."""
    sample = F.substring_index(text, "\n", lines)
    has = lambda t: F.contains(sample, F.lit(t))
    some = lambda texts: functools.reduce(Column.__or__, map(has, texts))
    out = F.lit("")
    for name, groups, absent in reversed(LANGUAGES):
        holds = functools.reduce(Column.__and__, [*map(some, groups), *(~has(t) for t in absent)])
        out = F.when(holds | F.startswith(sample, F.lit("{")) if name == "json" else holds, name).otherwise(out)
    return out


def version_terms(text: Column) -> Column:
    """Dotted numbers of two to four parts that are no day.month.year dates, each once, in order."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)+"), F.lit(0)))
    part = lambda v, i: F.get(F.split(v, r"\."), F.lit(i)).try_cast("bigint")
    date = lambda v: part(v, 0).between(1, 31) & part(v, 1).between(1, 12) & (part(v, 2) >= 1900)
    kept = lambda v: F.size(F.filter(F.split(v, r"\."), lambda p: p.try_cast("bigint") < 1 << 32)).between(2, 4) & ~F.coalesce(date(v), F.lit(False))
    return F.filter(found, kept)


def version_parts(text: Column, pad: int = 4) -> Column:
    """The first dotted number of 2 to 4 parts as numbers, filled with zeros, so that versions sort."""
    found = F.regexp_extract(text, r"(?<![0-9.])([0-9]+(?:\.[0-9]+){1,3})(?![0-9.])", 1)
    parts = F.transform(F.split(found, r"\."), lambda p: p.try_cast("bigint"))
    return F.when(found != "", F.transform(F.sequence(F.lit(0), F.lit(pad - 1)), lambda i: F.coalesce(F.get(parts, i), F.lit(0).cast("bigint"))))


#: A token of a version and the character after it; versions with a release or build part, or a full stop at the end.
_TOKEN = r"[\p{L}\p{N}_.+-]+[^\p{L}\p{N}_.+-]?"
_RELEASE = r"(?s)^([vV]?)([0-9]+(?:\.[0-9]+)+)(?:-{i}(?:\+{i})?|\+{i})?(?:[^\p{L}\p{N}_.+-]|\.[\s)\]}>'\"`]?)?$".replace("{i}", r"[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*")


def release_versions(text: Column) -> Column:
    """Versions that a release may have, each once, as numbers joined by dots.

    A ``v`` may stand before, a pre-release or build part after (left out).  Years first, dates of three parts
    and numbers over 32 bits are none; four parts of at most 255 are one only after a ``v``.  Null text: null.
    """
    tokens = F.filter(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda t: t.rlike(_RELEASE))
    found = F.transform(tokens, lambda t: F.struct((F.regexp_extract(t, _RELEASE, 1) != "").alias("v"), F.transform(F.split(F.regexp_extract(t, _RELEASE, 2), r"\."), lambda p: p.try_cast("bigint")).alias("n")))

    def kept(x: Column) -> Column:
        n, part = x.n, lambda i: F.get(x.n, F.lit(i))
        date = (F.size(n) == 3) & part(2).between(1900, 2100) & part(0).between(1, 31) & part(1).between(1, 31) & ((part(0) <= 12) | (part(1) <= 12))
        address = (F.size(n) == 4) & F.forall(n, lambda p: p <= 255) & ~x.v
        return F.forall(n, lambda p: F.coalesce(p < 1 << 32, F.lit(False))) & ~part(0).between(1900, 2100) & ~date & ~address

    return F.array_distinct(F.transform(F.filter(found, kept), lambda x: F.array_join(x.n.cast("array<string>"), ".")))
