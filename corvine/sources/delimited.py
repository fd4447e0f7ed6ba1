"""Delimited text: the dialect is inferred from each file's first records, then the file is parsed.

Files are rows (``spark.read.format("binaryFile")``, or any table with a column of whole texts), so they
are dealt over the tasks.  One large file of plain lines is read by ``scan_lines``, which Spark splits.
All cells stay text.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import table_shape
from ..rows import flat_map

#: Delimiters in the order in which they are tried (the last of equally good ones wins), and records that are looked at. Fixed values.
DELIMITERS, HEAD = ",;\t|", 16

csv.field_size_limit(1 << 30)


def _records(text: str, delimiter: str) -> Iterator[list[str]]:
    return csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)


def infer_delimiter(text: str) -> str:
    """The delimiter that makes most records of several cells, then most of the width of the one before, then most records."""

    def score(delimiter: str) -> tuple[int, int, int]:
        widths = [len(r) for r in islice((r for r in _records(text, delimiter) if r), HEAD) if any(c.strip() for c in r)]
        return sum(w > 1 for w in widths), sum(a == b > 1 for a, b in zip(widths, widths[1:], strict=False)), len(widths)

    return max(reversed(DELIMITERS), key=score)


def parse(text: str, delimiter: str | None = None) -> tuple[str, list[list[str]]]:
    """The delimiter and all rows with a filled cell; a byte order mark goes, rows may be ragged."""
    text = text.removeprefix("﻿")
    delimiter = delimiter or infer_delimiter(text)
    return delimiter, [r for r in _records(text, delimiter) if any(c.strip() for c in r)]


def read_delimited(files: DataFrame, name_col: str = "path", body_col: str = "content", tab: Column | None = None) -> DataFrame:
    """``(name, row, delimiter, policy, caption, headers, cells)``: a row per data row of every file.

    ``tab`` says which files are tab-separated by their name or type; for the others the delimiter is inferred.
    A binary body is UTF-8; null and blank files have no rows.  Cells are filled up to the widest row.
    """

    def run(name: object, body: str | None, tabbed: bool | None) -> Iterator[tuple]:
        delimiter, rows = parse(body or "", "\t" if tabbed else None)
        headers, data, caption, policy = table_shape(rows)
        yield from ((name, i, delimiter, policy, caption, headers, cells) for i, cells in enumerate(data))

    body = F.col(body_col)
    body = F.decode(body, "UTF-8") if files.schema[body_col].dataType.simpleString() == "binary" else body
    tabbed = tab if tab is not None else F.lower(F.col(name_col).cast("string")).endswith(".tsv")
    kind = files.schema[name_col].dataType.simpleString()
    schema = f"`{name_col}` {kind}, row int, delimiter string, policy string, caption string, headers array<string>, cells array<string>"
    return flat_map(files.select(name_col, body.alias("body"), tabbed.alias("tabbed")), run, schema)


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """``read_delimited`` over the files at a path."""
    return read_delimited(spark.read.format("binaryFile").load(path).select("path", "content"))


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Files of one dialect without line breaks in cells, of any size: Spark splits them; columns ``_c0`` and so on, all text."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(HEAD).collect())
    return spark.read.csv(path, sep=infer_delimiter(head), header=False, inferSchema=False, escape='"')
