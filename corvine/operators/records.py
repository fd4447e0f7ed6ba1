"""Records and tables: flattening, timestamps by shape, profiles, repeated lines."""

from __future__ import annotations

import datetime
import json
import math
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rows import flat_map


def repeated_lines(lines: DataFrame, scope: Sequence[str], line: str, page: str, least: int, longest: int) -> DataFrame:
    """Short lines that stand on at least so many pages of their scope, with their counts."""
    short = lines.where(F.length(line).between(1, longest))
    return short.groupBy(*scope, line).agg(F.count_distinct(page).alias("pages"), F.count("*").alias("n")).where(F.col("pages") >= least)


def _leaves(value: object, path: str, depth: int, items: int, field: int) -> Iterator[tuple[str, str]]:
    if isinstance(value, dict) and depth > 0:
        for k, v in value.items():
            yield from _leaves(v, f"{path}.{k}" if path else k, depth - 1, items, field)
    elif isinstance(value, list) and depth > 0:
        if all(not isinstance(v, (dict, list)) for v in value):
            if value:
                yield path, ", ".join(_scalar(v) for v in value[:items])[:field]
        else:
            for i, v in enumerate(value[:items]):
                yield from _leaves(v, f"{path}[{i}]", depth - 1, items, field)
    elif value is not None and not isinstance(value, (dict, list)):
        yield path, _scalar(value)[:field]


def _scalar(v: object) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def flatten_json(df: DataFrame, id_col: str, json_col: str, depth: int = 10, items: int = 8, field: int = 240) -> DataFrame:
    """``(id, path, value)`` of every leaf; an array of plain values is one leaf; bad JSON gives none."""

    def run(key: object, text: str | None) -> Iterator[tuple]:
        try:
            value = json.loads(text) if text else None
        except ValueError:
            return
        yield from ((key, path, leaf) for path, leaf in _leaves(value, "", depth, items, field))

    kind = df.schema[id_col].dataType.simpleString()
    return flat_map(df.select(id_col, json_col), run, f"`{id_col}` {kind}, path string, value string")


def timestamp_by_shape(value: Column) -> Column:
    """A time of whole seconds if the text looks like one: RFC 3339, or 10 or 13 digits of epoch."""
    return (
        F.when(value.rlike(r"^[0-9]{10}$"), F.timestamp_seconds(value.try_cast("bigint")))
        .when(value.rlike(r"^[0-9]{13}$"), F.timestamp_seconds(F.floor(value.try_cast("bigint") / 1000)))
        .when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}"), F.date_trunc("second", F.try_to_timestamp(value)))
    )


def _times(value: object, depth: int, items: int) -> Iterator[int]:
    """Whole seconds of every value that looks like a time, at any key."""
    if isinstance(value, dict) and depth >= 0:
        for v in value.values():
            yield from _times(v, depth - 1, items)
    elif isinstance(value, list) and depth >= 0:
        for v in value[:items]:
            yield from _times(v, depth - 1, items)
    elif isinstance(value, (str, int, float)) and not isinstance(value, bool):
        text = str(value)
        if re.fullmatch(r"[0-9]{10}|[0-9]{13}", text):
            yield int(text[:10])
        elif isinstance(value, str) and re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})", text):
            try:
                yield math.floor(datetime.datetime.fromisoformat(text).timestamp())
            except ValueError:
                return


def record_times(df: DataFrame, id_col: str, json_col: str, depth: int = 10, items: int = 8) -> DataFrame:
    """``(id, occurred_at)``: the earliest time that any value of a record looks like (RFC 3339, or 10 or 13 digits), in whole seconds; null without one."""

    def run(key: object, text: str | None) -> Iterator[tuple]:
        try:
            value = json.loads(text) if text else None
        except ValueError:
            value = None
        yield key, min(_times(value, depth, items), default=None)

    kind = df.schema[id_col].dataType.simpleString()
    found = flat_map(df.select(id_col, json_col), run, f"`{id_col}` {kind}, seconds bigint")
    return found.select(id_col, F.timestamp_seconds("seconds").alias("occurred_at"))


#: Links that make a line one of links, pieces between separators that make it a menu, their length, and pages and characters of a repeated line. Fixed values.
LINKS, PIECES, PIECE, PAGES, LINE = 3, 4, 40, 5, 160


def boilerplate(lines: DataFrame, document: str, line: str, page: str) -> DataFrame:
    """``lines`` with ``is_boilerplate``: many links, a menu, or a short line of many pages of its document; none where all of a document would be.

    Links are half of the words; a menu's pieces are short and stand between one of the separators ``| • > ›``.
    """
    text = F.trim(F.col(line))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    links = F.size(F.filter(words, lambda w: F.contains(w, F.lit("://"))))
    menu = F.lit(False)
    for mark in "|•>›":
        pieces = F.transform(F.split(text, rf"\Q{mark}\E"), lambda p: F.trim(p))
        menu = menu | ((F.size(pieces) >= PIECES) & F.forall(pieces, lambda p: F.length(p).between(1, PIECE)))
    often = repeated_lines(lines.withColumn("_line", text), [document], "_line", page, PAGES, LINE).select(document, "_line", F.lit(True).alias("_often"))
    marked = lines.withColumn("_line", text).join(often, [document, "_line"], "left")
    flag = ((links >= LINKS) & (2 * links >= F.size(words))) | menu | F.coalesce("_often", F.lit(False))
    marked = marked.withColumn("_flag", flag).drop("_line", "_often")
    kept = marked.groupBy(document).agg(F.bool_or(~F.col("_flag")).alias("_some"))
    return marked.join(kept, document).withColumn("is_boilerplate", F.col("_flag") & F.col("_some")).drop("_flag", "_some")


def record_line(ordinal: Column, at: Column, fields: Column) -> Column:
    """A record as one line: its number, its time if known, and its fields."""
    time = F.when(at.isNotNull(), F.concat(F.lit(" occurred_at="), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))).otherwise(F.lit(""))
    return F.concat(F.lit("[unit_ordinal="), ordinal.cast("string"), time, F.lit("] fields: "), F.array_join(fields, "; "))


def temporal_bounds(text: Column) -> Column:
    """Least and greatest time that a text's ``occurred_at=`` marks name, as (low, high)."""
    marks = F.regexp_extract_all(text, F.lit(r"occurred_at=([0-9T:\-]+Z)"), F.lit(1))
    times = F.transform(marks, lambda m: F.try_to_timestamp(m))
    return F.struct(F.array_min(times).alias("low"), F.array_max(times).alias("high"))


def values_only(text: Column) -> Column:
    """A record line's values without header, keys and times, joined by blanks."""
    fields = F.split(F.regexp_replace(text, r"^\[[^\]]*\] fields: ", ""), "; ")
    values = F.transform(fields, lambda f: F.regexp_replace(f, r"^[^=]*=", ""))
    return F.array_join(F.filter(values, lambda v: (v != "") & ~v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T")), " ")


def source_profile(leaves: DataFrame, records: DataFrame, at: str) -> DataFrame:
    """How often each path occurs, and the records' number and time span."""
    span = records.agg(F.count("*").alias("records"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return leaves.groupBy("path").agg(F.count("*").alias("present")).join(F.broadcast(span))


def semantic_row(sheet: str, number: Column, headers: Sequence[str]) -> Column:
    """A table row as text: sheet, row number, and ``header: value`` of its filled cells."""
    cells = [F.when(F.col(h).isNotNull() & (F.trim(F.col(h).cast("string")) != ""), F.concat(F.lit(f"{h}: "), F.col(h).cast("string"))) for h in headers]
    return F.concat_ws(" | ", F.lit(f"Sheet: {sheet}"), F.concat(F.lit("Row "), number.cast("string")), *cells)


def document_status(mutation: Column, job: Column, readable: Column) -> Column:
    """Status of a document from its newest mutation's and job's states and its readable revision; the first that holds counts.

    What failed or runs now shows whatever else there is; then a readable revision; then what waits.
    A job that completed without a readable revision is a failure.
    """
    return (
        F.when(mutation.isin("failed", "conflicted") | (job == "failed"), "failed").when(job == "leased", "processing").when(readable.isNotNull(), "ready")
        .when((job == "canceled") | (mutation == "canceled"), "canceled").when(job == "queued", "queued")
        .when(mutation.isin("accepted", "running"), "processing").when(job == "completed", "failed").otherwise("queued")
    )


def _is_data(cell: str) -> bool:
    """Digits with signs of numbers, dates and times; addresses; truth values."""
    low = cell.strip().lower()
    return bool(low) and (all(c in "0123456789.,-+/:%" for c in low) or "@" in low or low.startswith(("http://", "https://")) or low in ("true", "false"))


def _is_label(cell: str) -> bool:
    cell = cell.strip()
    return 0 < len(cell.encode()) <= 48 and not _is_data(cell) and any(map(str.isalpha, cell))


def _is_header(row: list[str], below: list[list[str]]) -> bool:
    """Different filled cells, none of them data and half of them labels, over a row with something else."""
    filled = [c.strip() for c in row if c.strip()]
    if not filled or any(map(_is_data, filled)) or 2 * sum(map(_is_label, filled)) < len(filled) or len({c.lower() for c in filled}) < len(filled):
        return False
    return any(c.strip() and not _is_label(c) for r in below[:4] for c in r)


def table_shape(rows: list[list[str]]) -> tuple[list[str], list[list[str]], str | None, str]:
    """Headers, data rows filled up to the widest, caption and how the headers were found, from a table's rows.

    A single label over a header is the caption.  Where no row is a header, columns are ``col_1`` and so on.
    """
    width = max(map(len, rows), default=0)
    if not width:
        return [], [], None, "empty_table"
    rows = [r + [""] * (width - len(r)) for r in rows]
    made = [f"col_{i + 1}" for i in range(width)]
    named = lambda row: [c.strip() or m for c, m in zip(row, made, strict=True)]
    if len(rows) == 1 or width == 1:
        return made, rows, None, "synthetic_single_row" if len(rows) == 1 else "synthetic_single_column"
    first = [c.strip() for c in rows[0] if c.strip()]
    if len(rows) > 2 and len(first) == 1 and _is_label(first[0]) and _is_header(rows[1], rows[2:]):
        return named(rows[1]), rows[2:], first[0], "inferred_title_then_header"
    if _is_header(rows[0], rows[1:]):
        return named(rows[0]), rows[1:], None, "inferred_first_row_header"
    return made, rows, None, "synthetic_data_like_header"


def markdown_cells(line: str) -> list[str]:
    """Cells of a markdown table row; ``\\|`` is a bar within a cell."""
    out, cell, escaped = [], "", False
    for c in line.strip().removeprefix("|"):
        if escaped:
            cell, escaped = cell + (c if c == "|" else "\\" + c), False
        elif c == "\\":
            escaped = True
        elif c == "|":
            out.append(cell.strip())
            cell = ""
        else:
            cell += c
    return [*out, cell.strip()] if cell.strip() else out
