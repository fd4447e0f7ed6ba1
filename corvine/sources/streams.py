"""Record streams: JSON, JSON lines, YAML and TOML files as rows of one record each.

A file is a row of a table and its records stay in its partition.  A payload counts as
records only if all of it does: objects, or lists or streams of objects; else it has no rows
and can be read as text.  Units that are too wide are cut between fields, their header repeated.
"""

from __future__ import annotations

import datetime
import json
import tomllib
from collections.abc import Iterator

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rows import flat_map

#: File extensions and media types by format. Fixed values.
EXTENSIONS = {"jsonl": "jsonl", "ndjson": "jsonl", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml"}
MEDIA_TYPES = {
    "application/jsonl": "jsonl", "application/ndjson": "jsonl", "application/x-jsonlines": "jsonl", "application/x-ndjson": "jsonl", "application/json": "json",
    "application/yaml": "yaml", "application/x-yaml": "yaml", "text/yaml": "yaml", "text/x-yaml": "yaml", "application/toml": "toml", "text/toml": "toml",
}
#: What stands between a unit's header and its fields, and between fields. Fixed values.
FIELDS, BETWEEN = "fields: ", "; "

_Loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def stream_format(name: Column, media_type: Column) -> Column:
    """The format by a file's extension, else by its media type; null for others."""
    pick = lambda table, key: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    extension = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    return F.coalesce(pick(EXTENSIONS, extension), pick(MEDIA_TYPES, F.lower(F.trim(F.split_part(media_type, F.lit(";"), F.lit(1))))))


def _plain(value: object) -> bool:
    """Whether a value is JSON: keys are texts, and there are no dates."""
    if isinstance(value, dict):
        return all(isinstance(k, str) and _plain(v) for k, v in value.items())
    return all(map(_plain, value)) if isinstance(value, list) else not isinstance(value, (datetime.date, datetime.time, bytes, set))


def _of_value(value: object) -> list[dict]:
    if isinstance(value, dict):
        return [value]
    if isinstance(value, list) and value and all(isinstance(v, dict) for v in value):
        return value
    raise ValueError("no records")


def _json(text: str) -> list[dict]:
    return _of_value(json.loads(text.strip()))


def _json_lines(text: str) -> list[dict]:
    found = [json.loads(line) for line in text.split("\n") if line.strip()]
    return _of_value(found)


def _yaml(text: str) -> list[dict]:
    found = [d for d in yaml.load_all(text, _Loader) if d is not None]
    if not all(map(_plain, found)):
        raise ValueError("not as JSON")
    return [r for d in found for r in _of_value(d)]


def _toml(text: str) -> list[dict]:
    found = tomllib.loads(text)
    if not _plain(found):
        raise ValueError("not as JSON")
    return [found]


def records(text: str, kind: str) -> list[dict]:
    """The records of a payload, none if it isn't one of records; JSON that isn't one value may be lines."""
    tries = {"jsonl": [_json_lines], "json": [_json, _json_lines], "yaml": [_yaml], "toml": [_toml]}.get(kind, [])
    for read in tries:
        try:
            return read(text)
        except (ValueError, yaml.YAMLError, RecursionError):
            continue
    return []


def read_records(files: DataFrame, kind: Column, name_col: str = "path", body_col: str = "content", strict: bool = False) -> DataFrame:
    """``(name, ordinal, record)``: each record of every file as JSON, keys in their order.

    Null, blank and unreadable files have no rows; with ``strict`` a file of JSON lines with a bad line, or without any record, is an error.
    """

    def run(name: object, body: str | None, kind: str | None) -> Iterator[tuple]:
        found = records(body or "", kind or "")
        if strict and kind == "jsonl" and not found:
            raise ValueError(f"{name}: {_fault(body or '')}")
        yield from ((name, i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(found))

    body = F.col(body_col)
    body = F.decode(body, "UTF-8") if files.schema[body_col].dataType.simpleString() == "binary" else body
    column = files.schema[name_col].dataType.simpleString()
    return flat_map(files.select(name_col, body.alias("body"), kind.alias("kind")), run, f"`{name_col}` {column}, ordinal int, record string")


def _fault(text: str) -> str:
    for i, line in enumerate(text.split("\n"), 1):
        try:
            if line.strip() and not isinstance(json.loads(line), dict):
                return f"line {i} is no object"
        except ValueError:
            return f"line {i} is no JSON"
    return "there are no records"


def split_units(text: Column, most: int) -> Column:
    """A record unit as units of at most ``most`` characters where fields allow, each with the header.

    Fields are never cut: one that is wider than the budget has a unit of its own.  Units that fit, and texts
    that aren't units of two fields or more, stay whole.  A fold in the JVM, a field at a time.
    """
    at = F.call_function("instr", text, F.lit(FIELDS))
    header = F.substring(text, F.lit(1), at - 1)
    body = F.substring(text, at + len(FIELDS), F.length(text))
    fields = F.filter(F.split(body, BETWEEN), lambda f: F.trim(f) != "")
    room = most - F.length(header) - len(FIELDS)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))

    def step(state: Column, field: Column) -> Column:
        joined = F.concat(state["now"], F.lit(BETWEEN), field)
        over = F.length(joined) > room
        done = F.when(over, F.array_append(state["done"], state["now"])).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(state["now"].isNull() | over, field).otherwise(joined).alias("now"))

    parts = F.aggregate(fields, empty, step, lambda s: F.array_append(s["done"], s["now"]))
    cut = F.transform(parts, lambda p: F.concat(header, F.lit(FIELDS), p))
    return F.when((F.length(text) <= most) | (at == 0) | (F.size(fields) < 2), F.array(text)).otherwise(cut)


def focused_excerpt(text: str, terms: list[str], most: int) -> str | None:
    """The fields of a unit that hold the terms and their neighbours, within a budget; None where there is nothing to choose from.

    Fields with more characters of terms come first; while it is too long, the last neighbour goes, then the last field.
    """
    text = text.strip()
    if not text or most < 1:
        return None
    if len(text) <= most:
        return text
    header, mark, body = text.partition(FIELDS)
    fields = [f.strip() for f in body.split(BETWEEN) if f.strip()]
    wanted = [t.strip().lower() for t in terms if len(t.strip()) >= 2]
    if not mark or not fields or not wanted:
        return None
    score = [sum(min(24, len(t)) for t in wanted if t in f.lower()) for f in fields]
    hits = sorted((i for i, s in enumerate(score) if s), key=lambda i: (-score[i], i))
    shown = lambda chosen: header + FIELDS + BETWEEN.join(fields[i] for i in sorted(chosen))
    chosen: set[int] = set()
    for i in hits:
        chosen |= {i, *(j for j in (i - 1, i + 1) if 0 <= j < len(fields))}
        if len(shown(chosen)) >= most:
            break
    while chosen and len(shown(chosen)) > most:
        chosen.discard(max((i for i in chosen if not score[i]), default=max(chosen)))
    return shown(chosen) if chosen else None


def focused_excerpts(units: DataFrame, terms: Column, most: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, excerpt)`` of every unit for the terms in its row."""

    def run(key: object, text: str | None, wanted: list[str] | None) -> Iterator[tuple]:
        yield key, focused_excerpt(text or "", wanted or [], most)

    kind = units.schema[id_col].dataType.simpleString()
    return flat_map(units.select(id_col, text_col, terms.alias("terms")), run, f"`{id_col}` {kind}, excerpt string")
