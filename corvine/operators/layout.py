"""Layout repair: identifiers, paths and protocols that a page break or a narrow column cut in two.

Lines are folded: a line joins the one before it if the two tokens at the cut show that they
were one.  Then tokens that ran together within a line are parted.  Of prose, only two short words of
small letters at a line's end and the next one's start are taken for one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..rows import flat_map
from .blocks import line_kind

#: The ends of a cut identifier: a short word, or little after its last capital; and how its rest begins. Fixed values.
_LEFT = re.compile(r"(?=[\x00-\x7f]{1,32}$)(?=.*[a-z])(?:[a-z0-9]{1,4}|[^A-Z]{1,3}|.*[A-Z][^A-Z]{0,2})(?<=[a-z0-9_/:.])")
_LEFT_OF_RULE = re.compile(r"(?=.*[a-z])[a-z0-9]{1,32}")
_RIGHT = re.compile(r"(?=[\x00-\x7f]{1,32}$)(?:_.*|[a-z0-9]{1,5}|(?=.{1,8}$)[a-z].*[A-Z].*)")
#: An argument of a command, and the words that may be a command. Fixed values.
_ARGUMENT = re.compile(r".*://|/|\./|-|\+|.*=")
_ACTION = re.compile(r"[\x00-\x7f]+")
_MARKS = "!\"#$%&'()*+,:;<=>?@[\\]^`{|}~"
_METADATA = re.compile(r"\s*[A-Za-z][\w .-]{0,40}:\s+\S")


def _is_command(line: str) -> bool:
    first, *rest = line.split() or [""]
    first = first.strip(_MARKS)
    acts = first.startswith(("/", "./")) or "-" in first or "." in first or re.fullmatch(r"[a-z0-9]+", first) is not None
    return bool(rest and first and _ACTION.fullmatch(first) and acts and any(_ARGUMENT.match(t) for t in rest))


def _stands_alone(line: str) -> bool:
    return line_kind(line) in ("table_row", "list_item", "endpoint_block") or line.lstrip().startswith(("```", "~~~")) or _METADATA.match(line) is not None or _is_command(line)


def joins(before: str, line: str) -> bool:
    """Whether the last token of a line and the first one of the next are two parts of one."""
    if not before.split() or not line.split():
        return False
    left, right = before.split()[-1], line.split()[0]
    if left in ("http", "https") and right.startswith("://"):
        return True
    if right.startswith("/") and (left.startswith("/") or "://" in left):
        return True
    if _stands_alone(before) or _stands_alone(line):
        return False
    return bool(_RIGHT.fullmatch(right) and (_LEFT.fullmatch(left) or right.startswith("_") and _LEFT_OF_RULE.fullmatch(left)))


def _parted(tokens: list[str]) -> Iterator[str]:
    """Tokens, those that ran together as two."""
    for i, token in enumerate(tokens):
        before = tokens[i - 1].strip(_MARKS) if i else ""
        plain = re.fullmatch(r"[a-z0-9]+", token) and re.fullmatch(r"[a-z0-9]{1,4}", before)
        if plain and i + 1 < len(tokens) and _ARGUMENT.match(tokens[i + 1]):
            cut = next((n for n in (3, 2) if len(token) >= n + 3 and before.startswith(token[:n])), 0)
            if cut:
                yield from (token[:cut], token[cut:])
                continue
        yield from _paths(token)


def _paths(token: str) -> list[str]:
    """A token of two paths to files, one after the other, as both."""
    marked = lambda path: re.fullmatch(r"(?=.*\.)(?=.*[^\W_]).*", path.rsplit("/", 1)[-1]) is not None
    if "://" not in token:
        for m in re.finditer("/", token[1:]):
            left, right = token[: m.start() + 1], token[m.start() + 1 :]
            if marked(left) and "/" in right[1:] and marked(right):
                return [left, right]
    return [token]


def repair(text: str) -> tuple[str, int]:
    """The repaired text and how many lines were joined."""
    lines: list[str] = []
    joined = 0
    for line in text.splitlines():
        line = line.rstrip()
        if line and lines and joins(lines[-1], line):
            lines[-1] += line.strip()
            joined += 1
        else:
            lines.append(line)
    out = []
    for line in lines:
        tokens = line.split()
        parted = list(_parted(tokens))
        out.append(" ".join(parted) if parted != tokens else line)
    return "\n".join(out), joined


def repair_layout(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, joined)``: every text repaired; null texts count as empty."""

    def run(key: object, text: str | None) -> Iterator[tuple]:
        yield key, *repair(text or "")

    kind = df.schema[id_col].dataType.simpleString()
    return flat_map(df.select(id_col, text_col), run, f"`{id_col}` {kind}, text string, joined int")
