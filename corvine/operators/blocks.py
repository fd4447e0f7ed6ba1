"""Typed blocks of a text and windows of blocks: the units of search.

Both need state that runs through a document (heading trail, open window), so they fold
over one document's rows at a time, where the document lies: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quality import assess
from ..functions.text import guess_language
from ..rows import flat_map
from .code import code_parts
from .records import markdown_cells

BLOCK = "kind string, text string, heading_trail array<string>, level int, is_boilerplate boolean, code_language string, normalized_text string"
#: Kinds that stand alone in a window, and kinds that name a window, first one found first. Fixed values.
STANDALONE = {"table_row", "source_profile", "source_unit"}
DOMINANT = ["endpoint_block", "code_block", "table", "table_row", "source_profile", "source_unit"]
_FENCE, _HEADING, _ITEM = re.compile(r"^\s*(?:```|~~~)\s*([\w+#-]*)"), re.compile(r"^(#{1,6})\s+(.*\S)\s*$"), re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+\S")
_ENDPOINT = re.compile(r"^\s*(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+/\S*")
_RULE = re.compile(r"^\s*\|(?:\s*:?-+:?\s*\|)+\s*$")
SEPARATORS = "|•>›"


def line_kind(line: str) -> str:
    """Kind of a line outside code: the shape of its start decides."""
    if _HEADING.match(line):
        return "heading"
    if _ENDPOINT.match(line):
        return "endpoint_block"
    if line.lstrip().startswith("|") and line.rstrip().endswith("|") and line.count("|") > 2:
        return "table_row"
    if _ITEM.match(line):
        return "list_item"
    return "quote_block" if line.lstrip().startswith(">") else "paragraph"


def is_boilerplate(kind: str, text: str) -> bool:
    """Links that are half of the words, or four or more short pieces between separators."""
    if kind not in ("paragraph", "list_item"):
        return False
    words = text.split()
    links = sum("://" in w for w in words)
    if links >= 3 and 2 * links >= len(words):
        return True
    pieces = [[p.strip() for p in text.split(s)] for s in SEPARATORS]
    return any(len(p) >= 4 and all(0 < len(x) <= 40 for x in p) for p in pieces)


def _table(lines: list[str], sheet: str) -> Iterator[tuple[str, str, str]]:
    """Kind, text and normal text of a table and its rows; lines without a rule below the first are rows alone."""
    if len(lines) < 3 or not _RULE.match(lines[1]):
        yield from (("table_row", line.strip(), line.strip()) for line in lines)
        return
    whole = "\n".join(line.strip() for line in lines)
    yield "table", whole, whole
    headers = markdown_cells(lines[0])
    for n, line in enumerate(lines[2:], 1):
        cells = [f"{h}: {c}" for h, c in zip(headers, markdown_cells(line), strict=False) if c]
        yield "table_row", line.strip(), " | ".join([*([f"Sheet: {sheet}"] if sheet else []), f"Row {n}", *cells])


def prepare(text: str) -> list[tuple]:
    """Blocks of a text, as in ``BLOCK``: lines of one kind in a row are one block; headings, items and endpoints stand alone.

    Rows of a table with a header are blocks of their own after the table; their normal text names the columns.
    A code block knows the language that its fence names.
    """
    trail: list[tuple[int, str]] = []
    out: list[list] = []
    rows: list[str] = []
    code: list[str] | None = None
    language = last = ""
    titles = lambda: [t for _, t in trail]

    def settle() -> None:
        for kind, whole, normal in _table(rows, trail[-1][1] if trail else ""):
            out.append([kind, whole, titles(), 0, None, normal])
        rows.clear()

    for line in text.splitlines():
        kind = "" if code is not None or not line.strip() else line_kind(line)
        if rows and kind != "table_row":
            settle()
        if fence := _FENCE.match(line):
            if code is None:
                code, language = [], fence[1].lower()
            else:
                out.append(["code_block", "\n".join(code), titles(), 0, language or None, None])
                code = None
            last = ""
        elif code is not None:
            code.append(line)
        elif kind == "table_row":
            rows.append(line)
            last = ""
        elif not kind:
            last = ""
        else:
            if kind == "heading":
                level, title = len(_HEADING.match(line)[1]), _HEADING.match(line)[2]
                trail = [x for x in trail if x[0] < level] + [(level, title)]
                out.append([kind, title, titles(), level, None, None])
            elif kind == last and kind in ("paragraph", "quote_block"):
                out[-1][1] += "\n" + line
            else:
                out.append([kind, line.strip(), titles(), 0, None, None])
            last = kind
    settle()
    if code:
        out.append(["code_block", "\n".join(code), titles(), 0, language or None, None])
    flags = [is_boilerplate(b[0], b[1]) for b in out]
    if flags and all(flags):
        flags = [False] * len(flags)
    return [(*b[:4], f, b[4], b[1] if b[5] is None else b[5]) for b, f in zip(out, flags, strict=True)]


def split_code(rows: list[tuple], most: int) -> list[tuple]:
    """Blocks with code over the budget cut at its definitions; a language that no fence names is guessed."""
    out = []
    for b in rows:
        parts = code_parts(b[1], b[5] or guess_language(b[1]), most) if b[0] == "code_block" and len(b[1].strip()) > most else []
        out += [(b[0], p, *b[2:6], p) for p in parts] if len(parts) > 1 else [b]
    return out


def _normal(block: tuple) -> str:
    return (block[6] if len(block) > 6 else block[1]).strip()


def blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ordinal, kind, text, heading_trail, level, is_boilerplate)``, a row per block."""

    def run(key: object, text: str | None) -> Iterator[tuple]:
        yield from ((key, i, *b) for i, b in enumerate(prepare(text or "")))

    kind = df.schema[id_col].dataType.simpleString()
    return flat_map(df.select(id_col, text_col), run, f"`{id_col}` {kind}, ordinal int, {BLOCK}")


def windows(rows: list[tuple], most: int = 2800, overlap: int = 280) -> list[list[tuple]]:
    """Greedy windows over a document's blocks (see ``BLOCK``), by their normal texts.

    Boilerplate is left out, and a table whose rows follow.  A join costs two characters.  A kind that stands alone
    closes the window; a heading does if a third is full.  The next window begins with the last whole blocks that fit the overlap.
    """
    out: list[list[tuple]] = []
    now: list[tuple] = []
    size = carried = 0

    def close() -> None:
        nonlocal now, size, carried
        if len(now) > carried:
            out.append(now)
        back, held = [], 0
        for b in reversed(now):
            more = len(_normal(b)) + (2 if back else 0)
            if b[0] in STANDALONE or held + more > overlap:
                break
            back.insert(0, b)
            held += more
        now, size, carried = back, held, len(back)

    kept = [b for b, after in zip(rows, [*rows[1:], ("",)], strict=False) if not b[4] and not (b[0] == "table" and after[0] == "table_row")]
    for b in (b for b in kept if _normal(b)):
        alone = b[0] in STANDALONE
        length = len(_normal(b))
        cost = length + (2 if now else 0)
        if now and (alone or size + cost > most or (b[0] == "heading" and size >= most // 3)):
            close()
            if alone or size + length + 2 > most:
                now, size, carried = [], 0, 0
            cost = length + (2 if now else 0)
        now.append(b)
        size += cost
        if alone:
            close()
            now, size, carried = [], 0, 0
    if len(now) > carried:
        out.append(now)
    return out


def dominant_kind(kinds: list[str]) -> str:
    return next((k for k in DOMINANT if k in kinds), kinds[0])


def quality(window: list[tuple]) -> float:
    """Score of a window from its kinds, its size in bytes and how its words repeat; legibility is not in it."""
    kinds, texts = {b[0] for b in window}, [(b[6] if len(b) > 6 else b[1]) for b in window]
    score = 1.0 + 0.1 * bool({"code_block", "endpoint_block"} & kinds) + 0.1 * ("heading" in kinds) + 0.1 * bool({"table", "table_row"} & kinds)
    score -= 0.2 * (sum(len(t.encode()) for t in texts) < 100)
    words = [w for t in texts for w in t.split()]
    return score - 0.1 * bool(words and len(set(words)) / len(words) < 0.3)


def sentence_window(texts: list[str], at: int, sides: int = 2, most_words: int = 1500) -> str | None:
    """A chunk's text with up to two sentences from its neighbours; None if nothing is gained."""
    sentences = lambda i: [s for s in re.split(r"(?<=[.!?])\s+", texts[i]) if s]
    before, after, i, j = [], [], at - 1, at + 1
    while len(before) < sides and i >= 0:
        before = [*sentences(i)[-(sides - len(before)) :], *before]
        i -= 1
    while len(after) < sides and j < len(texts):
        after = [*after, *sentences(j)[: sides - len(after)]]
        j += 1
    full = " ".join([*before, texts[at], *after])
    return None if full == texts[at] or len(full.split()) > most_words else full


def chunks(df: DataFrame, most: int = 2800, overlap: int = 280, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of every text: a row per window, with digest, token count, quality and neighbours' sentences.

    Code over ``most`` characters is cut at its definitions first.  The quality is the window's score times the
    legibility of its text (``functions.quality``), between 0 and 1; ``text_quality`` has the latter's figures.
    """

    def run(key: object, text: str | None) -> Iterator[tuple]:
        found = windows(split_code(prepare(text or ""), most), most, overlap)
        texts = ["\n\n".join(map(_normal, w)) for w in found]
        for i, (w, t) in enumerate(zip(found, texts, strict=True)):
            trail = next((b[2] for b in reversed(w) if b[2]), [])
            digest = "sha256:" + hashlib.sha256(t.encode()).hexdigest()
            content = "\n\n".join(b[1].strip() for b in w)
            yield key, i, dominant_kind([b[0] for b in w]), content, t, digest, len(t.split()), trail, quality(w), sentence_window(texts, i), len(w)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, chunk_index int, chunk_kind string, content_text string, normalized_text string, literal_digest string, token_count int, heading_trail array<string>, score double, window_text string, n_blocks int"
    found = flat_map(df.select(id_col, text_col), run, schema).withColumn("text_quality", assess(F.col("normalized_text")))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") * F.col("text_quality.score")))
    return found.withColumn("quality_score", score).drop("score")


def line_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One chunk per non-blank line, in expressions only: ``(id, chunk_index, content_text)``, after other columns that are handed on."""
    lines = df.select(id_col, *carry, F.posexplode(F.split(text_col, "\n")).alias("chunk_index", "content_text"))
    return lines.where(F.trim("content_text") != "")
