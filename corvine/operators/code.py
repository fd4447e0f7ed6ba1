"""Code cut into pieces at definitions.

A piece begins where a definition does, is cut again between lines where it is over the budget, and a
line over the budget between characters.  A text is one row and its pieces stay in its partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import code_language
from ..rows import flat_map

_TYPES = r"(?:class|interface|enum)"
#: What a line begins with that begins a unit, by language (spaces before it are passed over). Fixed values.
_UNITS = {
    "rust": r"(?:pub )?(?:async )?fn |(?:pub )?(?:struct|enum|trait|impl|mod) |pub (?:const|static) |#\[(?:test|cfg\(test\))\]",
    "python": r"(?:async )?def |class ",
    "go": r"func[ (]|package |type .* (?:struct|interface) ",
    "javascript": r"(?:export )?(?:async )?function |export default function |(?:export )?(?:class|interface) |export type |type .* = |export const .* = (?:async )?\(",
    "java": rf"(?:public|private|protected)(?: .*)? {_TYPES} |(?:public|private|protected) (?=.*\()(?=.*\))[^=]*$|@Override|@Test|package |import ",
    "csharp": r"(?:public|private|protected|internal)(?: .*)? (?:class|interface|struct|enum) |(?:public|private|protected|internal) (?=.*\()[^=]*$|namespace |using |\[.*\]$",
    "cpp": r"class |struct |namespace |template|#include |#define ",
    "php": r"(?:(?:public|private|protected) )?function |class |interface |trait |namespace ",
    "ruby": r"def |class |module |describe |it |context ",
    "swift": r"func |class |struct |enum |protocol |extension |import ",
    "kotlin": r"(?:suspend |override )?fun |(?:data |sealed )?class |object |interface |package |import ",
    "scala": r"def |(?:case )?class |object |trait |val |package |import ",
    "elixir": r"defp? |defmodule |defmacro |test |describe ",
    "dart": r"(?:abstract )?class |void |Future<|import |enum ",
    "lua": r"(?:local )?function ",
    "r": r".*(?:<-|=) function\(",
    "shell": r"function |(?!#).*\(\)(?: \{)?$",
    "sql": r"(?i:CREATE (?:TABLE|INDEX|VIEW|FUNCTION)|ALTER TABLE|INSERT INTO)|-- (?:===|---)",
    "terraform": r"(?:resource|data|variable|output|module|provider) |locals \{",
    "dockerfile": r"(?:FROM|RUN|COPY|ENTRYPOINT|CMD|EXPOSE|ENV|WORKDIR) ",
    "toml": r"\[.*\]$",
}
#: The same for lines that aren't indented.
_OUTER = {
    "javascript": r"const .* = \(",
    "cpp": r"(?!//|#|(?:if|for|while|return|case) )[^\W\d].*\(",
    "yaml": r"(?![#\s-]).*:$",
}
#: Lines that belong to the definition on the next line: their start and that line's.
_BEFORE = {"rust": (r"/// ", r"pub fn |fn |pub struct "), "python": (r"@(?!property)", r"(?:async )?def |class ")}
_NAMES = {
    "rs": "rust", "py": "python", "typescript": "javascript", "ts": "javascript", "tsx": "javascript", "js": "javascript", "jsx": "javascript", "cs": "csharp",
    "c": "cpp", "cc": "cpp", "cxx": "cpp", "h": "cpp", "hpp": "cpp", "rb": "ruby", "kt": "kotlin", "ex": "elixir", "exs": "elixir", "sh": "shell", "bash": "shell", "zsh": "shell",
    "tf": "terraform", "hcl": "terraform", "yml": "yaml",
}


def _compile(language: str) -> re.Pattern:
    parts = [rf"\s*(?:{_UNITS[language]})"] if language in _UNITS else []
    return re.compile("|".join([*parts, *([_OUTER[language]] if language in _OUTER else [])]))


_STARTS = {language: _compile(language) for language in _UNITS.keys() | _OUTER.keys()}


def unit_starts(lines: list[str], language: str) -> list[int]:
    """Numbers of the lines at which a definition begins; a comment or decorator right before it counts as its first line too."""
    language = _NAMES.get(language, language)
    start = _STARTS.get(language)
    if start is None:
        return []
    before, after = map(re.compile, _BEFORE[language]) if language in _BEFORE else (None, None)
    found = []
    for i, line in enumerate(lines):
        ahead = before and before.match(line.strip()) and i + 1 < len(lines) and after.match(lines[i + 1].strip())
        if line.strip() and (ahead or start.match(line.rstrip())):
            found.append(i)
    return found


def code_parts(text: str, language: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters; blank ones are left out.

    With fewer than two definitions there is one unit, cut by lines alone.
    """
    lines = [line.removesuffix("\r") for line in text.split("\n")]
    if lines[-1] == "":
        lines.pop()
    starts = unit_starts(lines, language)
    cuts = sorted({0, *starts, len(lines)}) if len(starts) > 1 else [0, len(lines)]
    out: list[str] = []
    for first, end in zip(cuts, cuts[1:], strict=False):
        held: list[str] = []
        size = 0
        for line in lines[first:end]:
            if held and (len(line) > most or size + 1 + len(line) > most):
                out.append("\n".join(held))
                held = []
            if len(line) > most:
                out += [line[i : i + most] for i in range(0, len(line), most)]
            else:
                size = size + 1 + len(line) if held else len(line)
                held.append(line)
        if held:
            out.append("\n".join(held))
    return [p for p in out if p.strip()]


def code_pieces(df: DataFrame, most: int = 2800, id_col: str = "doc_id", text_col: str = "text", language_col: str | None = None) -> DataFrame:
    """``(id, ordinal, language, piece)`` of every code text; a missing language is guessed from the text's first lines.

    A text within the budget is one piece, whatever is in it; null and blank texts have none.
    """

    def run(key: object, text: str | None, language: str | None) -> Iterator[tuple]:
        text = text or ""
        parts = code_parts(text, language or "", max(1, most)) if len(text.strip()) > most else [text] if text.strip() else []
        yield from ((key, i, language, p) for i, p in enumerate(parts))

    guess = code_language(F.col(text_col))
    language = F.coalesce(F.nullif(F.lower(F.trim(F.col(language_col))), F.lit("")), guess) if language_col else guess
    kind = df.schema[id_col].dataType.simpleString()
    return flat_map(df.select(id_col, text_col, language.alias("language")), run, f"`{id_col}` {kind}, ordinal int, language string, piece string")
