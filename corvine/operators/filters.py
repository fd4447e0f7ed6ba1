"""Predicates of search and listing, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_head(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of revisions that are their active document's readable head; filter before any limit."""
    head = documents.where("document_state = 'active'").select("document_id", F.col("readable_revision_id").alias("revision_id"))
    return rows.join(head, ["document_id", "revision_id"], "left_semi")


def overlaps(at: Column, until: Column, low: Column | None, high: Column | None) -> Column:
    """Does [at, until] overlap [low, high]?  A missing ``at`` fails only where a bound is set."""
    keep = F.lit(True)
    if low is not None:
        keep = keep & (F.coalesce(until, at) >= low)
    if high is not None:
        keep = keep & (at <= high)
    return F.coalesce(keep, F.lit(False))


def all_terms(text: Column, terms: list[str]) -> Column:
    """Does every term occur?  Numbers must stand between blanks."""
    low, spaced = F.lower(text), F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    keep = F.lit(True)
    for t in terms:
        keep = keep & (F.contains(spaced, F.lit(f" {t} ")) if t.isdigit() else F.contains(low, F.lit(t.lower())))
    return keep


def any_term(text: Column, terms: list[str]) -> Column:
    """Does any term occur?"""
    keep = F.lit(False)
    for t in terms:
        keep = keep | F.contains(F.lower(text), F.lit(t.lower()))
    return keep


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(padded, of)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all of both; 0 where there are none."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def near_token(a: Column, b: Column) -> Column:
    """Equal, or both of five characters or more, one first character, one edit at most."""
    long = (F.length(a) >= 5) & (F.length(b) >= 5) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))
    return (a == b) | (long & (F.levenshtein(a, b) <= 1))


def related_prefix(target: Column, label: Column) -> Column:
    """A longer label that shares all but at most one of the target's characters, from the start."""
    n = F.length(target)
    same = F.substring(label, F.lit(1), F.greatest(n - 1, F.lit(4))) == F.substring(target, F.lit(1), F.greatest(n - 1, F.lit(4)))
    return (n >= 5) & (F.length(label) > n) & same


def identifier_shape(term: Column) -> Column:
    """Does a term look like an identifier: separator, digit, camel case or all capitals?"""
    return (
        term.rlike(r"[_./:\-]") | term.rlike(r"[0-9]") | term.rlike(r"\p{Ll}\p{Lu}") | (term.rlike(r"^\p{Lu}{2,}$"))
    )


def literal_kind(text: Column) -> Column:
    """Kind of a literal by its shape, first hit wins."""
    return (
        F.when(text.rlike(r"^https?://"), "url")
        .when(text.rlike(r"^/"), "path")
        .when(text.rlike(r"^v?[0-9]+(\.[0-9]+)+$"), "version")
        .when(text.rlike(r"^[0-9]+$"), "numeric_code")
        .when(identifier_shape(text), "identifier")
        .otherwise("other")
    )


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ``*`` any run, ``?`` one character."""
    import re

    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def url_allowed(url: Column, path: Column, allow: list[tuple[str, str]], block: list[tuple[str, str]]) -> Column:
    """Reason of the decision on a URL: blocked patterns first, then allowed ones if there are any."""

    def hit(kind: str, pattern: str) -> Column:
        if kind == "url_prefix":
            return F.startswith(url, F.lit(pattern))
        return F.startswith(path, F.lit(pattern)) if kind == "path_prefix" else url.rlike(glob_pattern(pattern))

    any_of = lambda rules: F.exists(F.array(*[hit(*r) for r in rules]), lambda x: x) if rules else F.lit(False)
    return F.when(any_of(block), "blocked").when(any_of(allow) if allow else F.lit(True), "allowed").otherwise("not_allowed")
