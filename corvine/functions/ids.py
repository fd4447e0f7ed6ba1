"""Stable identifiers as columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of the library's own identifiers: the name-based UUID of its name under that of DNS names.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "corvine")


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The name-based UUID (version 5) of a text; null for null."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    # null for null without a condition, inside which the digest would be made anew for every part
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def uuid5_sql(name: str, namespace: uuid.UUID = NAMESPACE) -> str:
    """The same in DuckDB's SQL, of an expression."""
    digest = f"sha1(unhex('{namespace.hex}') || encode({name}))"
    cut = lambda a, n: f"substr({digest}, {a}, {n})"
    return f"({cut(1, 8)} || '-' || {cut(9, 4)} || '-5' || {cut(14, 3)} || '-' || substr('89ab', (instr('0123456789abcdef', {cut(17, 1)}) - 1) % 4 + 1, 1) || {cut(18, 3)} || '-' || {cut(21, 12)})"
