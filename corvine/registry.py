"""All queries of the library by name, and DuckDB SQL for those that SQL can express.

A query is registered with ``query(name, oracle)``; the names start with the operator's id.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, *names: str) -> Callable:
    """Register a query.

    ``names`` are tables that the function takes after (spark, sf_dir); ``oracle`` is SQL
    with tables in braces.
    """

    def add(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = (lambda spark, sf_dir: fn(*(tables.load(spark, sf_dir, t) for t in names))) if names else fn
        if oracle:
            ORACLES[name] = tables.oracle(oracle)
        return fn

    return add


for _module in ("relational", "aggregates", "text", "preparation", "search", "graph", "records", "web", "facts", "ops", "sinks"):
    importlib.import_module(f"corvine.plans.{_module}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid document search over the tables at ``sf_dir``."""
    return QUERIES["r02_hybrid_document_search"](spark, sf_dir)
