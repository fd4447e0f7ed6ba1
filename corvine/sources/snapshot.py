"""Snapshots of tables, upserts and versioned tables on shared storage."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ranking import first_per_group

SCHEMA_VERSION, ACCEPTED = 7, (6, 7)


def export(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines under ``data/<table>``, then a manifest with schemas and row counts.

    The manifest is written last: a snapshot without one is not complete.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/data/{name}")
        rows.append((name, SCHEMA_VERSION, df.schema.json(), spark.read.schema(df.schema).json(f"{path}/data/{name}").count()))
    spark.createDataFrame(rows, "table_name string, schema_version int, schema string, row_count bigint").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def import_(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a snapshot; an unknown version or a wrong row count is an error."""
    out = {}
    for row in spark.read.schema("table_name string, schema_version int, schema string, row_count bigint").json(f"{path}/manifest").collect():
        if row.schema_version not in ACCEPTED:
            raise ValueError(f"snapshot version {row.schema_version} is not accepted")
        df = spark.read.schema(StructType.fromJson(json.loads(row.schema))).json(f"{path}/data/{row.table_name}")
        if (n := df.count()) != row.row_count:
            raise ValueError(f"{row.table_name} has {n} rows, its manifest says {row.row_count}")
        out[row.table_name] = df
    return out


def restore(spark: SparkSession, path: str, target: str, overwrite: str = "reject") -> dict[str, str]:
    """Publish every table of a snapshot under ``target``; gives the versions by table.

    ``reject`` is an error if any of the tables is there already, before anything is written; ``replace`` makes the snapshot's rows
    their current version, and the old versions stay until they are removed.
    """
    if overwrite not in ("reject", "replace"):
        raise ValueError(f"unknown mode {overwrite}")
    tables = import_(spark, path)
    if overwrite == "reject":
        here = [name for name in tables if _exists(spark, f"{target}/{name}/current")]
        if here:
            raise ValueError(f"tables are there already: {', '.join(sorted(here))}")
    return {name: publish(df, f"{target}/{name}") for name, df in tables.items()}


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """``current`` with rows of ``changes`` put in place of those with equal keys.

    Of several changes to a key, the first in ``order`` counts.
    """
    new = first_per_group(changes, keys, list(order)) if order else changes
    return current.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def publish(df: DataFrame, path: str) -> str:
    """Write a new version of a table and then the pointer that names it; readers never see half of it."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/versions/{version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/current")
    return version


def current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/versions/{spark.read.schema('version string').json(f'{path}/current').first().version}")


def ndjson(df: DataFrame) -> DataFrame:
    """Rows as lines of JSON, for a text sink."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
