"""Helpers shared by the corpus operators: shared storage, lineage cuts, text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is missing, a local session (tests) gets a folder of its own;
    a cluster session is refused, since its executors could not see the driver's disk.
    """
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="corvine-")
    sc.setCheckpointDir(own)
    return shared_dir(spark)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts the lineage: what follows is recomputed from those files when an executor is
    lost, and a table read by several steps is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvine/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """Write ``df`` in buckets of ``keys`` into the shared folder and read it by name.

    There are as many buckets as a shuffle has partitions, so a join on ``keys`` moves the other side only.
    ``df`` should be dealt out by ``keys`` already: then each task writes its own bucket alone.
    """
    spark = df.sparkSession
    app, name = spark.sparkContext.applicationId, f"{label}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.bucketBy(buckets, *keys).option("path", f"{shared_dir(spark)}/corvine/{app}/{name}").option("compression", "zstd")
    writer.format("parquet").saveAsTable(name)
    NAMED.setdefault(app, []).append(name)
    return spark.table(name)


#: Names of the tables that an application wrote with ``bucketed``.
NAMED: dict[str, list[str]] = {}


def cleanup(spark: SparkSession) -> None:
    """Remove every table that ``materialize`` and ``bucketed`` wrote for this application."""
    for name in NAMED.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
        f"{shared_dir(spark)}/corvine/{spark.sparkContext.applicationId}"
    )
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a worker process keeps for the next task of the operator it serves (see ``kept``), and that operator.
_KEPT: dict[object, object] = {}
_SERVED: list[str] = [""]


def kept(key: object, make: Callable[[], object]) -> object:
    """``make()`` once per worker process, for as long as it serves tasks of one operator.

    Spark gives a worker to later stages too; ``map_rows`` then lets go of what those don't need.
    """
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


#: Bytes of values after which a task hands a batch of results back to Spark.
BATCH_BYTES = 4 << 20
#: Rows of an Arrow batch that become Python objects at a time.
SLICE_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Batches that Spark hands to Python are cut by bytes: texts may be long, and both sides hold a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * BATCH_BYTES))


def map_rows(df: DataFrame, rows_fn: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Apply ``rows_fn`` (an iterator of row tuples to another) to every partition.

    Rows go by Arrow; results leave in batches of about ``BATCH_BYTES``, so memory is bound
    by one input batch and one output batch, whatever a partition holds.
    """
    kinds = T._parse_datatype_string(schema)
    small_batches(df.sparkSession)
    name = f"{rows_fn.__module__}.{rows_fn.__qualname__.split('.<locals>')[0]}"  # the operator that the function is a step of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kinds)
        if _SERVED[0] != name:
            _SERVED[0] = name
            _KEPT.clear()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(i, SLICE_ROWS)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        def made(kept: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), arrow, strict=True)], schema=arrow)

        kept, size = [], 0
        for row in rows_fn(rows()):
            kept.append(row)
            size += 64 + sum(getattr(x, "nbytes", 0) or len(x) * (64 if isinstance(x, list) else 1) for x in row if hasattr(x, "__len__"))
            if size >= BATCH_BYTES:
                yield made(kept)
                kept, size = [], 0
        if kept:
            yield made(kept)
        pa.default_memory_pool().release_unused()  # the process serves further tasks

    return df.mapInArrow(run, kinds)


def carried(df: DataFrame, columns: Sequence[str]) -> str:
    """The part of a schema for columns of ``df`` that ``map_rows`` hands through, named ``in_*``."""
    return "".join(f", `in_{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
