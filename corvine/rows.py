"""Row functions in Arrow batches: for what built-in expressions can't say."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of an Arrow batch that become Python objects at a time.
SLICE_ROWS = 256
#: Bytes of an Arrow batch that Spark hands to Python.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches that Spark hands to Python are cut by bytes: texts may be long, and a worker holds a batch with what it makes of it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def flat_map(df: DataFrame, fn: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Rows made from each row of ``df``; ``fn`` takes a row's values and yields tuples.

    A narrow step: rows stay in their partition, and memory is that of one slice of rows.
    """
    kinds = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kinds)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                made = [out for row in zip(*(c.to_pylist() for c in part.columns), strict=True) for out in fn(*row)]
                if made:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, kinds)
