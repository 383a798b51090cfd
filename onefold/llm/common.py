"""What the text operators share: reading tables, texts without nulls, small batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onefold.scratch import written

__all__ = ["STEP_BYTES", "small_batches", "steps", "table", "text_of", "written"]

#: Text bytes that one step of a Python worker holds at a time; a longer text is a step of its own.
STEP_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch between the JVM and Python, about; by default a batch may hold ten thousand texts, however long.
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of BATCH_BYTES, unless the session says otherwise. The setting stays, as Spark reads it when a result is asked for."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """A text column as a string, null as the empty text."""
    small_batches(df.sparkSession)
    return F.coalesce(df[column].cast("string"), F.lit(""))


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of whole rows that hold about `limit` bytes of `column`, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        lo = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(lo, i - lo)
                lo, total = i, 0
            total += int(size)
        yield batch.slice(lo)
