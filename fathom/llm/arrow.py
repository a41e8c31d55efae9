"""Helpers for functions that see Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathom.session import bound_batches

# Bytes of text that a function holds at once. A longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def utf8(text: str | Column) -> Column:
    """The text as UTF-8 bytes; a null text is empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("string").cast("binary"), F.lit(b""))


def offsets_of(column: pa.Array) -> np.ndarray:
    """Start of each text or binary value in its buffer, and the end of the last."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column as one byte array, and the offsets in it."""
    at = offsets_of(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Arrow batches of at most that size, or one row, for what is run inside: for
    functions over wide rows, such as pairs of whole sets."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts hold `limit` bytes together, or
    one row if that is longer. An empty batch gives nothing."""
    at = offsets_of(batch.column(name))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(at, at[first] + limit, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def mapped(
    rows: DataFrame,
    text: str,
    body: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """`body` over parts of bounded size of the Arrow batches of `rows`, which are bounded
    themselves."""
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                yield body(part)

    return rows.mapInArrow(run, schema)


def type_of(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()
