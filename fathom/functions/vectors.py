"""Vector arithmetic on array columns, evaluated inside the JVM.

Every score is a similarity: larger is closer. Distances have their own
functions. Used for one-question search and per-row checks; table-to-table
search goes through fathom.operators.knn, whose kernels work on blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from fathom.functions.columns import total

METRICS = ("cosine", "dot", "l2")


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(as_doubles(x), as_doubles(y), lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def squared_l2(x: Column, y: Column) -> Column:
    return total(F.zip_with(as_doubles(x), as_doubles(y), lambda a, b: (a - b) * (a - b)))


def cosine(x: Column, y: Column) -> Column:
    """0 where a vector has no direction."""
    scale = norm(x) * norm(y)
    return F.when(scale > 0, dot(x, y) / F.nullif(scale, F.lit(0.0))).otherwise(F.lit(0.0))


def cosine_distance(x: Column, y: Column) -> Column:
    return 1 - cosine(x, y)


def negative_dot(x: Column, y: Column) -> Column:
    return -dot(x, y)


def similarity(metric: str, x: Column, y: Column) -> Column:
    if metric == "cosine":
        return cosine(x, y)
    if metric == "dot":
        return dot(x, y)
    if metric == "l2":
        return -squared_l2(x, y)
    raise ValueError(f"metric must be one of {METRICS}")


def is_valid(v: Column, dim: int) -> Column:
    """Declared dimension, no null and no non-finite element."""
    finite = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce((F.size(v) == dim) & finite, F.lit(False))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def to_half(v: pa.Array) -> pa.Array:
    """Values rounded to half precision; Spark has no 16-bit type, so they
    stay in array<float>. A null value becomes NaN."""
    lengths = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
    ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    values = v.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    halves = pa.array(values.astype(np.float16).astype(np.float32))
    return pa.ListArray.from_arrays(ends, halves, mask=pc.is_null(v) if v.null_count else None)
