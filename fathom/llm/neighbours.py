"""Approximate nearest neighbours by inner product over rotated one-bit codes.

Every vector is scaled to length one, rotated by a fixed random rotation and kept
as its signs, packed to bits, with two scalars: its length and the inner product
of the code with the rotated vector (`align`). A query, rotated alike, has an
inner product with the code that, divided by align, estimates the true one
without bias; the error is normal with a deviation of
sqrt((1 - align^2) / align^2 / (bits - 1)). Short vectors are filled up with zeros
before they are rotated, so that a code has LEAST_BITS bits or more: with fewer the
bound is so wide that most rows would be reranked. Vectors whose estimate plus
DEVIATIONS of these reaches the k-th best score known are reranked on the
original vectors, in double precision, summed in order of the dimensions.

Queries are searched in blocks of about BLOCK against all codes, which stay where
they lie; each task hands on k rows a query. The k-th best score among a sample
of SAMPLE rows is each query's first threshold; it is a real row's score, so it
loses nothing.

Defined cases: vectors that are null or zero, or hold null or non-finite
components, or have another length than most, take no part; ties go to the
smaller id; a row is never its own query's neighbour, nor is a row with the same
id; query rows with one id are one query; an empty table, or one without a
query, gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fathom.llm.arrow import type_of
from fathom.session import settled

DEVIATIONS = 4.5
LEAST_BITS = 512
BLOCK = 4096
SAMPLE = 4096
SEED = 5
# Codes compared, and pairs reranked, at once.
CODES = 1024
PAIRS = 50_000


def code_bits(dims: int) -> int:
    return max(dims, LEAST_BITS)


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """Random rotation of vectors, filled up with zeros to the length of a code: of
    the orthogonal matrix only the columns that meet no zero."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((code_bits(dims), dims)))
    return q * np.sign(np.diag(r))


def sound(vector: str, dims: int) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    column = F.col(vector)
    return (F.size(column) == dims) & F.forall(column, finite) & F.exists(column, lambda x: x != 0)


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def _binary(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in matrix], pa.binary())


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def encode(rows: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(key, code, length, align, vector): the index, one row per sound vector."""
    turn = rotation(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _rows(batch.column(1), dims)
            length = np.sqrt((values**2).sum(axis=1))
            turned = (values / length[:, None]) @ turn.T
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    _binary(np.packbits(turned > 0, axis=1)),
                    pa.array(length),
                    pa.array(np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])),
                    _binary(values),
                ],
                ["key", "code", "length", "align", "vector"],
            )

    picked = rows.where(sound(vector, dims)).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    schema = f"key {type_of(rows, key)}, code binary, length double, align double, vector binary"
    return picked.mapInArrow(run, schema)


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in order."""
    return np.cumsum(x * y, axis=1)[:, -1] if len(x) else np.zeros(0)


class Best:
    """The k best (score, id) of each query seen so far."""

    def __init__(self, queries: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.query = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.row = np.zeros(0, np.int64)  # places in `ids`
        self.ids: list[pa.Array] = []
        self.queries = queries

    def add(self, query: np.ndarray, score: np.ndarray, row: np.ndarray, ids: np.ndarray) -> None:
        """`ids` sorts like the keys; `row` indexes into all rows kept so far."""
        query, score, row = (np.concatenate(p) for p in ((self.query, query), (self.score, score), (self.row, row)))
        order = np.lexsort((ids[row], -score, query))
        query, score, row = query[order], score[order], row[order]
        first = np.searchsorted(query, np.arange(self.queries))
        rank = np.arange(len(query)) - first[query]
        kth = rank == self.k - 1
        self.least[query[kth]] = np.maximum(self.least[query[kth]], score[kth])
        keep = rank < self.k
        self.query, self.score, self.row = query[keep], score[keep], row[keep]


def _rounds(upper: np.ndarray, least: np.ndarray, k: int) -> Iterator[np.ndarray | bool]:
    """Which codes are looked at first: all, or if a query has no threshold yet, the
    k with the largest bounds, which give it one."""
    if np.isfinite(least).all():
        yield True
        return
    top = min(k, upper.shape[1])
    led = np.zeros(upper.shape, bool)
    np.put_along_axis(led, np.argpartition(-upper, top - 1, axis=1)[:, :top], True, axis=1)
    yield led
    yield ~led


def _searched(index: DataFrame, block: list, k: int, dims: int, deviations: float) -> DataFrame:
    """k best rows per query and task, of those that may be among the best."""
    keys = np.array([row["key"] for row in block])
    queries = np.frombuffer(b"".join(bytes(row["vector"]) for row in block), np.float64).reshape(len(block), dims)
    least = np.array([row["least"] for row in block])
    shared = index.sparkSession.sparkContext.broadcast((keys, queries, least))
    kind = type_of(index, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, queries, least = shared.value
        length = np.sqrt((queries**2).sum(axis=1))
        turned = ((queries / length[:, None]) @ rotation(dims).T).astype(np.float32)
        bits = turned.shape[1]
        best = Best(len(keys), k, least)
        ids = np.zeros(0, keys.dtype)
        for batch in batches:
            for first in range(0, batch.num_rows, CODES):
                part = batch.slice(first, CODES)
                own = part.column(0).to_numpy(zero_copy_only=False)
                vectors = _matrix(part.column(4), "f8")
                norm, align = (part.column(i).to_numpy() for i in (2, 3))
                signs = np.unpackbits(_matrix(part.column(1), "u1"), axis=1, count=bits).astype(np.float32) * 2 - 1
                estimate = (turned @ signs.T) / (np.sqrt(bits) * align).astype(np.float32)
                # A little more than the bound, for single precision.
                slack = deviations * np.sqrt(np.maximum(1 - align**2, 0) / align**2 / (bits - 1)) + 1e-5
                # Upper bounds of the inner products of the scaled query, query by code.
                estimate += slack.astype(np.float32)
                upper = estimate * norm
                same = np.nonzero(np.isin(own, keys))[0]
                for c in same.tolist():
                    upper[keys == own[c], c] = -np.inf
                base, ids = len(ids), np.concatenate([ids, own])
                for chosen in _rounds(upper, best.least, k):
                    q, c = np.nonzero((upper >= ((best.least - 1e-9) / length)[:, None]) & chosen & (upper > -np.inf))
                    for at in range(0, len(q), PAIRS):
                        i, j = q[at : at + PAIRS], c[at : at + PAIRS]
                        score = inner(queries[i], vectors[j])
                        good = score >= best.least[i] - 1e-9
                        best.add(i[good], score[good], base + j[good], ids)
                # Only rows that are still among the best are remembered.
                used, place = np.unique(best.row, return_inverse=True)
                ids, best.row = ids[used], place
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys[best.query]),
                pa.array(ids[best.row]),
                pa.array(best.score),
            ],
            ["query", "key", "score"],
        )

    return index.mapInArrow(run, f"query {kind}, key {kind}, score double")


def _thresholds(queries: DataFrame, sample: list, k: int, dims: int) -> DataFrame:
    """Queries with the k-th best score among the sampled rows."""
    keys = np.array([row["key"] for row in sample])
    rows = np.frombuffer(b"".join(bytes(row["vector"]) for row in sample), np.float64).reshape(-1, dims)
    shared = queries.sparkSession.sparkContext.broadcast((keys, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, CODES):
                part = batch.slice(first, CODES)
                score = _matrix(part.column(1), "f8") @ rows.T
                score[part.column(0).to_numpy(zero_copy_only=False)[:, None] == keys] = -np.inf
                enough = score.shape[1] >= k
                least = -np.partition(-score, k - 1, axis=1)[:, k - 1] if enough else np.full(len(score), -np.inf)
                # A little below, as these products are summed in another order.
                least = least - 1e-9 * np.maximum(1, np.abs(least))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(least)], ["key", "vector", "least"]
                )

    schema = f"key {type_of(queries, 'key')}, vector binary, least double"
    return queries.select("key", "vector").mapInArrow(run, schema)


def search(
    rows: DataFrame,
    is_query: Column,
    k: int,
    key: str = "vec_id",
    vector: str = "embedding",
    deviations: float = DEVIATIONS,
) -> DataFrame:
    """(query_id, rank, key, score): the k nearest rows of every row that is a query."""
    spark, kind = rows.sparkSession, type_of(rows, key)
    empty = spark.createDataFrame([], f"query {kind}, key {kind}, score double")
    sizes = rows.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count()
    most = sizes.orderBy(F.desc("count"), "d").first()
    parts: list[DataFrame] = []
    if most is not None:
        dims = most["d"]
        index = settled(encode(rows.where(F.col(key).isNotNull()), key, vector, dims), "codes")
        queries = index.where(is_query).dropDuplicates(["key"])
        sample = index.select("key", "vector").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()
        queries = settled(_thresholds(queries, sample, k, dims), "queries")
        blocks = -(-queries.count() // BLOCK)
        part = F.pmod(F.xxhash64("key"), F.lit(max(blocks, 1)))
        for n in range(blocks):
            block = queries.where(part == n).orderBy("key").collect()
            if block:
                found = _searched(index, block, k, dims, deviations)
                parts.append(settled(found, "found") if blocks > 1 else found)
    found = reduce(DataFrame.unionByName, parts, empty) if len(parts) != 1 else parts[0]
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("key").alias(key), "score")
