"""Where models plug in. Each takes a factory that loads the model once per
Python worker and returns a function over a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fathom.functions.text import standard
from fathom.session import bound_batches

READ = T.StructType(
    [
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("start", T.ArrayType(T.DoubleType())),
        T.StructField("end", T.ArrayType(T.DoubleType())),
    ]
)


def embedder(make_encode: Callable, batch_size: int = 256, prompt: str = "") -> Callable[[Column], Column]:
    """make_encode() -> f(texts) -> matrix. `prompt` goes before questions for
    models that want one."""
    encode = predict_batch_udf(make_encode, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return lambda text: encode(F.concat(F.lit(prompt), text))


def scorer(make_score: Callable, batch_size: int = 256) -> Callable[[Column, Column], Column]:
    """make_score() -> f(questions, contexts) -> raw scores."""
    return predict_batch_udf(make_score, return_type=T.DoubleType(), batch_size=batch_size)


def reader(make_read: Callable, batch_size: int = 64) -> Callable[[Column, Column], Column]:
    """make_read() -> f(questions, contexts) -> per row a dict of the arrays
    tokens, start and end."""
    return predict_batch_udf(make_read, return_type=READ, batch_size=batch_size)


@dataclass(frozen=True)
class HashedEmbedding:
    """Embedding without a model: hashed term counts weighted by rarity, unit length.

    What is fitted are the rarities, `dim` numbers whatever the corpus. They are kept
    beside an index, so that corpus and questions are embedded alike."""

    rarity: tuple[float, ...]

    @classmethod
    def fit(cls, corpus: DataFrame, text: str, dim: int = 256) -> HashedEmbedding:
        """One pass over the corpus, of which `dim` numbers reach the driver. The column
        holds texts or their words."""

        def held(batch: pa.RecordBatch) -> np.ndarray:
            return np.append((_counts(batch.column(0), dim) > 0).sum(axis=0), batch.num_rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(dim + 1, np.int64)
            for part in _slices(batches):
                total += held(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array(total)], ["bucket", "n"])

        found = np.zeros(dim + 1, np.int64)
        counts = _tokens(corpus, text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        for row in counts.collect():
            found[row["bucket"]] = row["n"]
        return cls(tuple(np.log((found[dim] + 1) / (found[:dim] + 1)).tolist()))

    def write(self, spark: SparkSession, path: str) -> None:
        rows = spark.createDataFrame(list(enumerate(self.rarity)), "bucket int, rarity double")
        rows.coalesce(1).write.parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> HashedEmbedding:
        return cls(tuple(row["rarity"] for row in spark.read.parquet(path).orderBy("bucket").collect()))

    def embed(self, rows: DataFrame, text: str, vector: str = "embedding", counts: str | None = None) -> DataFrame:
        """The rows with the vector of a text column; a text without words has zeros.

        With `counts` the column holds a text's distinct words, as an index stores them,
        and `counts` how often each occurs; these two columns are left out."""
        rarity = np.array(self.rarity)
        times = [] if counts is None else [F.coalesce(F.col(counts), F.array().cast("array<int>")).alias("_counts")]
        first = 1 + len(times)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _slices(batches):
                values = _counts(part.column(0), len(rarity), *part.columns[1:first]) * rarity
                length = np.sqrt((values**2).sum(axis=1))
                values = (values / np.where(length > 0, length, 1)[:, None]).astype(np.float32)
                ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(rarity))
                found = pa.ListArray.from_arrays(ends, pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[first:], found], [*part.schema.names[first:], vector])

        kept = [c for c in rows.columns if c not in (vector, *([text, counts] if times else []))]
        schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(vector, T.ArrayType(T.FloatType()))])
        return _tokens(rows, text, *times, *kept).mapInArrow(run, schema)


def _tokens(rows: DataFrame, text: str, *more: Column | str) -> DataFrame:
    bound_batches(rows.sparkSession)
    split = isinstance(rows.schema[text].dataType, T.ArrayType)
    words = F.coalesce(F.col(text) if split else standard(F.col(text)), F.array().cast("array<string>"))
    return rows.select(words.alias("_words"), *more)


# Rows whose counts are held at once.
ROWS = 4096


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            yield batch.slice(first, ROWS)


def _counts(words: pa.Array, dim: int, times: pa.Array | None = None) -> np.ndarray:
    """How many words of each text, or of how many `times` each, are in each bucket: a
    word's is the first eight digits of its MD5, modulo dim. Each distinct word is
    hashed once a slice."""
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    buckets = [int(md5(w.encode()).hexdigest()[:8], 16) % dim for w in coded.dictionary.to_pylist()]
    of_word = np.array(buckets, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
    cells = np.repeat(np.arange(len(lengths)), lengths) * dim + of_word
    weights = None if times is None else times.flatten().to_numpy(zero_copy_only=False)
    return np.bincount(cells, weights, minlength=len(lengths) * dim).reshape(len(lengths), dim)


def hashed_embedding(
    rows: DataFrame, text: str, dim: int = 256, vector: str = "embedding", fit_on: DataFrame | None = None
) -> DataFrame:
    """Rows embedded by what is fitted on them, or on the corpus `fit_on`."""
    return HashedEmbedding.fit(rows if fit_on is None else fit_on, text, dim).embed(rows, text, vector)
