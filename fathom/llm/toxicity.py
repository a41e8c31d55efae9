"""Toxicity with a factorisation machine over hashed terms.

Terms of a text are its words, the beginnings of its words, and beginnings that
occur twice or more; each is hashed to a bucket. Buckets whose share of toxic and
clean texts differs significantly are the features; the machine gives each a
weight and a short vector, and the product of two vectors is the weight of the
pair, so an insult near a group mention can score more, or less, than the sum of
both. The score is a probability at the labelled rows' share of toxic texts.

The model is fitted on a bounded sample: at most SAMPLE labelled rows of either
class, those with the smallest hash of the key; equal texts count once. Bucket
counts are summed on the executors, and only FEATURES buckets and the sample's
features reach the driver.

Defined cases: a null or empty text scores as a text without features; labels
that are null are left out, of repeated labels of a key the largest counts; with
no toxic or no clean label the score is the labelled share (0 without labels);
repeated rows score alike; an empty table gives no rows; other columns are kept
by `clean` and ignored by `scores`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fathom.llm.arrow import mapped, slices, type_of
from fathom.session import bound_batches

SAMPLE = 6000
BUCKETS = 1 << 20
FEATURES = 1024
# A feature is in so many sampled texts, and its shares differ by so many
# standard errors.
LEAST_TEXTS = 5
LEAST_Z = 5.0
FACTORS = 8
STEPS = 200
RATE = 0.05
PENALTY = 1e-3
SEED = 7
TOXIC = 0.7
# Lengths of the beginnings that are terms. A longer word is a term as a whole too.
BEGINNINGS = (4, 5, 6, 7)
VOCABULARY = 1 << 17
# While buckets are counted each word has all of its own, several times the memory.
COUNTED = 1 << 14

_WORDS = re.compile(r"[^\W\d_]+")


def _bucket(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass")) % BUCKETS


class WordTerms(dict):
    """Word to (buckets if seen once, buckets if seen again), remembered for the
    words seen last; `chosen` restricts the buckets."""

    def __init__(self, chosen: dict[int, int] | None = None, most: int = VOCABULARY):
        super().__init__()
        self.chosen, self.most = chosen, most

    def __missing__(self, word: str) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
        if len(self) >= self.most:
            self.clear()
        starts = [word[:n] for n in BEGINNINGS if len(word) >= n]
        once = [_bucket("w " + word), *(_bucket("b " + s) for s in starts)]
        again = [_bucket("r " + s) for s in starts]
        if self.chosen is not None:
            once = [self.chosen[b] for b in once if b in self.chosen]
            again = [self.chosen[b] for b in again if b in self.chosen]
        value = self[word] = (tuple(once), tuple(again))
        return value


def terms_of(text: str | None, memory: WordTerms) -> set[int]:
    """Features of a text."""
    found: set[int] = set()
    first: set[int] = set()
    for word in _WORDS.findall((text or "").lower()):
        once, again = memory[word]
        if once:
            found.update(once)
        if again:
            for bucket in again:
                # A repeated beginning is one seen with its second word.
                (found if bucket in first else first).add(bucket)
    return found


@dataclass
class Model:
    """Feature indices by bucket, and the machine's parameters."""

    chosen: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def parts(self) -> tuple[dict[int, int], float, np.ndarray, np.ndarray]:
        """What is sent to executors, which need not have this class."""
        return self.chosen, self.bias, self.weights, self.factors

    def score(self, features: set[int]) -> float:
        at = sorted(features)
        v = self.factors[at]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        raw = self.bias + float(self.weights[at].sum()) + pairs
        return float(1 / (1 + np.exp(-np.clip(raw, -40, 40))))


def machine(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors for binary features x, labels y and row weights
    that sum to 1, by Adam on the log loss."""
    rng = np.random.default_rng(SEED)
    base = float(np.clip((share * y).sum(), 1e-4, 1 - 1e-4))
    now = [np.array([np.log(base / (1 - base))]), np.zeros(x.shape[1]), rng.normal(0, 0.05, (x.shape[1], FACTORS))]
    means, squares = [np.zeros_like(p) for p in now], [np.zeros_like(p) for p in now]
    for step in range(1, STEPS + 1):
        bias, w, v = now
        s = x @ v
        raw = bias[0] + x @ w + 0.5 * (s**2 - x @ v**2).sum(axis=1)
        g = share * (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y)
        back = x.T @ g
        slopes = [
            np.array([g.sum()]),
            back + PENALTY * w / len(w),
            x.T @ (g[:, None] * s) - v * back[:, None] + PENALTY * v / len(w),
        ]
        for i, slope in enumerate(slopes):
            means[i] = 0.9 * means[i] + 0.1 * slope
            squares[i] = 0.999 * squares[i] + 0.001 * slope**2
            size = means[i] / (1 - 0.9**step) / (np.sqrt(squares[i] / (1 - 0.999**step)) + 1e-8)
            now[i] = now[i] - RATE * size
    return float(now[0][0]), now[1], now[2]


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[DataFrame, dict[int, int]]:
    """Sampled texts with their labels, and how many labelled keys each class has."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key)
    known = known.agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("y"))
    totals = {row["y"]: row["n"] for row in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows = [
        row
        for y in (0, 1)
        for row in known.where(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(SAMPLE).collect()
    ]
    chosen = spark.createDataFrame(rows, known.schema)
    # At most 2 * SAMPLE keys, so the broadcast has a bound.
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("body"))
    sample = texts.join(F.broadcast(chosen.select(F.col(key).alias("key"), "y")), "key")
    return sample.groupBy(F.coalesce("body", F.lit("")).alias("body")).agg(F.max("y").alias("y")), totals


def _bucket_counts(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, counts = WordTerms(most=COUNTED), np.zeros((2, BUCKETS), np.int32)
        for part in (part for batch in batches for part in slices(batch, "body")):
            for text, y in zip(part.column("body").to_pylist(), part.column("y").to_pylist()):
                counts[y][list(terms_of(text, memory))] += 1
        used = np.flatnonzero(counts.sum(axis=0))
        for first in range(0, len(used), 100_000):
            at = used[first : first + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), *(pa.array(counts[y][at].astype(np.int64)) for y in (0, 1))],
                ["bucket", "clean", "toxic"],
            )

    partial = sample.mapInArrow(run, "bucket long, clean long, toxic long")
    return partial.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model of the labelled rows given; keep held-out labels away from it."""
    bound_batches(docs.sparkSession)
    sample, totals = _sample(docs, labels, key, text, label)
    sizes = {row["y"]: row["n"] for row in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    base = totals.get(1, 0) / max(sum(totals.values()), 1)
    if len(sizes) < 2:
        bias = float(np.log(base / (1 - base))) if 0 < base < 1 else (40.0 if base else -40.0)
        return Model({}, bias, np.zeros(0), np.zeros((0, FACTORS)))
    clean, toxic = F.col("clean"), F.col("toxic")
    both = (clean + toxic) / (sizes[0] + sizes[1])
    error = F.sqrt(both * (1 - both) * (1 / sizes[0] + 1 / sizes[1]))
    z: Column = F.abs(toxic / sizes[1] - clean / sizes[0]) / error
    best = (
        _bucket_counts(sample)
        .where((clean + toxic >= LEAST_TEXTS) & (both < 1))
        .select("bucket", z.alias("z"))
        .where(F.col("z") >= LEAST_Z)
        .orderBy(F.desc("z"), "bucket")
        .limit(FEATURES)
        .collect()
    )
    chosen = {row["bucket"]: i for i, row in enumerate(best)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordTerms(chosen)
        for part in (part for batch in batches for part in slices(batch, "body")):
            found = [sorted(terms_of(t, memory)) for t in part.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int32())), part.column("y")], ["at", "y"]
            )

    rows = sample.mapInArrow(features, "at array<int>, y int").groupBy("at", "y").agg(F.count("*").alias("n"))
    rows = sorted((tuple(r["at"]), r["y"], r["n"]) for r in rows.collect())
    x = np.zeros((len(rows), max(len(chosen), 1)), np.float32)
    for i, (at, _, _) in enumerate(rows):
        x[i, list(at)] = 1
    y = np.array([r[1] for r in rows], np.float64)
    # Each class weighs as much as it has labelled keys.
    share = np.array([n * totals[k] / sizes[k] for _, k, n in rows], np.float64)
    bias, weights, factors = machine(x, y, share / share.sum())
    return Model(chosen, bias, weights[: len(chosen)], factors[: len(chosen)])


def _held(docs: DataFrame, model: Model) -> Callable[[], tuple[Model, WordTerms]]:
    """Gives the model and a memory of words inside a task, made once a worker."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())
    made: list[tuple[Model, WordTerms]] = []

    def get() -> tuple[Model, WordTerms]:
        if not made:
            made.append((Model(*shared.value), WordTerms(shared.value[0])))
        return made[0]

    return get


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key and score."""
    held = _held(docs, model)

    def body(part: pa.RecordBatch) -> pa.RecordBatch:
        machine_, memory = held()
        values = [machine_.score(terms_of(t, memory)) for t in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.float64())], ["key", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("body"))
    found = mapped(rows, "body", body, f"key {type_of(docs, key)}, score double")
    return found.select(F.col("key").alias(key), "score")


def clean(docs: DataFrame, model: Model, text: str = "text", limit: float = TOXIC) -> DataFrame:
    """The documents that score below the limit, with all their columns."""
    held = _held(docs, model)

    def body(part: pa.RecordBatch) -> pa.RecordBatch:
        machine_, memory = held()
        texts = part.column(text).to_pylist()
        return part.filter(pa.array([machine_.score(terms_of(t, memory)) < limit for t in texts], pa.bool_()))

    return mapped(docs, text, body, docs.schema)
