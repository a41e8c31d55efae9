"""Language identification with language-bitmask n-gram filters.

For every language the most frequent character n-grams of a bounded sample are
put into one bit-sliced Bloom filter: each slot is a mask with a bit for each
language, so the masks at an n-gram's slots, and-ed, give all languages that
contain it. A text's n-grams are looked up, the bits of each language are
counted, and the count is corrected for the language's share of chance hits,
which follows from how full its slice is. The largest corrected count decides.

N-grams are taken from words of letters, lower-cased, with one blank at either
end; they never reach across words.

The sample is, for every language, the SAMPLE labelled rows with the smallest
hash of the key; n-grams are counted on the executors, and GRAMS of them for each
language reach the driver.

Defined cases: a text that is null or has no letter is `und` with score 0, and
so is every text if no labelled row is given; ties go to the first language by
name; rows without a label are not learned from; repeated rows are predicted
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fathom.llm.arrow import mapped, type_of
from fathom.llm.minhash import mixed

SAMPLE = 2000
GRAMS = 20_000
SIZES = (2, 3, 4)
PROBES = 3
# Slots for each n-gram put into the filter.
ROOM = 16
UNKNOWN = "und"
# Code points that are looked at for letters one by one; those beyond are letters
# if Python says so.
_TABLE = 1 << 17


def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(_TABLE)])


def codes_of(texts: list[str | None], is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, anything but letters as a blank, and
    where each text starts. A blank stands before and after each text."""
    parts, starts, at = [], [], 0
    for text in texts:
        raw = f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass")
        part = np.frombuffer(raw, np.uint32)
        starts.append(at)
        at += len(part)
        parts.append(part)
    codes = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    known = is_letter[np.minimum(codes, _TABLE - 1)]
    for i in np.flatnonzero(codes >= _TABLE):
        known[i] = chr(codes[i]).isalpha()
    return np.where(known, codes, np.uint32(32)), np.array(starts, np.int64)


def grams_of(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the n-grams of a size: a blank may begin or end one,
    none is inside, and one letter at least is in it."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    blank = codes == 32
    good = ~(blank[:n] & blank[1:]) if size == 2 else np.ones(n, bool)
    for i in range(1, size - 1):
        good &= ~blank[i : i + n]
    at = np.flatnonzero(good)
    value = np.full(len(at), size, np.uint64)
    for i in range(size):
        value = value * np.uint64(0x100000001B3) + codes[at + i]
    return at, mixed(value * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Filter:
    """Languages by bit, and the mask of each slot, in words of 64 bits."""

    languages: list[str]
    slots: np.ndarray

    @classmethod
    def of(cls, languages: list[str], grams: dict[str, np.ndarray]) -> Filter:
        total = sum(len(g) for g in grams.values())
        size = 1 << max(10, int(np.ceil(np.log2(max(ROOM * total, 1)))))
        out = cls(languages, np.zeros((size, -(-len(languages) // 8)), np.uint8))
        for bit, name in enumerate(languages):
            for probe in out.probes(grams.get(name, np.zeros(0, np.uint64))):
                out.slots[probe, bit // 8] |= np.uint8(1 << (bit % 8))
        return out

    def probes(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        step = (grams >> np.uint64(40)) | np.uint64(1)
        for k in range(PROBES):
            yield ((grams + np.uint64(k) * step) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Mask of the languages that contain each n-gram."""
        found = None
        for probe in self.probes(grams):
            found = self.slots[probe] if found is None else found & self.slots[probe]
        return found

    def chance(self) -> np.ndarray:
        """For each language, the share of strange n-grams that it seems to contain."""
        full = np.array([(self.slots[:, b // 8] >> (b % 8) & 1).mean() for b in range(len(self.languages))])
        return full**PROBES

    def counts(self, texts: list[str | None], is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text: n-grams, and corrected counts of each language."""
        codes, starts = codes_of(texts, is_letter)
        total = np.zeros(len(texts), np.int64)
        hits = np.zeros((len(texts), len(self.languages)), np.int64)
        ends = np.append(starts[1:], len(codes))
        for size in SIZES:
            at, grams = grams_of(codes, size)
            low, high = np.searchsorted(at, starts), np.searchsorted(at, ends)
            # An n-gram starts in its own text, as a blank ends each text.
            total += high - low
            masks = self.masks(grams)
            for bit in range(len(self.languages)):
                sums = np.concatenate([[0], np.cumsum(masks[:, bit // 8] >> (bit % 8) & 1, dtype=np.int64)])
                hits[:, bit] += sums[high] - sums[low]
        chance = self.chance()
        return total, (hits - total[:, None] * chance) / (1 - np.minimum(chance, 0.999))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> Filter:
    """A filter learned from the labelled rows given; keep held-out rows away from it."""
    known = docs.where(F.col(language).isNotNull()).select(F.col(key).alias("key"), F.col(language).alias("lang"))
    # Twice as many as wanted pass by their hash, so that few meet for the ranks.
    sizes = known.groupBy("lang").agg(F.count("*").alias("held"))
    share = 2.0 * SAMPLE / F.col("held")
    low = F.lit(-(2.0**63)) + share * 2.0**64
    known = known.join(F.broadcast(sizes), "lang").where((share >= 1) | (F.xxhash64("key") <= low)).drop("held")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    chosen = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE).drop("rank")
    # At most SAMPLE keys of each language.
    keys = F.broadcast(chosen.select("key").distinct())
    labelled = docs.where(F.col(language).isNotNull()).select(
        F.col(key).alias("key"), F.col(language).alias("lang"), F.col(text).cast("string").alias("body")
    )
    sample = labelled.join(keys, "key", "left_semi").select("lang", "body")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = letters()
        for batch in batches:
            names = np.array(batch.column(0).to_pylist())
            texts = batch.column(1).to_pylist()
            for name in np.unique(names).tolist():
                # Each text counts an n-gram once, so long texts do not rule.
                own: list[np.ndarray] = []
                for i in np.flatnonzero(names == name).tolist():
                    codes, _ = codes_of([texts[i]], is_letter)
                    own.append(np.unique(np.concatenate([grams_of(codes, size)[1] for size in SIZES])))
                grams, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)],
                    ["lang", "gram", "n"],
                )

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram")
    counted = counted.agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= GRAMS)
    table = top.select("lang", "gram").toArrow()
    names = np.array(table.column("lang").to_pylist())
    grams = table.column("gram").to_numpy().astype(np.uint64) if len(names) else np.zeros(0, np.uint64)
    languages = sorted(set(names.tolist()))
    return Filter.of(languages, {name: grams[names == name] for name in languages})


def predict(docs: DataFrame, model: Filter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, lang_pred and score, the winner's share of the two
    largest corrected counts."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.slots))
    table: list[np.ndarray] = []

    def body(part: pa.RecordBatch) -> pa.RecordBatch:
        if not table:
            table.append(letters())
        names, scores = [], []
        languages = shared.value[0]
        total, counts = Filter(*shared.value).counts(part.column(1).to_pylist(), table[0])
        for n, row in zip(total.tolist(), np.maximum(counts, 0)):
            if not n or not languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(np.argmax(row))
            rest = float(np.delete(row, best).max()) if len(row) > 1 else 0.0
            names.append(languages[best])
            scores.append(float(row[best]) / (float(row[best]) + rest) if row[best] > 0 else 0.0)
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
            ["key", "lang_pred", "score"],
        )

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("body"))
    schema = f"key {type_of(docs, key)}, lang_pred string, score double"
    return mapped(rows, "body", body, schema).withColumnRenamed("key", key)
