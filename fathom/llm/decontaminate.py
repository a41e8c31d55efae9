"""Benchmark decontamination with one Aho-Corasick automaton.

The automaton holds every window of ten consecutive words of the benchmark's
questions and answers, normalised (a benchmark of more than BLOCK_BYTES has several).
Each text is normalised to the same form and scanned in its own row; matches are mapped back to words and to code points of the
original text.

Words are the runs of bytes that are digits, letters a to z after A to Z are
lower-cased, or not ASCII. A benchmark text shorter than a window, but not
empty, is one window.

Defined cases: a null or empty text has no words and no hits; a null or empty
benchmark text is no item; rows with the same item id count as one item, a null
item id is the item "null"; repeated document rows are judged each; an empty
benchmark finds nothing; other columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathom.llm.arrow import mapped, type_of, utf8

WINDOW = 10
# Bytes of benchmark text in one automaton. Of a larger benchmark there are several,
# built one after the other; a task scans each text with all of them.
BLOCK_BYTES = 2 << 20

_WORD = [chr(b) for b in [*range(0x30, 0x3A), *range(0x61, 0x7B)]]
# Byte to byte: word bytes stay (capitals lower-cased), all else becomes a space.
TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b) in _WORD else 0x20 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def windows_of(words: list[bytes], width: int = WINDOW) -> list[bytes]:
    """The windows of an item's words, in normal form: one space around each word."""
    last = max(len(words) - width, 0)
    return [b" %b " % b" ".join(words[i : i + width]) for i in range(last + 1)] if words else []


def automaton_of(items: list[tuple[str, bytes]], width: int = WINDOW) -> ahocorasick.Automaton:
    """Automaton whose values are (words of the window, ids of the items that have it)."""
    found: dict[bytes, tuple[int, set[str]]] = {}
    for item, text in items:
        for window in windows_of(words_of(text), width):
            found.setdefault(window, (window.count(b" ") - 1, set()))[1].add(item)
    automaton = ahocorasick.Automaton()
    for window, (n, ids) in found.items():
        automaton.add_word(window.decode("latin-1"), (n, sorted(ids)))
    if found:
        automaton.make_automaton()
    return automaton


def scan(
    automata: ahocorasick.Automaton | list[ahocorasick.Automaton], text: bytes
) -> tuple[int, list[int], set[str]]:
    """Number of words, hit words in order, and items found in one text, by one automaton
    or several."""
    if isinstance(automata, ahocorasick.Automaton):
        automata = [automata] if len(automata) else []
    words = words_of(text)
    if not words or not automata:
        return len(words), [], set()
    normal = b" %b " % b" ".join(words)
    line = normal.decode("latin-1")
    matches = [match for automaton in automata for match in automaton.iter(line)]
    if not matches:
        return len(words), [], set()
    spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 0x20)
    hit = np.zeros(len(words) + 1, np.int64)
    ends = np.searchsorted(spaces, [end for end, _ in matches])
    for end, (_, (n, _)) in zip(ends, matches):
        hit[end - n] += 1
        hit[end] -= 1
    ids = set().union(*(found for _, (_, found) in matches))
    return len(words), np.flatnonzero(np.cumsum(hit[:-1]) > 0).tolist(), ids


def spans_of(text: bytes, hits: list[int]) -> list[dict[str, int]]:
    """Runs of hit words as code points of the original text, end exclusive."""
    if not hits:
        return []
    inside = np.frombuffer(text.translate(TO_WORDS), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    # A code point starts at each byte that does not continue one.
    starts = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    point = np.concatenate([[0], np.cumsum(starts)])
    at = np.array(hits)
    breaks = np.flatnonzero(np.diff(at) > 1)
    firsts, lasts = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [-1]])]
    return [
        {"start": int(point[edges[2 * a]]), "end": int(point[edges[2 * b + 1]])}
        for a, b in zip(firsts, lasts)
    ]


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks of bounded size."""
    items = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), utf8(text).alias("body")
    ).where(F.length("body") > 0)
    size = items.agg(F.sum(F.length("body"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    part = F.pmod(F.xxhash64("item", "body"), F.lit(max(n, 1)))
    for k in range(n):
        block = items.where(part == k).distinct() if n > 1 else items.distinct()
        yield [(row["item"], bytes(row["body"])) for row in block.collect()]


def _shared(docs: DataFrame, benchmark: DataFrame, item: str, text: str) -> list:
    """The automata of all blocks, each sent to the executors by itself."""
    built = (automaton_of(block) for block in _blocks(benchmark, item, text))
    return [docs.sparkSession.sparkContext.broadcast(a) for a in built if len(a)]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document: key, n_words, n_hit, items (sorted as strings) and
    spans (code points of the original)."""
    shared = _shared(docs, benchmark, item, item_text)

    def body(part: pa.RecordBatch) -> pa.RecordBatch:
        automata = [s.value for s in shared]
        counts, hits, items, spans = [], [], [], []
        for value in part.column("body").to_pylist():
            n, hit, found = scan(automata, value)
            counts.append(n)
            hits.append(len(hit))
            items.append(sorted(found))
            spans.append(spans_of(value, hit))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array(counts, pa.int64()),
                pa.array(hits, pa.int64()),
                pa.array(items, pa.list_(pa.string())),
                pa.array(spans, span),
            ],
            ["key", "n_words", "n_hit", "items", "spans"],
        )

    rows = docs.select(F.col(key).alias("key"), utf8(text).alias("body"))
    span = "struct<start:long,end:long>"
    schema = f"key {type_of(docs, key)}, n_words long, n_hit long, items array<string>, spans array<{span}>"
    found = mapped(rows, "body", body, schema)
    return found.select(F.col("key").alias(key), "n_words", "n_hit", "items", "spans")


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns.
    Rows stay where they are."""
    shared = _shared(docs, benchmark, item, item_text)

    def body(part: pa.RecordBatch) -> pa.RecordBatch:
        automata = [s.value for s in shared]
        texts = part.column(text).cast(pa.binary()).to_pylist()
        return part.filter(pa.array([not scan(automata, t or b"")[1] for t in texts], pa.bool_()))

    return mapped(docs, text, body, docs.schema)
