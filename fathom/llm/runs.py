"""Periodic runs of words, by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q that is as long as
can be and has at least max(LEAST, TIMES * q) words. In a text's suffix automaton
the prefix that ends at word i is a state; the path from it up the suffix links
names all suffixes of the prefix. Every state knows where its words ended last.
Appending word i recolours the whole path to i; before that the path falls into
segments of one last end e each, and a segment whose longest word has h words
tells that these ended at e and end at i. Where i - e <= h they overlap or touch:
a square of period i - e. It is extended to both sides as far as words i - e apart
are equal. Paths are kept as the preferred paths of a link-cut forest, so a
segment is one step, whatever its length; the number of segments over a text of n
words is O(n log n). The states of a whole stretch are made first and its prefixes
accessed in order after that, which visits the same segments.

The automaton is built only over stretches that may hold a run: a run of period q
repeats every one of its words, and every GRAM consecutive ones, at most q words
later, so long stretches of near repeats are needed. They are found by sorting
word numbers, for all texts of a slice at once and for periods up to each power of
two; no run is lost, as the runs themselves are extended on the whole text.

A run found at a segment with h >= (TIMES - 1) * q has the smallest period q: with
a smaller one, the same words would have ended later than q words before.

Memory within a task follows the longest text; texts are taken a slice at a time.

Defined cases: a null or empty text, or one of white space, has no words and no
runs; of runs of equal length the one that starts first counts, then the one with
the smallest period; repeated rows are judged each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fathom.llm.arrow import mapped, type_of, utf8

LEAST = 6
TIMES = 4
# Consecutive words that are looked up together where periods are longer.
GRAM = 4
# Distinct words whose hashes a task remembers.
VOCABULARY = 1 << 18
RUN = "struct<start:long,length:long,period:long>"


def least_length(period: int) -> int:
    return max(LEAST, TIMES * period)


class WordNumbers(dict):
    """Word to a 63-bit number, remembered for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return value


def _back(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How far before each place its value stands in the same text; a very large
    number where it does not."""
    order = np.lexsort((np.arange(len(values)), values, text))
    same = (values[order][1:] == values[order][:-1]) & (text[order][1:] == text[order][:-1])
    back = np.full(len(values), np.iinfo(np.int64).max)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    return back


def stretches(words: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """Places (from, to) outside of which no run lies; each within one text."""
    counts = np.diff(starts)
    text = np.repeat(np.arange(len(counts)), counts)
    longest = int(counts.max(initial=0))
    single = _back(words, text)
    several = None
    found = []
    exponent = 0
    while True:
        most = 1 << exponent
        smallest = most // 2 + 1
        need = least_length(smallest) - smallest
        if need + smallest > longest:
            break
        # Short periods by single words, longer ones by grams, of which fewer repeat.
        width = 1 if need < 4 * GRAM else GRAM
        if width > 1 and several is None:
            several = _back(_grams(words), text[: max(len(words) - GRAM + 1, 0)])
        back = single if width == 1 else several
        near = np.concatenate([[False], back <= most, [False]])
        edges = np.flatnonzero(near[1:] != near[:-1])
        first, end = edges[::2], edges[1::2]
        long = end - first >= need - (width - 1)
        first, end = first[long], end[long] + width - 1
        # Stretches that go over from one text to the next are of both.
        first = np.maximum(first - most, starts[text[first]]) if len(first) else first
        found += zip(first.tolist(), end.tolist())
        exponent += 1
    return _cut(sorted(found), starts)


def _grams(words: np.ndarray) -> np.ndarray:
    n = max(len(words) - GRAM + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(GRAM):
        out = (out ^ words[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _cut(found: list[tuple[int, int]], starts: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping stretches made one, and those over several texts cut at their ends."""
    whole: list[list[int]] = []
    for first, end in found:
        if whole and first <= whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], end)
        else:
            whole.append([first, end])
    out = []
    for first, end in whole:
        inner = starts[np.searchsorted(starts, first, "right") : np.searchsorted(starts, end, "left")].tolist()
        out += zip([first, *inner], [*inner, end])
    return out


class Automaton:
    """Suffix automaton of a sequence: length and suffix link of each state, and the
    state of each prefix."""

    def __init__(self, values: Iterable[int]):
        self.length, self.link = [0], [-1]
        nexts: list[dict[int, int]] = [{}]
        self.prefix = []
        length, link = self.length, self.link
        last = 0
        for value in values:
            state = len(length)
            length.append(length[last] + 1)
            link.append(0)
            nexts.append({})
            p = last
            while p >= 0 and value not in nexts[p]:
                nexts[p][value] = state
                p = link[p]
            if p >= 0:
                q = nexts[p][value]
                if length[q] == length[p] + 1:
                    link[state] = q
                else:
                    clone = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    nexts.append(nexts[q].copy())
                    link[q] = link[state] = clone
                    while p >= 0 and nexts[p].get(value) == q:
                        nexts[p][value] = clone
                        p = link[p]
            self.prefix.append(state)
            last = state


class Paths:
    """Link-cut forest over the suffix links. Each preferred path is a splay tree by
    depth whose states have one last end; access makes the path to the root
    preferred and recolours it."""

    def __init__(self, link: list[int]):
        n = len(link)
        # The parent in a splay tree, or the state above the path's top.
        self.above = list(link)
        self.left, self.right = [-1] * n, [-1] * n
        # The last end of a path, held by the root of its splay tree.
        self.end = [-1] * n

    def _rotate(self, x: int) -> None:
        above, left, right = self.above, self.left, self.right
        p = above[x]
        g = above[p]
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner >= 0:
            above[inner] = p
        above[p], above[x] = x, g

    def _splay(self, x: int) -> None:
        above, left, right = self.above, self.left, self.right
        moved = False
        while True:
            p = above[x]
            if p < 0 or (left[p] != x and right[p] != x):
                break
            if not moved:
                top = p
                while (g := above[top]) >= 0 and (left[g] == top or right[g] == top):
                    top = g
                self.end[x] = self.end[top]
                moved = True
            g = above[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)

    def access(self, x: int, end: int) -> list[tuple[int, int]]:
        """(state, last end) of the deepest state of each segment on the path from x
        to the root, deepest first; all of the path ends at `end` from now on."""
        segments = []
        above, right, last = self.above, self.right, self.end
        below, at = -1, x
        while at >= 0:
            self._splay(at)
            segments.append((at, last[at]))
            cut = right[at]
            if cut >= 0:
                # What lies deeper is a path of its own, and keeps its end.
                last[cut] = last[at]
            right[at] = below
            below, at = at, above[at]
        last[below] = end
        self._splay(x)
        last[x] = end
        return segments


def runs_of(words: np.ndarray, stretch: tuple[int, int], bounds: tuple[int, int]) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text, whose places are `bounds`, that
    a stretch of it holds."""
    first, stop = stretch
    values = words[first:stop].tolist()
    automaton = Automaton(values)
    paths, length = Paths(automaton.link), automaton.length
    begin, end = bounds
    found: dict[int, int] = {}  # where the latest run of a period ends
    runs = set()
    for i, state in enumerate(automaton.prefix):
        for deepest, last in paths.access(state, i):
            period, held = i - last, length[deepest]
            if last < 0 or held + period < LEAST or held < (TIMES - 1) * period or found.get(period, -1) > first + i:
                continue
            lo, hi = first + i - period - held + 1, first + i + 1
            lo, hi = _extended(words, lo, hi, period, begin, end)
            found[period] = hi
            if hi - lo >= least_length(period):
                runs.add((lo - begin, hi - lo, period))
    return runs


def _extended(words: np.ndarray, lo: int, hi: int, period: int, begin: int, end: int) -> tuple[int, int]:
    """The longest stretch around [lo, hi) in which words a period apart are equal."""
    step = 64
    while lo > begin:
        n = min(step, lo - begin)
        same = words[lo - n : lo] == words[lo - n + period : lo + period]
        equal = n if same.all() else int(np.argmin(same[::-1]))
        lo -= equal
        if equal < n:
            break
        step *= 2
    step = 64
    while hi < end:
        n = min(step, end - hi)
        same = words[hi : hi + n] == words[hi - period : hi - period + n]
        equal = n if same.all() else int(np.argmin(same))
        hi += equal
        if equal < n:
            break
        step *= 2
    return lo, hi


def dropped(runs: Iterable[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    out = np.zeros(n, bool)
    for start, length, period in runs:
        out[start + period : start + length] = True
    return out


def found(docs: DataFrame, key: str = "doc_id", text: str = "text", source: Column | None = None) -> DataFrame:
    """(key, n_words, runs by start, then period, collapsed): the text's words, or
    those that the struct (start, cycles) in `source` makes of them where it is not
    null, with its runs, and the words that no run repeats, joined by one space."""
    numbers = WordNumbers()

    def body(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.split() for t in part.column("body").to_pylist()]
        picks = part.column("pick").to_pylist()
        texts = [_picked(words, pick) for words, pick in zip(texts, picks)]
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64, int(starts[-1]))
        per_text: dict[int, set[tuple[int, int, int]]] = {}
        for stretch in stretches(flat, starts):
            at = int(np.searchsorted(starts, stretch[0], "right")) - 1
            bounds = (int(starts[at]), int(starts[at + 1]))
            per_text.setdefault(at, set()).update(runs_of(flat, stretch, bounds))
        listed = [sorted(per_text.get(n, ()), key=lambda r: (r[0], r[2])) for n in range(len(texts))]
        kept = []
        for words, runs in zip(texts, listed):
            if runs:
                gone = dropped(runs, len(words)).tolist()
                words = [w for w, g in zip(words, gone) if not g]
            kept.append(b" ".join(words))
        fields = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        return pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in listed], pa.list_(fields)),
                pa.array(kept, pa.binary()),
            ],
            ["key", "n_words", "runs", "collapsed"],
        )

    pick = F.lit(None).cast("struct<start:long,cycles:long>") if source is None else source
    rows = docs.select(F.col(key).alias("key"), utf8(text).alias("body"), pick.alias("pick"))
    schema = f"key {type_of(docs, key)}, n_words long, runs array<{RUN}>, collapsed binary"
    done = mapped(rows, "body", body, schema)
    return done.select(F.col("key").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def _picked(words: list[bytes], pick: dict | None) -> list[bytes]:
    """The words, from a place on replaced by their first ones in turn: `start` is
    taken modulo the number of words, the period follows from `cycles`."""
    if pick is None or not words:
        return words
    n = len(words)
    start = pick["start"] % n
    period = 1 + (n - start) // pick["cycles"]
    cycle = words[start : start + period]
    times = -(-(n - start) // period)
    return words[:start] + (cycle * times)[: n - start]


def longest(runs: Column) -> Column:
    """The run of greatest length, of these the first, then that of the smallest
    period; null if there is none."""
    order = F.transform(
        runs, lambda r: F.struct((-r["length"]).alias("order"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))
    )
    return F.array_min(order)
