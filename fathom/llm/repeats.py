"""Removal of repeated byte strings, by longest previous factors.

Texts are byte strings; every byte goes that lies in a string of WIDTH bytes
which also starts earlier, in a document with a smaller key or earlier in the
same one. The first copy stays. Strings are judged on the input.

Each window of WIDTH bytes names one of its GRAM-byte grams, the one with the
least hash (the leftmost of equal ones), so equal windows name equal grams at
equal places. Consecutive windows that name the same gram form a run; a run is
known by its gram and by a digest of all its bytes. A corpus has about 3 runs
for 100 bytes, and most have a gram of their own:

1. Tasks pack the hashes of their grams, sorted, as differences; these few bytes
   a run meet by range of the hash, and what is there twice sets a bit.
2. Runs are read again, now only those whose gram has its bit. Runs with one gram
   and one digest are equal: all but the earliest are repeats. Tasks settle that
   for the runs they hold before anything is exchanged.
3. Where a gram has runs with several digests, as at the ends of a repeated
   passage or around an edit, the earliest run of each is compared with the
   others, window by window: the runs of a gram meet in one task, their suffixes
   are sorted, and the longest-previous-factor array, from the previous and the
   next smaller position in suffix order, tells which windows occur earlier.
4. Grams with more than HOT runs do not meet in one task: their windows are
   grouped by 128-bit digests, again settled within tasks first.

The bits are in bitmaps of fixed size; a chance hit only sends on a run that turns
out not to be repeated. Texts are read several times, so that nothing but rows
that may be repeats, and the texts themselves once, is exchanged or stored.

Defined cases: a null or empty text has no bytes; a text shorter than WIDTH loses
none; rows with one key count as one document, and what goes in one goes at the
same place in each; a null key is smaller than any other; an empty table gives no
rows; long texts are read in overlapping segments; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fathom.llm.arrow import bytes_of, type_of, utf8
from fathom.llm.minhash import mixed
from fathom.session import settled

WIDTH = 100
GRAM = 32
HOT = 2000
BITMAP_BITS = 27
# Bytes that a task works on at once; a text is cut into segments of that size.
SEGMENT = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Rolling:
    """Hashes of any byte range of an array, by differences of a running sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.back = _powers(_INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n + 1)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs_of(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of the segments data[bounds[i]:bounds[i + 1]]: segment, start and number
    of windows, gram, digest, and the rolling hashes they come from."""
    empty = np.zeros(0, np.int64)
    if len(data) < WIDTH:
        return {"segment": empty, "start": empty, "n": empty, "gram": empty, "digest": empty, "rolling": None}
    rolling = Rolling(data)
    grams = mixed(rolling.of(slice(None, len(data) - GRAM + 1), slice(GRAM, None)))
    low = np.uint64((1 << 24) - 1)
    ranked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    named = (_window_least(ranked, WIDTH - GRAM + 1) & low).astype(np.int64)
    # Windows inside one segment.
    inside = np.zeros(len(named) + 1, np.int8)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= WIDTH:
            inside[a : b - WIDTH + 1] = 1
    inside[-1] = 0
    changed = np.ones(len(named) + 1, bool)
    changed[1:-1] = named[1:] != named[:-1]
    before = np.concatenate([[0], inside[:-1]])
    start = np.flatnonzero((inside == 1) & (changed | (before == 0)))
    end = np.flatnonzero((before == 1) & (changed | (inside == 0)))
    at = named[start]
    shape = ((end - start) * WIDTH + (at - start)).astype(np.uint64)
    digest = mixed(rolling.of(start, end + WIDTH - 1) ^ mixed(shape))
    return {
        "segment": np.searchsorted(bounds, start, "right") - 1,
        "start": start,
        "n": end - start,
        "gram": grams[at].astype(np.int64),
        "digest": digest.astype(np.int64),
        "rolling": rolling,
    }


def _segments(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch of texts, of about SEGMENT bytes: (bytes, bounds of the
    segments in them, their rows, their offsets in the texts)."""
    rows, offsets, parts, size = [], [], [], 0
    for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        for first in range(a, b, SEGMENT):
            # Windows that start here may end in the next segment.
            part = data[first : min(first + SEGMENT + WIDTH - 1, b)]
            if first > a and len(part) < WIDTH:
                continue
            rows.append(row)
            offsets.append(first - a)
            parts.append(part)
            size += len(part)
            if size >= SEGMENT:
                yield _packed(parts, rows, offsets)
                rows, offsets, parts, size = [], [], [], 0
    if parts:
        yield _packed(parts, rows, offsets)


def _packed(parts, rows, offsets):
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return np.concatenate(parts), bounds, np.array(rows), np.array(offsets)


def _order(keys: pa.Array, rows: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each row's key, nulls first, and the start: what is earlier."""
    valid = np.array(keys.is_valid())
    ranks = np.zeros(len(keys), np.int64)
    if valid.any():
        ranks[valid] = 1 + np.unique(keys.drop_null().to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return ranks[rows], start


def _later(groups: tuple[np.ndarray, ...], order: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an earlier one with equal `groups`; which are the first."""
    by = np.lexsort((order[1], order[0], *reversed(groups)))
    new = np.ones(len(by), bool)
    if len(by) > 1:
        new[1:] = np.logical_or.reduce([g[by][1:] != g[by][:-1] for g in groups])
    head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    later, first = np.zeros(len(by), bool), np.zeros(len(by), bool)
    later[by] = (order[0][by] > order[0][head]) | (order[1][by] > order[1][head])
    first[by[new]] = True
    return later, first


def _batch_runs(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """All runs of a batch of texts: row, start in the text, n, gram, digest."""
    data, at = bytes_of(batch.column(1))
    got = []
    for part, bounds, rows, offsets in _segments(data, at):
        found = runs_of(part, bounds)
        segment = found["segment"]
        start = found["start"] - bounds[segment] + offsets[segment]
        got.append((rows[segment], start, found["n"], found["gram"], found["digest"]))
    parts = zip(*got) if got else [[np.zeros(0, np.int64)]] * 5
    return dict(zip(("row", "start", "n", "gram", "digest"), map(np.concatenate, parts)))


def _spread(gram: np.ndarray) -> np.ndarray:
    """Another hash of a gram's hash: the least of many hashes are small numbers,
    so they do not spread over ranges by themselves."""
    return mixed(np.ascontiguousarray(gram).view(np.uint64) ^ np.uint64(0xA0761D6478BD642F))


def _slots(gram: np.ndarray) -> np.ndarray:
    return (_spread(gram) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _in_bitmap(bitmap: np.ndarray, gram: np.ndarray) -> np.ndarray:
    slot = _slots(gram)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


_PIECE_BITS = 15  # bits of a bitmap in one row


def _pieces(slots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The parts of a bitmap that hold the slots."""
    piece = slots >> _PIECE_BITS
    for number in np.unique(piece).tolist():
        bits = np.zeros(1 << _PIECE_BITS, np.uint8)
        bits[slots[piece == number] & ((1 << _PIECE_BITS) - 1)] = 1
        packed = np.packbits(bits, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([packed], pa.binary())], ["piece", "bits"])


def _collected(pieces: DataFrame) -> np.ndarray:
    """A bitmap of fixed size from its pieces."""
    out = np.zeros((1 << (BITMAP_BITS - _PIECE_BITS), 1 << (_PIECE_BITS - 3)), np.uint8)
    for row in pieces.collect():
        out[row["piece"]] |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return out.ravel()


def _part_bits(spark) -> int:
    """Ranges of hashes, a power of two: about one for each shuffle partition."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(max(wanted - 1, 1).bit_length(), BITMAP_BITS - _PIECE_BITS)


# Bits of a gram's hash that are compared.
_COMPARED = 48


def repeated_grams(texts: DataFrame) -> np.ndarray:
    """Bitmap of the grams with several runs."""
    bits = _part_bits(texts.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.sort(_spread(_batch_runs(batch)["gram"]))
            # A gram is sent twice if the task has it more often.
            few = np.ones(len(values), bool)
            few[2:] = values[2:] != values[:-2]
            values = values[few]
            values >>= np.uint64(64 - _COMPARED)
            part = (values >> np.uint64(_COMPARED - bits)).astype(np.int64)
            numbers, first = np.unique(part, return_index=True)
            blobs = []
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(values)]):
                steps = np.diff(values[lo:hi], prepend=np.uint64(0))
                # The bytes of all differences by significance: the high ones are zero.
                planes = steps.view(np.uint8).reshape(-1, 8).T.copy()
                blobs.append(zlib.compress(planes.tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(blobs, pa.binary())], ["part", "grams"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part not in held:
                    yield from settle(held)
                    held = {part: []}
                planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1)
                held[part].append(np.cumsum(planes.T.copy().view(np.uint64).ravel(), dtype=np.uint64))
        yield from settle(held)

    def settle(held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for parts in held.values():
            values = np.sort(np.concatenate(parts))
            twice = values[1:][values[1:] == values[:-1]]
            yield from _pieces((twice >> np.uint64(_COMPARED - BITMAP_BITS)).astype(np.int64))

    packed = texts.mapInArrow(pack, "part long, grams binary")
    return _collected(packed.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "piece long, bits binary"))


def _bitmap(grams: DataFrame) -> np.ndarray:
    """Bitmap of the rows' grams."""
    bits = _part_bits(grams.sparkSession)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slots(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(slot >> (BITMAP_BITS - bits)), pa.array(slot)], ["part", "slot"])

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = [batch.column(1).to_numpy() for batch in batches if batch.num_rows]
        if slots:
            yield from _pieces(np.unique(np.concatenate(slots)))

    placed = grams.select("gram").mapInArrow(place, "part long, slot long").repartition("part")
    return _collected(placed.mapInArrow(body, "piece long, bits binary"))


def _joined_runs(row: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows, in order of row and start, with those that follow each
    other, or whose windows overlap, made one."""
    if not len(row):
        return row, start, n
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], (start + n)[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > end[:-1])
    first = np.flatnonzero(new)
    return row[first], start[first], np.maximum.reduceat(end, first) - start[first]


def runs(texts: DataFrame, bitmap) -> DataFrame:
    """(gram, digest, key, start, n) of the runs of (key, body) whose gram is in the
    bitmap. Where the task has seen an equal and earlier run, gram and digest are
    null: a repeat."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _batch_runs(batch)
            later, first = _later(
                (found["gram"], found["digest"]), _order(batch.column(0), found["row"], found["start"])
            )
            row, start, n = _joined_runs(*(found[name][later] for name in ("row", "start", "n")))
            open_ = first & _in_bitmap(bitmap.value, found["gram"])
            nothing = np.zeros(len(row), np.int64)
            shut = np.ones(len(row), bool)
            for gram, digest, row, start, n, mask in (
                (nothing, nothing, row, start, n, shut),
                *([found[name][open_] for name in ("gram", "digest", "row", "start", "n")] + [None],),
            ):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram, mask=mask),
                        pa.array(digest, mask=mask),
                        batch.column(0).take(pa.array(row)),
                        pa.array(start),
                        pa.array(n.astype(np.int32)),
                    ],
                    ["gram", "digest", "key", "start", "n"],
                )

    schema = f"gram long, digest long, key {type_of(texts, 'key')}, start long, n int"
    return texts.mapInArrow(body, schema)


def contested(texts: DataFrame, several, hot) -> DataFrame:
    """For the runs whose gram has several digests: (gram, key, start, n, bytes); if
    the gram is hot, each window as (a, b, key, start) with its digest instead.
    Equal ones in a task are sent once, as the earliest of them."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _batch_runs(batch)
            chosen = np.flatnonzero(_in_bitmap(several.value, found["gram"]))
            found = {name: values[chosen] for name, values in found.items()}
            order = _order(batch.column(0), found["row"], found["start"])
            first = _later((found["gram"], found["digest"]), order)[1]
            data, at = bytes_of(batch.column(1))
            many = _in_bitmap(hot.value, found["gram"])
            few = np.flatnonzero(first & ~many)
            row, start, n = (found[name][few] for name in ("row", "start", "n"))
            lo = at[row] + start
            content = [data[a:b].tobytes() for a, b in zip(lo.tolist(), (lo + n + WIDTH - 1).tolist())]
            yield _rows(batch, row, start, gram=found["gram"][few], n=n, content=content)
            many = np.flatnonzero(first & many)
            for lo in range(0, len(many), 10_000):
                yield from _windows(batch, data, at, {k: v[many[lo : lo + 10_000]] for k, v in found.items()})

    kind = type_of(texts, "key")
    return texts.mapInArrow(body, f"key {kind}, start long, gram long, n int, content binary, a long, b long")


def _windows(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray, found: dict) -> Iterator[pa.RecordBatch]:
    """Every window of some runs, by a 128-bit digest; those with an earlier one
    among them without it: repeats."""
    n = found["n"]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row, start = np.repeat(found["row"], n), np.repeat(found["start"], n) + step
    views = np.lib.stride_tricks.sliding_window_view(data, WIDTH)
    digests = b"".join(xxhash.xxh3_128_digest(views[p].tobytes()) for p in (at[row] + start).tolist())
    pair = np.frombuffer(digests, np.int64).reshape(-1, 2)
    later, first = (np.flatnonzero(m) for m in _later((pair[:, 0], pair[:, 1]), _order(batch.column(0), row, start)))
    yield _rows(batch, row[first], start[first], a=pair[first, 0], b=pair[first, 1])
    row, start, n = _joined_runs(row[later], start[later], np.ones(len(later), np.int64))
    yield _rows(batch, row, start, n=n)


def _rows(batch, rows, start, gram=None, n=None, content=None, a=None, b=None) -> pa.RecordBatch:
    def long(values, kind=pa.int64()):
        return pa.nulls(len(rows), kind) if values is None else pa.array(values.astype(kind.to_pandas_dtype()))

    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(pa.array(rows, pa.int64())),
            pa.array(start.astype(np.int64)),
            long(gram),
            long(n, pa.int32()),
            pa.nulls(len(rows), pa.binary()) if content is None else pa.array(content, pa.binary()),
            long(a),
            long(b),
        ],
        ["key", "start", "gram", "n", "content", "a", "b"],
    )


def previous_factors(data: np.ndarray, starts: np.ndarray, position: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Longest previous factor, up to `width`, of the suffixes at `starts`: the
    longest prefix that a suffix with a smaller position has too. Each suffix has
    `width` bytes."""
    offsets = [*range(0, width - 8, 8), width - 8]
    octets = np.lib.stride_tricks.sliding_window_view(data, 8)
    words = [octets[starts + o].view(">u8").ravel().astype(np.uint64) for o in offsets]
    order = np.lexsort((position, *reversed(words)))
    pos = position[order]

    # Common prefixes of neighbours: whole words, then the bytes of the next one.
    common = np.zeros(len(order), np.int64)
    open_ = np.ones(max(len(order) - 1, 0), bool)
    for o, word in zip(offsets, words):
        differing = word[order][1:] ^ word[order][:-1]
        same = differing == 0
        # Leading zero bytes of the difference.
        bytes_ = (differing[:, None] >> np.arange(56, -8, -8, dtype=np.uint64)) != 0
        common[1:][open_] = o + np.where(same, 8, np.argmax(bytes_, axis=1))[open_]
        open_ &= same

    def nearest(pos: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Common prefix with the nearest entry before that has a smaller position."""
        before = np.arange(len(pos)) - 1
        shared = common.copy()
        while True:
            open_ = np.flatnonzero((before >= 0) & (pos[before] >= pos))
            if not len(open_):
                return np.where(before >= 0, shared, 0)
            shared[open_] = np.minimum(shared[open_], shared[before[open_]])
            before[open_] = before[before[open_]]

    previous = nearest(pos, common)
    following = nearest(pos[::-1], np.concatenate([[0], common[:0:-1]]))[::-1]
    out = np.empty(len(starts), np.int64)
    out[order] = np.maximum(previous, following)
    return out


def _compared(rows: DataFrame) -> DataFrame:
    """Windows that occur earlier, of runs sorted by gram: (key, start, n)."""

    def group(table: pa.Table) -> pa.RecordBatch:
        batch = table.combine_chunks().to_batches()[0]
        data, at = bytes_of(batch.column(4))
        n = batch.column(3).to_numpy().astype(np.int64)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row = np.repeat(np.arange(len(n)), n)
        start = batch.column(1).to_numpy()[row] + step
        by_key, by_start = _order(batch.column(0), row, start)
        position = np.unique(by_key * (int(by_start.max()) + 1) + by_start, return_inverse=True)[1]
        found = np.flatnonzero(previous_factors(data, at[:-1][row] + step, position) >= WIDTH)
        row, start, n = _joined_runs(row[found], start[found], np.ones(len(found), np.int64))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(n.astype(np.int32))], ["key", "start", "n"]
        )

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            # All but the last gram are whole.
            gram = batch.column(2).to_numpy()
            cut = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if gram[0] != gram[-1] else 0
            if cut:
                yield group(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            elif len(held) > 1 and held[-2].column(2)[-1].as_py() != int(gram[0]):
                yield group(pa.Table.from_batches(held[:-1]))
                held = [batch]
        if held:
            yield group(pa.Table.from_batches(held))

    return rows.mapInArrow(body, f"key {type_of(rows, 'key')}, start long, n int")


def _not_first(rows: DataFrame, *groups: str) -> DataFrame:
    """Rows with an earlier row of equal groups: (key, start, n)."""
    place = F.struct("key", "start")
    firsts = rows.groupBy(*groups).agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    both = rows.join(settled(firsts.drop("copies"), "firsts"), list(groups))
    return both.where(~place.eqNullSafe(F.col("first"))).select("key", "start", "n")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, n): the windows that occur earlier, as starts of n windows."""
    share = docs.sparkSession.sparkContext.broadcast
    texts = docs.select(F.col(key).alias("key"), utf8(text).alias("body"))
    found = settled(runs(texts, share(repeated_grams(texts))), "runs")
    again = found.where(F.col("gram").isNotNull())
    grams = again.groupBy("gram").agg(
        F.count("*").alias("runs"), (F.min("digest") != F.max("digest")).alias("several")
    )
    grams = settled(grams.where("several").select("gram", "runs"), "grams")
    several, hot = share(_bitmap(grams)), share(_bitmap(grams.where(F.col("runs") > HOT)))
    unclear = settled(contested(texts, several, hot), "contested")
    windows = unclear.where(F.col("a").isNotNull()).select("a", "b", "key", "start", F.lit(1).alias("n"))
    few = unclear.where(F.col("gram").isNotNull()).select("key", "start", "gram", "n", "content")
    parts = [
        found.where(F.col("gram").isNull()).select("key", "start", "n"),
        _not_first(again, "gram", "digest"),
        _compared(few.repartition("gram").sortWithinPartitions("gram")),
        _not_first(windows, "a", "b"),
        unclear.where("gram is null and a is null").select("key", "start", "n"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, removed, kept): the text without what is repeated, as bytes,
    and the removed byte ranges."""
    span = F.struct("start", (F.col("start") + F.col("n") + WIDTH - 1).alias("end"))
    spans = repeated(docs, key, text).groupBy("key").agg(F.collect_list(span).alias("spans"))
    spans = settled(spans, "removed").withColumnRenamed("key", "_key")
    texts = docs.select(F.col(key).alias("key"), utf8(text).alias("body"))
    joined = texts.join(spans, texts["key"].eqNullSafe(spans["_key"]), "left").select("key", "body", "spans")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                sizes, removed, rest = [], [], []
                for value, found in zip(part.column(1).to_pylist(), part.column(2)):
                    ranges, left = cut(value, found)
                    sizes.append(len(value))
                    removed.append(ranges)
                    rest.append(left)
                pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pair), pa.array(rest, pa.binary())],
                    ["key", "n_bytes", "removed", "kept"],
                )

    kind = type_of(docs, key)
    done = joined.mapInArrow(body, f"key {kind}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
    return done.withColumnRenamed("key", key)


def cut(value: bytes, found: pa.ListScalar) -> tuple[list[dict[str, int]], bytes]:
    """Maximal covered ranges, and the bytes outside them."""
    if not found.is_valid:
        return [], value
    pairs = found.values
    depth = np.zeros(len(value) + 1, np.int64)
    np.add.at(depth, np.minimum(pairs.field(0).to_numpy(), len(value)), 1)
    np.add.at(depth, np.minimum(pairs.field(1).to_numpy(), len(value)), -1)
    gone = np.cumsum(depth[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    ranges = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]
    return ranges, np.frombuffer(value, np.uint8)[~gone].tobytes()
