"""Near-duplicate classes by an inverted join over MinHash signature coordinates.

Each distinct shingle set has a signature of COORDINATES minima. Every
(coordinate, value) pair is a token; two sets of Jaccard similarity s share a
binomial number of tokens with mean s * COORDINATES. Sets are candidates if they
share at least `match_threshold` tokens, which misses a link at the similarity
threshold with a probability below one in a million; candidates are confirmed on
the full sets.

Prefix: tokens are ordered rarest first, by a count sketch of fixed size; two
sets that share the threshold number of tokens share one of the first
COORDINATES - threshold + 1, so only those are posted. Skip: the frequent tokens
that are not posted are never merged; they are only compared, signature against
signature, for pairs that met in a posting.

Posting lists are not expanded into all pairs. Equal sets are one node. A list is
joined to a hub, its smallest node; links found are closed to components; then
only nodes outside the largest component of their list are compared further: with
all the list if they are few. Where they are many, as in a large family of edited
copies, the list's nodes are posted once more, now under the rarest shingles of
their full sets, and nodes of different components are compared where they meet,
block against block inside tasks.
Nodes of one component need no comparison, so no link between components is lost.

Defined cases: a null or empty text, or one of white space, has an empty set, is
linked with nothing and is its own component; a text with fewer words than a
shingle is one shingle; rows with one id are one node; a row without id is
linked with nothing and gets a null component; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fathom.llm.arrow import mapped, small_batches, type_of, utf8
from fathom.llm.components import SENT_ROWS, components
from fathom.operators.joins import Side, checked
from fathom.session import settled

SHINGLE = 5
SIMILARITY = 80  # hundredths
COORDINATES = 128
# Standard deviations below the mean number of shared tokens that still match.
MARGIN = 5.2
SKETCH_BITS = 20
# Distinct words whose hashes a task remembers.
VOCABULARY = 1 << 18
# A list with at most so many nodes outside its largest component is finished by
# comparing those with the whole list; the nodes of others meet over full sets,
# where lists with more than SEVERAL such nodes are compared block by block.
FEW = 8
SEVERAL = 32
# Largest block of nodes that meets another inside a task, and how many values
# are compared at a time.
BLOCK_ROWS = 256
BLOCK_BYTES = 1 << 18
STRETCH = 4096

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def match_threshold(coordinates: int, similarity: int) -> int:
    s = similarity / 100
    return max(1, int(coordinates * s - MARGIN * sqrt(coordinates * s * (1 - s))))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word to 64-bit hash, remembered for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_sets(texts: list[bytes], hashes: WordHashes, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = [text.lower().split() for text in texts]
    counts = np.array([len(w) for w in words], np.int64)
    total = int(counts.sum())
    ids = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, total)
    factors = mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    rolled = np.zeros(max(total - width + 1, 0), np.uint64)
    for i in range(width):
        rolled += ids[i : i + len(rolled)] * factors[i]
    rolled = mixed(rolled)
    ends = np.cumsum(counts)
    sets = []
    for n, end in zip(counts.tolist(), ends.tolist()):
        if n >= width:
            sets.append(np.unique(rolled[end - n : end - width + 1]))
        elif n:
            short = (ids[end - n : end] * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)
            sets.append(mixed(np.array([short], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """One row of minima per non-empty set."""
    full = [s for s in sets if len(s)]
    if not full:
        return np.zeros((0, coordinates), np.uint32)
    values = np.concatenate(full)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in full])[:-1]])
    seeds = mixed(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    out = np.empty((len(full), coordinates), np.uint32)
    for k in range(coordinates):
        permuted = ((values ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1))) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(permuted, starts)
    return out


def profiles(docs: DataFrame, key: str, text: str, width: int, coordinates: int) -> DataFrame:
    """Per row: key, n_shingles, set_key (128-bit digest of the set), signature, and
    brief, the last byte of each value of the signature."""
    hashes = WordHashes()

    def body(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(part.column("body").to_pylist(), hashes, width)
        matrix = signatures(sets, coordinates)
        rows, brief = iter(matrix), iter(matrix.astype(np.uint8))
        return pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                pa.array([next(brief).tobytes() if len(s) else None for s in sets], pa.binary()),
            ],
            ["key", "n_shingles", "set_key", "signature", "brief"],
        )

    rows = docs.select(F.col(key).alias("key"), utf8(text).alias("body"))
    schema = f"key {type_of(docs, key)}, n_shingles long, set_key binary, signature binary, brief binary"
    return mapped(rows, "body", body, schema)


def _matrix(column: pa.Array, dtype: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _tokens(matrix: np.ndarray) -> np.ndarray:
    """(coordinate, value) pairs as one number each."""
    return (np.arange(matrix.shape[1], dtype=np.uint64) << np.uint64(32)) | matrix


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (mixed(tokens) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


_PIECE = 1 << 12  # slots of a sketch in one row


def _sketch(tokens_of: Callable[[pa.Array], np.ndarray], rows: DataFrame) -> np.ndarray:
    """Counts of the tokens in the one column of `rows`, in 2 ** SKETCH_BITS slots
    whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                slots = _slots(tokens_of(batch.column(0).slice(first, 1000)))
                counts += np.bincount(slots, minlength=len(counts))
        # In pieces, so that they can be added up in several tasks.
        pieces = counts.reshape(-1, _PIECE)
        for number in np.flatnonzero(pieces.any(axis=1)).tolist():
            yield piece(number, pieces[number])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[number] = sums.get(number, 0) + np.frombuffer(counts, np.int64)
        for number, counts in sums.items():
            yield piece(number, counts)

    def piece(number: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([counts.tobytes()], pa.binary())], ["piece", "counts"]
        )

    schema = "piece long, counts binary"
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32).reshape(-1, _PIECE)
    with small_batches(rows.sparkSession):
        for row in rows.mapInArrow(count, schema).repartition("piece").mapInArrow(add, schema).collect():
            counts = np.frombuffer(bytes(row["counts"]), np.int64)
            sketch[row["piece"]] = np.minimum(counts, 0xFFFFFFFF)
    return sketch.ravel()


def _rarity(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """One order of all tokens, rarest first."""
    count = sketch[_slots(tokens)].astype(np.uint64)
    return (count << np.uint64(32)) | (mixed(tokens) & np.uint64(0xFFFFFFFF))


def postings(nodes: DataFrame, prefix: int) -> DataFrame:
    """(token, node) for the `prefix` rarest tokens of each node's signature."""
    sketch = _sketch(lambda column: _tokens(_matrix(column)).ravel(), nodes.select("signature"))
    shared = nodes.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                tokens = _tokens(_matrix(part.column(1)))
                chosen = np.argpartition(_rarity(tokens, shared.value), prefix - 1, axis=1)[:, :prefix]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.take_along_axis(tokens, chosen, 1).ravel().astype(np.int64)),
                        part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), prefix))),
                    ],
                    ["token", "node"],
                )

    return nodes.select("node", "signature").mapInArrow(run, f"token long, node {type_of(nodes, 'node')}")


def set_postings(sets: DataFrame, similarity: int) -> DataFrame:
    """(token, node) for the rarest shingles of each full set: so many that two
    sets which are similar enough share one of them."""
    sketch = _sketch(
        lambda column: np.concatenate([unpacked(s) for s in column.to_pylist()]), sets.select("shingles")
    )
    shared = sets.sparkSession.sparkContext.broadcast(sketch)

    def body(part: pa.RecordBatch) -> pa.RecordBatch:
        chosen, sizes = [], []
        for data in part.column(1).to_pylist():
            tokens = unpacked(data)
            prefix = len(tokens) + 1 - -(-len(tokens) * similarity // 100)
            chosen.append(tokens[np.argpartition(_rarity(tokens, shared.value), prefix - 1)[:prefix]])
            sizes.append(prefix)
        rows = np.repeat(np.arange(part.num_rows), sizes)
        tokens = np.concatenate(chosen).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(tokens), part.column(0).take(pa.array(rows))], ["token", "node"])

    schema = f"token long, node {type_of(sets, 'node')}"
    return mapped(sets.select("node", "shingles"), "shingles", body, schema)


def posting_lists(posted: DataFrame) -> DataFrame:
    """(token, node, hub, n) for lists of two nodes or more; of the tokens with
    the very same list only one stays."""
    lists = (
        posted.groupBy("token")
        .agg(
            F.count("*").alias("n"),
            F.min("node").alias("hub"),
            F.max("node").alias("last"),
            F.bit_xor(F.xxhash64("node")).alias("x"),
            F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        )
        .where("n > 1")
        .groupBy("n", "hub", "last", "x", "y")
        .agg(F.min("token").alias("token"))
    )
    lists = settled(lists.select("token", "n", "hub"), "lists")
    return settled(posted.join(lists, "token"), "members")


# Bytes of a shingle's hash that a set is compared by; two shingles of a pair of
# sets share them by chance once in 2 ** 48.
_PACKED = 6


def packed(shingles: np.ndarray) -> bytes:
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - _PACKED :].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // _PACKED, 8), np.uint8)
    wide[:, 8 - _PACKED :] = np.frombuffer(data, np.uint8).reshape(-1, _PACKED)
    return wide.view("<u8").ravel()


# Bits of a bitmap of keys.
MARKS = 1 << 27


def _marks(keys: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of keys, in the one column, of a fixed size: a key that
    is not marked is not among them."""
    mark = F.pmod(F.xxhash64(keys.columns[0]), F.lit(MARKS))
    per = keys.groupBy(F.shiftright(mark, 15).alias("part")).agg(F.bitmap_construct_agg(mark.bitwiseAND(32767)).alias("bits"))
    found = np.zeros((MARKS >> 15, 4096), np.uint8)
    for row in per.collect():
        found[row["part"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return found.ravel()


def _sets(docs: DataFrame, key: str, text: str, width: int, marks: np.ndarray | None = None) -> DataFrame:
    """(node, shingles) of each row, or of those with a marked key."""
    hashes = WordHashes()
    shared = None if marks is None else docs.sparkSession.sparkContext.broadcast(marks)

    def body(part: pa.RecordBatch) -> pa.RecordBatch:
        if shared is not None:
            at = part.column("mark").to_numpy()
            part = part.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
        sets = shingle_sets(part.column("body").to_pylist(), hashes, width)
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([packed(s) for s in sets], pa.binary())], ["node", "shingles"]
        )

    mark = [] if marks is None else [F.pmod(F.xxhash64(key), F.lit(MARKS)).alias("mark")]
    rows = docs.select(F.col(key).alias("node"), utf8(text).alias("body"), *mark)
    return mapped(rows, "body", body, f"node {type_of(docs, key)}, shingles binary")


def _met_by(pairs: DataFrame, left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b), which are stored, with a column of either node, as left and right.
    What belongs to b goes to the task of a; if the pairs are few, nothing else moves."""
    left = left.select(F.col("node").alias("a"), F.col(column).alias("left"))
    right = right.select(F.col("node").alias("b"), F.col(column).alias("right"))
    return right.join(checked(pairs).side, "b").join(left, "a").select("a", "b", "left", "right")


def _side(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.select(F.col(name).alias("node"))


def _wanted(nodes: DataFrame) -> Side:
    """Nodes to look for; only many are made distinct."""
    found = checked(nodes.select("node"))
    return found if found.small else checked(found.df.distinct())


def _near(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """(a, b, shared) of pairs whose signatures share enough tokens. Of each value
    one byte is compared, so a few more pass, and none is lost."""
    kind = type_of(pairs, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                shared = (_matrix(batch.column(2), np.uint8) == _matrix(batch.column(3), np.uint8)).sum(axis=1)
                found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared)], ["a", "b", "shared"])
                yield found.filter(pa.array(shared >= threshold))

    left = nodes.join(_wanted(_side(pairs, "a")).side, "node", "left_semi")
    return _met_by(pairs, left, nodes, "brief").mapInArrow(run, f"a {kind}, b {kind}, shared long")


def _confirmed(pairs: DataFrame, docs: DataFrame, how: dict) -> DataFrame:
    """Pairs whose full sets, made on the way, are similar enough."""
    kind, similarity = type_of(pairs, "a"), how["similarity"]
    left, right = (_sets_of(_side(pairs, name), docs, how) for name in ("a", "b"))

    def body(part: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for left, right in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
            x, y = unpacked(left), unpacked(right)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= similarity * (len(x) + len(y) - common))
        return part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return mapped(_met_by(pairs, left, right, "shingles"), "left", body, f"a {kind}, b {kind}").distinct()


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (token, node, root) of the lists whose nodes are in several
    components, with the largest one (main) and the number of nodes outside it
    (rest)."""
    rooted = members.select("token", "node").join(checked(roots, SENT_ROWS).side, "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    per_root = rooted.groupBy("token", "root").agg(F.count("*").alias("n"))
    lists = per_root.groupBy("token").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("parts")
    )
    lists = lists.where("parts > 1").select(
        "token", F.col("top.root").alias("main"), (F.col("n") - F.col("top.n")).alias("rest")
    )
    return settled(rooted.join(settled(lists, "apart"), "token"), "apart")


def _across(members: DataFrame) -> DataFrame:
    """Pairs of members of one list in different components: those outside the
    largest component with all others."""
    rest = members.where("root <> main").select(
        "token", F.col("node").alias("x"), F.col("root").alias("x_root"), "main"
    )
    others = members.select("token", F.col("node").alias("y"), F.col("root").alias("y_root"))
    met = rest.join(others, "token").where("x_root <> y_root and (y_root = main or x < y)")
    return met.select(*_ordered("x", "y"))


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _joined(roots: DataFrame, found: DataFrame) -> DataFrame:
    """Components after some more links: a node hangs on its root by one edge."""
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(known.unionByName(found.select("a", "b")))


def _sets_of(nodes: DataFrame, docs: DataFrame, how: dict) -> DataFrame:
    """Full sets of some nodes, read from their texts again. No text is exchanged: many
    nodes are sent as a bitmap, and of the sets that pass it those are kept."""
    wanted, key = _wanted(nodes), how["key"]
    rows, kinds = docs.select(key, how["text"]), (key, how["text"], how["width"])
    if wanted.small:
        return _sets(rows.join(F.broadcast(wanted.df.withColumnRenamed("node", key)), key, "left_semi"), *kinds)
    return _sets(rows, *kinds, _marks(wanted.df)).join(wanted.df, "node", "left_semi")


def _linked(pairs: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, how: dict) -> DataFrame:
    """Roots after the links among some pairs. For each node the pair that shares
    most is confirmed first; most others then lie inside one component, and only
    those that do not are confirmed as well."""
    near = settled(_near(settled(pairs.distinct(), "pairs"), nodes, how["threshold"]), "near")
    first = near.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("top")).select("top.a", "b")
    first = settled(first, "first")
    with small_batches(docs.sparkSession):
        confirmed = settled(_confirmed(first, docs, how), "links")
    roots = _joined(roots, confirmed)
    rooted = checked(roots, SENT_ROWS)
    of = lambda name: rooted.hint(roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}")))
    apart = near.join(first, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = apart.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    apart = settled(apart, "apart")
    with small_batches(docs.sparkSession):
        confirmed = settled(_confirmed(apart, docs, how), "links")
    return _joined(roots, confirmed)


def _blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of a list in blocks of bounded size, those of the largest component
    apart from the rest: (token, rest, part, block), a block with (node, root,
    shingles) of each."""
    members = members.withColumn("outside", F.col("root") != F.col("main"))
    sized = members.join(sets.select("node", F.length("shingles").alias("bytes")), "node")
    sizes = sized.groupBy("token", "outside").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("bytes") / BLOCK_BYTES)).alias("parts")
    )
    placed = members.join(checked(settled(sizes, "sizes")).side, ["token", "outside"]).join(sets, "node")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")
    block = F.collect_list(F.struct("node", "root", "shingles")).alias("block")
    return settled(placed.groupBy("token", "outside", part).agg(block), "blocks")


def common_shingles(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each set of x shares with each of y, a stretch of the values
    that both sides hold at a time."""
    values = np.intersect1d(np.concatenate(x), np.concatenate(y))
    out = np.zeros((len(x), len(y)), np.float32)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows, flat = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(values, flat), max(len(values) - 1, 0))
        held = values[at] == flat if len(values) else np.zeros(len(flat), bool)
        order = np.argsort(at[held], kind="stable")
        return rows[held][order], at[held][order]

    sides = (places(x), places(y))
    for first in range(0, len(values), STRETCH):
        dense = []
        for (rows, at), n in zip(sides, (len(x), len(y))):
            lo, hi = np.searchsorted(at, [first, first + STRETCH])
            matrix = np.zeros((n, min(STRETCH, len(values) - first)), np.float32)
            matrix[rows[lo:hi], at[lo:hi] - first] = 1
            dense.append(matrix)
        out += dense[0] @ dense[1].T
    return out


def _linking(left: list[dict], right: list[dict], similarity: int) -> list[tuple]:
    """Links between two blocks that join components, each component once."""
    x, y = ([unpacked(m["shingles"]) for m in side] for side in (left, right))
    common = common_shingles(x, y)
    total = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])
    near = 100 * common >= similarity * (total - common)
    found, above = [], {}

    def top(root):
        while root in above:
            root = above[root]
        return root

    for i, j in zip(*(at.tolist() for at in np.nonzero(near))):
        p, q = top(left[i]["root"]), top(right[j]["root"])
        if p != q:
            above[p] = q
            found.append((left[i]["node"], right[j]["node"]))
    return found


def _met(members: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links between components of one list, from whole blocks of full sets: pairs
    are compared inside tasks, and only links that join components are rows."""
    blocks = _blocks(members, sets)
    side = lambda name: F.col("block").alias(name)
    left = blocks.where("outside").select("token", F.col("part").alias("p"), side("left"))
    right = blocks.select("token", "outside", F.col("part").alias("q"), side("right"))
    pairs = left.join(right, "token").where("not outside or p <= q").select("left", "right")
    kind = type_of(members, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = _linking(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), similarity)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], ["a", "b"])

    return pairs.mapInArrow(run, f"a {kind}, b {kind}")


def links(nodes: DataFrame, members: DataFrame, docs: DataFrame, how: dict) -> DataFrame:
    """(node, root) of all nodes that are linked with a smaller one."""
    none = members.select("node", F.col("node").alias("root")).limit(0)
    pairs = members.where("node <> hub").select(*_ordered("hub", "node"))
    roots = _linked(pairs, none, nodes, docs, how)
    apart = _apart(members, roots)
    sets = settled(_sets_of(apart.where(F.col("rest") > FEW), docs, how), "sets")
    finer = _apart(posting_lists(set_postings(sets, how["similarity"])), roots)
    pairs = _across(apart.where(F.col("rest") <= FEW)).unionByName(_across(finer.where(F.col("rest") <= SEVERAL)))
    roots = _linked(pairs, roots, nodes, docs, how)
    with small_batches(docs.sparkSession):
        met = settled(_met(finer.where(F.col("rest") > SEVERAL), sets, how["similarity"]), "links")
    return _joined(roots, met)


def _nodes(rows: DataFrame) -> DataFrame:
    """set_key, node, signature, brief: a row for each distinct set, its smallest key.

    Sets of one row are read from the profiles as they lie; signatures are exchanged of
    the first of several rows only, unless there are very many such sets."""
    valid = rows.where(F.col("set_key").isNotNull() & F.col("key").isNotNull())
    several = valid.groupBy("set_key").agg(F.min("key").alias("node"), F.count("*").alias("n")).where("n > 1")
    several = checked(settled(several.select("set_key", "node"), "several"))
    columns = ["set_key", "node", "signature", "brief"]
    single = valid.join(several.hint(several.df.select("set_key")), "set_key", "left_anti")
    single = single.withColumnRenamed("key", "node").select(columns)
    first = valid.join(several.side, "set_key").where(F.col("key") == F.col("node")).select(columns)
    first = first.dropDuplicates(["set_key"])
    if several.small:
        return single.unionByName(settled(first, "first"))
    return settled(single.unionByName(first), "nodes")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = SHINGLE,
    similarity: int = SIMILARITY,
    coordinates: int = COORDINATES,
) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the smallest key
    reachable over links) and kept (whether that is its own key)."""
    threshold = match_threshold(coordinates, similarity)
    rows = settled(profiles(docs, key, text, width, coordinates), "profiles")
    nodes = _nodes(rows)
    members = posting_lists(postings(nodes, coordinates - threshold + 1))
    how = {"key": key, "text": text, "width": width, "threshold": threshold, "similarity": similarity}
    roots = links(nodes, members, docs, how)
    classes = settled(
        nodes.select("set_key", "node").join(roots, "node", "left").select(
            "set_key", F.coalesce("root", "node").alias("root")
        ),
        "classes",
    )
    return (
        rows.select("key", "n_shingles", "set_key")
        .join(classes, "set_key", "left")
        .select(F.col("key").alias(key), "n_shingles", F.coalesce(F.when(F.col("key").isNotNull(), F.col("root")), F.col("key")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
    )


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each class, the one with the smallest key, all columns
    kept. Of rows with one key one stays; rows without a key all stay."""
    kept = near_duplicates(docs, key, text, **how).where(F.col("kept") & F.col(key).isNotNull())
    kept = kept.select(F.col(key).alias("_key")).distinct()
    chosen = docs.join(kept, docs[key] == kept["_key"], "left_semi").dropDuplicates([key])
    return chosen.unionByName(docs.where(F.col(key).isNull()))
