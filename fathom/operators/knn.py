"""Nearest neighbours for whole tables of question vectors.

Vectors fall into cells around fixed centers. Chunks are packed, where they
lie, into small blocks of one cell; questions are packed into blocks for the
cells they have to look at. Few questions meet the chunks in an equi-join on the
cell; many are dealt, like the chunks of one or several cells, to groups of a bounded
size, and a group of questions meets a group of chunks once, with all questions
that look at one of its cells. They are compared with matrix products. A task keeps only the k best rows per question,
so pairs are never written out.

Which cells a question looks at is the only difference between the searches:

* exact: every cell that can still hold one of its k best, by a bound on the
  similarity inside the cell;
* ivf: the nprobe nearest cells of a k-means clustering;
* lsh: the cells its random projections fall into.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from fathom.functions import vectors
from fathom.operators.joins import checked
from fathom.operators.ranking import SCORE_DIGITS, top_k
from fathom.session import bound_batches, settled

# Rows of the corpus read to place centers and to bound the k-th best score.
# Fixed sizes, whatever the corpus.
LANDMARKS = 512
CELLS = 32
BLOCK_ROWS = 1024
# Question vectors sent to every executor at most, in bytes, with a copy for each cell.
BROADCAST_BYTES = 32 << 20
# Questions a task keeps running results for before it hands them on.
QUESTIONS_HELD = 1_000_000
# Scores are compared after rounding, so bounds give way by more than that.
SLACK = 10.0 ** (1 - SCORE_DIGITS)


def validate(rows: DataFrame, dim: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows with a well-formed vector, and the rejected rest."""
    good = vectors.is_valid(F.col(vector), dim)
    return rows.where(good), rows.where(~good)


def common_dim(rows: DataFrame, vector: str = "embedding") -> int:
    """The most frequent length of the vectors."""
    found = rows.where(F.size(vector) > 0).agg(F.mode(F.size(vector))).first()[0]
    if found is None:
        raise ValueError("no vectors to search")
    return found


def rejects(rows: DataFrame, vector: str = "embedding", dim: int | None = None) -> DataFrame:
    """The rows that no search looks at: their vector is null, holds a null or a
    non-finite element, or has another length than `dim`."""
    return validate(rows, dim or common_dim(rows, vector), vector)[1]


def nearest_to_one(
    chunks: DataFrame,
    question: Sequence[float],
    k: int = 5,
    metric: str = "cosine",
    key: str = "key",
    vector: str = "embedding",
) -> DataFrame:
    """k best chunks for one vector, with all chunk columns.

    Ends in a per-partition top-k; only k rows per task move."""
    asked = F.array(*[F.lit(float(x)) for x in question])
    scored = chunks.withColumn(
        "score", F.round(vectors.similarity(metric, F.col(vector), asked), SCORE_DIGITS)
    )
    return scored.orderBy(F.desc("score"), F.asc(key)).limit(k)


def project(rows: np.ndarray, metric: str) -> np.ndarray:
    """Vectors in the space where cells are cut: the unit sphere for cosine."""
    rows = np.asarray(rows, dtype=np.float64)
    if metric != "cosine":
        return rows
    length = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def scores_between(asked: np.ndarray, held: np.ndarray, metric: str) -> np.ndarray:
    """Similarity of projected questions (rows) and chunks (columns)."""
    if metric == "l2":
        return -squared_gaps(asked, held)
    return asked @ held.T


def squared_gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]
    return np.maximum(out, 0.0)


@dataclass(frozen=True)
class Cells:
    """A fixed number of centers, and what is known about the vectors near
    them. Small by construction, so it travels inside the task closures."""

    metric: str
    centers: np.ndarray
    radii: np.ndarray | None = None
    landmarks: np.ndarray | None = None

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gaps = squared_gaps(rows, self.centers)
        cell = gaps.argmin(1)
        return cell, np.sqrt(gaps[np.arange(len(rows)), cell])

    def within_reach(self, asked: np.ndarray, k: int) -> np.ndarray:
        """Which cells may hold one of the k best: the best score a cell
        allows is compared with the k-th best score among the landmarks, which
        are chunks themselves."""
        if self.landmarks is None or len(self.landmarks) < k:
            floor = np.full(len(asked), -np.inf)
        else:
            known = scores_between(asked, self.landmarks, self.metric)
            floor = np.partition(known, -k, axis=1)[:, -k]
        if self.metric == "l2":
            away = np.maximum(np.sqrt(squared_gaps(asked, self.centers)) - self.radii, 0.0)
            ceiling = -away * away
        else:
            length = np.linalg.norm(asked, axis=1, keepdims=True)
            ceiling = asked @ self.centers.T + length * self.radii
        tolerance = SLACK * (1.0 + np.abs(ceiling))
        return (ceiling + tolerance >= floor[:, None]) & (self.radii >= 0)

    def closest(self, asked: np.ndarray, nprobe: int) -> np.ndarray:
        order = squared_gaps(asked, self.centers).argsort(1, kind="stable")[:, :nprobe]
        chosen = np.zeros((len(asked), len(self.centers)), dtype=bool)
        np.put_along_axis(chosen, order, True, axis=1)
        return chosen


def matrix_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    lists = batch.column(name)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(lists), -1) if len(lists) else values.reshape(0, 0)


def survey_cells(
    chunks: DataFrame,
    metric: str = "cosine",
    key: str = "key",
    vector: str = "embedding",
    n_cells: int = CELLS,
    n_landmarks: int = LANDMARKS,
    dim: int | None = None,
) -> Cells:
    """Centers and landmarks from a fixed-size hash sample of the valid chunks,
    and the radius of every cell. Two passes over the vectors; what comes back is
    `n_landmarks` vectors and `n_cells` numbers."""
    chunks = validate(chunks, dim or common_dim(chunks, vector), vector)[0]
    picked = (
        chunks.select(key, vector).orderBy(F.xxhash64(key), F.col(key)).limit(n_landmarks)
    )
    found = picked.select(vector).toPandas()[vector]
    if found.empty:
        raise ValueError("no vectors to search")
    landmarks = project(np.stack(found.to_list()), metric)
    centers = np.unique(landmarks[:n_cells], axis=0)
    cells = Cells(metric, centers)
    placed = assign(chunks, cells, key, vector).groupBy("cell").agg(F.max("gap").alias("radius"))
    radii = np.full(len(centers), -1.0)
    for row in placed.limit(len(centers)).toPandas().itertuples():
        radii[row.cell] = row.radius
    return Cells(metric, centers, radii, landmarks)


def assign(chunks: DataFrame, cells: Cells, key: str, vector: str) -> DataFrame:
    """key, cell, gap: nearest center of every chunk and the distance to it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, gap = cells.nearest(project(matrix_of(batch, vector), cells.metric))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key), pa.array(cell, pa.int32()), pa.array(gap)],
                    names=[key, "cell", "gap"],
                )

    key_type = chunks.schema[key].dataType.simpleString()
    return chunks.select(key, vector).mapInArrow(place, f"{key} {key_type}, cell int, gap double")


def pack(
    rows: DataFrame, key: str, vector: str, choose, metric: str, dim: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """cell, ids, block: vectors of one cell side by side, at most `block_rows`
    of them, packed within a task. `choose` maps projected vectors to a boolean
    row-by-cell table. Rows without a valid vector are left out, see `rejects`."""
    bound_batches(rows.sparkSession)
    rows = validate(rows, dim, vector)[0]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = project(matrix_of(batch, vector), metric)
            ids = batch.column(key).to_numpy(zero_copy_only=False)
            chosen = choose(held)
            out = {"cell": [], "ids": [], "block": []}
            for cell in np.flatnonzero(chosen.any(0)):
                members = np.flatnonzero(chosen[:, cell])
                for at in range(0, len(members), block_rows):
                    part = members[at : at + block_rows]
                    out["cell"].append(int(cell))
                    out["ids"].append(ids[part].tolist())
                    out["block"].append(held[part].tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=arrow_schema)

    key_type = rows.schema[key].dataType
    arrow_key = to_arrow_type(key_type)
    arrow_schema = pa.schema(
        [("cell", pa.int32()), ("ids", pa.list_(arrow_key)), ("block", pa.binary())]
    )
    schema = T.StructType(
        [
            T.StructField("cell", T.IntegerType()),
            T.StructField("ids", T.ArrayType(key_type)),
            T.StructField("block", T.BinaryType()),
        ]
    )
    return rows.select(key, vector).mapInArrow(fill, schema)


def one_cell(cells: Cells):
    def choose(held: np.ndarray) -> np.ndarray:
        cell, _ = cells.nearest(held)
        chosen = np.zeros((len(held), len(cells.centers)), dtype=bool)
        chosen[np.arange(len(held)), cell] = True
        return chosen

    return choose


# Bytes of vectors of either side that meet in one group.
GROUP_BYTES = 32 << 20
# Smaller groups are made until so many meet for each core.
MEETINGS_PER_CORE = 4
# Questions and chunks of one matrix product, and neighbouring chunks of which the
# best is looked at first.
ASKED_ROWS, HELD_ROWS, STRATUM = 1024, 4096, 32
# Vectors in a block of questions that is dealt to a group.
DEALT_ROWS = 256
# Bytes of blocks that are read from a stored file at once, about.
STORED_BYTES = 16 << 20


@dataclass(frozen=True)
class Asked:
    """Questions, and which cells they look at: `choose` maps projected vectors to a
    boolean row-by-cell table, with `copies` cells a question at most."""

    rows: DataFrame
    key: str
    vector: str
    metric: str
    dim: int
    choose: Callable[[np.ndarray], np.ndarray]
    copies: int

    def small(self) -> bool:
        return _small_enough(self.rows, self.copies, self.dim)

    def blocks(self) -> DataFrame:
        return pack(self.rows, self.key, self.vector, self.choose, self.metric, self.dim)

    def by_cell(self) -> tuple[dict[int, int], int]:
        """How many questions look at each cell that any looks at, and how many look at
        any cell."""
        bound_batches(self.rows.sparkSession)
        choose, vector, metric = self.choose, self.vector, self.metric

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    chosen = choose(project(matrix_of(batch, vector), metric))
                    # After the cells, the questions themselves.
                    n = np.append(chosen.sum(0), chosen.any(1).sum())
                    cell = np.append(np.arange(chosen.shape[1]), -1)[n > 0]
                    columns = [pa.array(cell, pa.int32()), pa.array(n[n > 0], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["cell", "n"])

        good = validate(self.rows, self.dim, vector)[0].select(vector)
        found = good.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        looked = {row["cell"]: row["n"] for row in found.collect()}
        return looked, looked.pop(-1, 0)


def compare_blocks(
    chunk_blocks: DataFrame, asked: Asked, k: int, key: str, distinct: bool = False
) -> DataFrame:
    """question, key, score of the k best chunks per question and task, or group of
    chunks; with `distinct` of the k best keys."""
    question, metric = asked.key, asked.metric
    schema = T.StructType(
        [
            T.StructField(question, asked.rows.schema[question].dataType),
            T.StructField(key, chunk_blocks.schema["ids"].dataType.elementType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    if not asked.small():
        choose = asked.choose
        return meet_in_groups(
            chunk_blocks, asked, schema, lambda met, blocks: _best_of_group(met, blocks, k, metric, choose, distinct)
        )
    question_blocks = asked.blocks()
    sent = question_blocks.select(
        "cell",
        F.col("ids").alias("question_ids"),
        F.col("block").alias("question_block"),
        F.xxhash64("ids").alias("question_group"),
    )
    meetings = chunk_blocks.join(F.broadcast(sent), "cell").select(
        "ids", "block", "question_group", "question_ids", "question_block"
    )

    def keep_best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, Best] = {}
        waiting = 0
        for part in parts:
            for ids, block, group, question_ids, question_block in part.itertuples(index=False):
                held_rows = np.frombuffer(block).reshape(len(ids), -1)
                asked_rows = np.frombuffer(question_block).reshape(len(question_ids), -1)
                if group not in best:
                    best[group] = Best(np.asarray(question_ids), k)
                    waiting += len(question_ids)
                found = np.round(scores_between(asked_rows, held_rows, metric), SCORE_DIGITS)
                best[group].add(np.asarray(ids), found)
                if waiting > QUESTIONS_HELD:
                    yield from (kept.rows(question, key) for kept in best.values())
                    best.clear()
                    waiting = 0
        for kept in best.values():
            yield kept.rows(question, key)

    return meetings.mapInPandas(keep_best, schema)


def meet_in_groups(chunk_blocks: DataFrame, asked: Asked, schema: T.StructType, body) -> DataFrame:
    """The rows `body` gives for the questions (ids, vectors) and blocks of chunks of
    one or several cells, of which every question looks at one at least.

    Cells are put together to groups, and a larger cell is dealt to several, by their
    counted chunks; so are the questions of each group. A group has GROUP_BYTES at most,
    about, and every group of questions meets its group of chunks once, in a task that
    holds these two and nothing else."""
    most = max(1, GROUP_BYTES // (8 * asked.dim))
    cores = chunk_blocks.sparkSession.sparkContext.defaultParallelism
    side = max(1, round((MEETINGS_PER_CORE * cores) ** 0.5))
    looked, n_asked = asked.by_cell()
    held_by = chunk_blocks.groupBy("cell").agg(F.sum(F.size("ids"))).collect()
    held_by = {cell: n for cell, n in held_by if cell in looked}
    rows = min(most, max(HELD_ROWS, -(-sum(held_by.values()) // side)))
    # Units of cells that go together, with their first group and number of groups.
    units: list[list[int]] = []
    rooms, counts = [], []
    for cell, n in sorted(held_by.items(), key=lambda x: (-x[1], x[0])):
        unit = next((u for u, room in enumerate(rooms) if room >= n), len(units))
        if unit == len(units):
            units.append([])
            counts.append(max(1, -(-n // rows)))
            rooms.append(rows if counts[-1] == 1 else n)
        units[unit].append(cell)
        rooms[unit] -= n
    starts = [sum(counts[:u]) for u in range(len(units))]
    # A question that looks at several cells of a unit is one of its questions, not several.
    reach = [min(n_asked, sum(looked[cell] for cell in unit)) for unit in units]
    rows = min(most, max(ASKED_ROWS, -(-max(reach, default=0) // side), DEALT_ROWS))
    parts = [-(-n // rows) for n in reach]

    def of(values: dict[int, int]) -> Column:
        pairs = [F.lit(x) for item in values.items() for x in item]
        return F.create_map(*pairs)[F.col("cell")] if pairs else F.lit(None).cast("int")

    by_cell = {cell: u for u, unit in enumerate(units) for cell in unit}
    own = lambda n: F.pmod(F.xxhash64("ids"), n).cast("int")
    held = chunk_blocks.where(F.col("cell").isin(list(by_cell)) if by_cell else F.lit(False))
    held = held.withColumn("group", of({c: starts[u] for c, u in by_cell.items()}) + own(of({c: counts[u] for c, u in by_cell.items()})))
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), of({c: parts[u] for c, u in by_cell.items()}) - 1)))

    choose = asked.choose

    def units_of(vectors: np.ndarray) -> np.ndarray:
        chosen = choose(vectors)
        wanted = [chosen[:, unit].any(1) for unit in units]
        return np.stack(wanted, axis=1) if wanted else np.zeros((len(vectors), 0), dtype=bool)

    met = pack(asked.rows, asked.key, asked.vector, units_of, asked.metric, asked.dim, DEALT_ROWS)
    met = met.withColumn("part", own(of(dict(enumerate(parts)))))
    first = of(dict(enumerate(starts)))
    met = met.withColumn("group", F.explode(F.sequence(first, first + of(dict(enumerate(counts))) - 1)))
    # With room, so that few meetings share a task; a given number is not coalesced.
    meetings = sum(n * m for n, m in zip(counts, parts))
    tasks = max(1, meetings, min(4 * meetings, 2000))
    held, met = (side.repartition(tasks, "group", "part").groupBy("group", "part") for side in (held, met))
    arrow_schema = to_arrow_schema(schema)

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return arrow_schema.empty_table()
        return pa.Table.from_arrays(body(_vectors_of(asked), held), schema=arrow_schema)

    return held.cogroup(met).applyInArrow(run, schema)


def _ids_of(blocks: pa.Table) -> pa.Array:
    return pa.concat_arrays([part.flatten() for part in blocks["ids"].chunks])


def _cells_of(blocks: pa.Table) -> np.ndarray:
    """The cell of every vector."""
    return np.repeat(blocks["cell"].to_numpy(), pc.list_value_length(blocks["ids"]).to_numpy())


def _vectors_of(blocks: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors of some blocks, which hold doubles."""
    ids = _ids_of(blocks)
    return ids, np.frombuffer(b"".join(blocks["block"].to_pylist())).reshape(len(ids), -1)


def _met_by_tile(
    asked_rows: np.ndarray, held_rows: np.ndarray, cell: np.ndarray, k: int, metric: str, choose, gaps: np.ndarray | None = None
) -> Iterator[tuple[int, Nearest]]:
    """For some questions after others the place of their first, and the nearest among
    the vectors of the cells that each looks at."""
    parts = {c: parts_of(held_rows, metric, gaps, np.flatnonzero(cell == c)) for c in np.unique(cell)}
    for first in range(0, len(asked_rows), ASKED_ROWS):
        near = Nearest(asked_rows[first : first + ASKED_ROWS], k, metric)
        chosen = choose(near.asked)
        for c, held in parts.items():
            looking = np.flatnonzero(chosen[:, c])
            if len(looking):
                near.meet(held, looking=looking)
        if near.found:
            yield first, near


def _best_of_group(
    asked: tuple[pa.Array, np.ndarray], blocks: pa.Table, k: int, metric: str, choose, distinct: bool
) -> list[pa.Array]:
    (question_ids, asked_rows), (ids, held_rows), cell = asked, _vectors_of(blocks), _cells_of(blocks)
    # In key order, so that a place tells which of two equal scores comes first.
    order = pc.sort_indices(ids, sort_keys=[("", "ascending")], null_placement="at_start").to_numpy()
    ids, held_rows, cell = ids.take(pa.array(order)), held_rows[order], cell[order]
    if distinct:
        k *= int(pc.max(pc.value_counts(ids).field("counts")).as_py())
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for first, near in _met_by_tile(asked_rows, held_rows, cell, k, metric, choose):
        rows = near.best_rows()
        q, at, score, _ = near.candidates()
        found.append((q[rows] + first, at[rows], np.round(score[rows], SCORE_DIGITS)))
    q, at, score = (np.concatenate(x) for x in zip(*found))
    return [question_ids.take(pa.array(q)), ids.take(pa.array(at)), pa.array(score)]


@dataclass(frozen=True)
class Part:
    """Chunks of one product, at these places of `held`, as `Nearest` screens them: moved
    by `middle` and divided by `unit`, in single precision, filled up to whole strata.
    Worked out once, whatever number of questions meets them."""

    held: np.ndarray
    at: np.ndarray
    gaps: np.ndarray | None
    middle: np.ndarray | float
    unit: float
    single: np.ndarray
    length: float

    @property
    def gap(self) -> float:
        return 0.0 if self.gaps is None else float(self.gaps.max())


def parts_of(
    held: np.ndarray, metric: str, gaps: np.ndarray | None = None, places: np.ndarray | None = None
) -> list[Part]:
    """Chunks, or those at some places, with their own errors `gaps`, cut for products."""
    places, parts = np.arange(len(held)) if places is None else places, []
    for first in range(0, len(places), HELD_ROWS):
        at = places[first : first + HELD_ROWS]
        y, middle = held[at], 0.0
        if metric == "l2":
            middle = y.mean(0)
            y = y - middle
        unit = float(np.abs(y).max(initial=0.0)) or 1.0
        y = y / unit
        if metric == "l2":
            y = np.hstack([y, (y * y).sum(1, keepdims=True)])
        single = np.zeros((-(-len(at) // STRATUM) * STRATUM, y.shape[1]), np.float32)
        single[: len(at)] = y
        length = float(np.linalg.norm(y, axis=1).max())
        parts.append(Part(held, at, None if gaps is None else gaps[at], middle, unit, single, length))
    return parts


class Nearest:
    """The chunks that can be among the k best of some questions.

    Scores are screened in single precision, a product of two tiles at a time: of every
    stratum of neighbouring chunks the best, whose k-th largest is a floor; only strata
    that reach it are looked into, with room for rounding and for the chunks' own error
    `gaps`. What passes is scored in double precision."""

    def __init__(self, asked: np.ndarray, k: int, metric: str):
        self.asked, self.k, self.metric = asked, k, metric
        self.length = np.linalg.norm(asked, axis=1)
        # What the k-th best scores at least.
        self.floor = np.full(len(asked), -np.inf)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0
        self.memory = np.empty(0, np.float32)

    def add(self, held: np.ndarray, gaps: np.ndarray | None = None, base: int = 0) -> None:
        """More chunks, whose places are counted from `base`."""
        self.meet(parts_of(held, self.metric, gaps), base)

    def meet(self, parts: list[Part], base: int = 0, looking: np.ndarray | None = None) -> None:
        """More chunks, cut for products, for all questions or those `looking`."""
        rows = np.arange(len(self.asked)) if looking is None else looking
        for part in parts:
            q, at = self._screened(part, rows)
            score = np.empty(len(q))
            for start in range(0, len(q), 1 << 16):
                cut = slice(start, start + (1 << 16))
                x, y = self.asked[q[cut]], part.held[part.at[at[cut]]]
                score[cut] = -((x - y) ** 2).sum(1) if self.metric == "l2" else np.einsum("ij,ij->i", x, y)
            gap = np.zeros(len(at)) if part.gaps is None else part.gaps[at]
            self.found.append((q, base + part.at[at], score, gap))
            self.waiting += len(q)
            if self.waiting > 16 * self.k * len(self.asked):
                self.found = [self._kept(self.best_rows() if part.gaps is None else self.possible_rows())]
                self.waiting = len(self.found[0][0])

    def candidates(self) -> tuple[np.ndarray, ...]:
        """Places of questions and chunks, scores and gaps."""
        return tuple(np.concatenate(x) for x in zip(*self.found))

    def _kept(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(x[rows] for x in self.candidates())

    def _ranks(self, q: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers by question and order, and the rank of each in its question."""
        rows = np.lexsort((*reversed(order), q))
        return rows, np.arange(len(q)) - np.searchsorted(q[rows], np.arange(len(self.asked)))[q[rows]]

    def best_rows(self) -> np.ndarray:
        """Of the candidates the k best of each question, by rounded score, then place."""
        q, at, score, _ = self.candidates()
        score = np.round(score, SCORE_DIGITS)
        rows, rank = self._ranks(q, -score, at)
        last = rows[rank == self.k - 1]
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last] - SLACK)
        return rows[rank < self.k]

    def possible_rows(self) -> np.ndarray:
        """Of the candidates all that can be among the k best for their gaps."""
        q = self.candidates()[0]
        low, high = self.ranges()
        rows, rank = self._ranks(q, -low)
        last = rows[rank == self.k - 1]
        self.floor[q[last]] = np.maximum(self.floor[q[last]], low[last])
        return np.flatnonzero(high >= self.floor[q])

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score that each candidate can have."""
        q, _, score, gap = self.candidates()
        if self.metric == "l2":
            slack = (2 * np.sqrt(np.maximum(-score, 0.0)) + gap) * gap
        else:
            slack = self.length[q] * gap
        slack = slack + SLACK * (1 + np.abs(score))
        return score - slack, score + slack

    def _screened(self, part: Part, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of questions, of these rows, and in the part of chunks that may score
        what their floor asks."""
        asked, n, v, gap = self.asked[rows] - part.middle, len(part.at), part.unit, part.gap
        u = np.abs(asked).max(1, initial=0.0)
        u = np.maximum(u, v) if self.metric == "l2" else np.where(u > 0, u, 1.0)
        x, unit = asked / u[:, None], u * v
        if self.metric == "l2":
            x = np.hstack([2 * x, -(v / u)[:, None]])
            base = -(asked * asked).sum(1)
        else:
            base = np.zeros(len(asked))
        # Rounding of the product, at most, in its own unit; and beside the gaps.
        off = (x.shape[1] + 4) * 6e-8 * np.linalg.norm(x, axis=1) * part.length
        off = off + 1e-15 * np.abs(base) / unit
        # A row for each chunk, so that the best of a stratum is taken along whole rows.
        scores = self._product(part.single, x.astype(np.float32).T)
        scores[n:] = -np.inf
        strata = scores.reshape(-1, STRATUM, len(x))
        tops = strata.max(1)
        known = tops if len(tops) >= self.k else scores
        if n >= self.k:
            best = np.partition(known.T.copy(), -self.k, axis=1)[:, -self.k]
            least = base + (best.astype(np.float64) - off) * unit
            self.floor[rows] = np.maximum(self.floor[rows], self._worst(least, gap, rows))
        limit = ((self._least(gap, rows) - base) / unit - off).astype(np.float32)
        limit = np.nextafter(limit, np.float32(-np.inf))
        stratum, q = np.nonzero(tops >= limit)
        inside, place = np.nonzero(strata[stratum, :, q] >= limit[q, None])
        q, at = q[inside], stratum[inside] * STRATUM + place
        real = at < n
        return rows[q[real]], at[real]

    def _product(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The product of two matrices in memory that is used again."""
        size = x.shape[0] * y.shape[1]
        if len(self.memory) < size:
            self.memory = np.empty(size, np.float32)
        return np.matmul(x, y, out=self.memory[:size].reshape(x.shape[0], y.shape[1]))

    def _worst(self, score: np.ndarray, gap: float, rows: np.ndarray) -> np.ndarray:
        """The least that chunks of such a score really have, before rounding."""
        if self.metric == "l2":
            return -((np.sqrt(np.maximum(-score, 0.0)) + gap) ** 2) - SLACK * (1 + np.abs(score))
        return score - self.length[rows] * gap - SLACK * (1 + np.abs(score))

    def _least(self, gap: float, rows: np.ndarray) -> np.ndarray:
        """The score from which a chunk may really reach the floor."""
        floor = self.floor[rows]
        with np.errstate(invalid="ignore"):
            floor = floor - np.where(np.isfinite(floor), SLACK * (1 + np.abs(floor)), 0.0)
        if self.metric == "l2":
            return -((np.sqrt(np.maximum(-floor, 0.0)) + gap) ** 2)
        return floor - self.length[rows] * gap


class Best:
    """Running k best (score, then key) of a block of questions in one task."""

    def __init__(self, questions: np.ndarray, k: int):
        self.questions = questions
        self.k = k
        self.floor = np.full(len(questions), -np.inf)
        self.scores = [np.empty(0)] * len(questions)
        self.keys: list[np.ndarray] = [np.empty(0)] * len(questions)

    def add(self, ids: np.ndarray, found: np.ndarray) -> None:
        candidates = found >= self.floor[:, None]
        for q in np.flatnonzero(candidates.any(1)):
            at = np.flatnonzero(candidates[q])
            fresh = ~np.isin(ids[at], self.keys[q]) if len(self.keys[q]) else slice(None)
            keys = np.concatenate([self.keys[q], ids[at][fresh]]) if len(self.keys[q]) else ids[at]
            scores = np.concatenate([self.scores[q], found[q, at][fresh]])
            order = np.lexsort((keys, -scores))[: self.k]
            self.scores[q], self.keys[q] = scores[order], keys[order]
            if len(order) == self.k:
                self.floor[q] = self.scores[q][-1]

    def rows(self, question: str, key: str) -> pd.DataFrame:
        sizes = [len(s) for s in self.scores]
        return pd.DataFrame(
            {
                question: np.repeat(self.questions, sizes),
                key: np.concatenate(self.keys) if sum(sizes) else [],
                "score": np.concatenate(self.scores) if sum(sizes) else [],
            }
        )


def _small_enough(questions: DataFrame, copies: int, dim: int) -> bool:
    return checked(questions, max(1, BROADCAST_BYTES // (8 * dim * max(1, copies)))).small


def exact(
    chunks: DataFrame,
    questions: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    key: str = "key",
    question: str = "question_id",
    vector: str = "embedding",
    n_cells: int = CELLS,
    n_landmarks: int = LANDMARKS,
    cells: Cells | None = None,
) -> DataFrame:
    """question, key, score, rank: the true k nearest chunks of every question.

    `cells` from an earlier `survey_cells` of the same chunks saves the survey,
    e.g. between the batches of a stream."""
    if cells is None:
        cells = survey_cells(chunks, metric, key, vector, n_cells, n_landmarks)
    metric = cells.metric
    n_centers, dim = cells.centers.shape
    held = pack(chunks, key, vector, one_cell(cells), metric, dim)
    asked = Asked(questions, question, vector, metric, dim, lambda v: cells.within_reach(v, k), n_centers)
    found = compare_blocks(held, asked, k, key)
    return top_k(found, k, question, key)


def train_ivf(
    chunks: DataFrame,
    n_cells: int = CELLS,
    metric: str = "cosine",
    vector: str = "embedding",
    max_iter: int = 10,
    seed: int = 7,
) -> Cells:
    """k-means cells; the clustering itself runs on Spark."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    chunks = validate(chunks, common_dim(chunks, vector), vector)[0]
    value = vectors.as_doubles(F.col(vector))
    if metric == "cosine":
        length = vectors.norm(value)
        value = F.when(length > 0, F.transform(value, lambda x: x / length)).otherwise(value)
    rows = chunks.select(array_to_vector(value).alias("features"))
    model = KMeans(k=n_cells, maxIter=max_iter, seed=seed, initMode="random").fit(rows)
    return Cells(metric, np.array(model.clusterCenters()))


def ivf(
    chunks: DataFrame,
    questions: DataFrame,
    cells: Cells,
    nprobe: int,
    k: int = 5,
    key: str = "key",
    question: str = "question_id",
    vector: str = "embedding",
) -> DataFrame:
    """k best chunks among the nprobe nearest cells of each question."""
    held = pack(chunks, key, vector, one_cell(cells), cells.metric, cells.centers.shape[1])
    return _probe(held, questions, cells, nprobe, k, key, question, vector)


def _probing(questions: DataFrame, cells: Cells, nprobe: int, question: str, vector: str) -> Asked:
    dim = cells.centers.shape[1]
    return Asked(questions, question, vector, cells.metric, dim, lambda v: cells.closest(v, nprobe), nprobe)


def _probe(
    held: DataFrame, questions: DataFrame, cells: Cells, nprobe: int, k: int, key: str, question: str, vector: str
) -> DataFrame:
    asked = _probing(questions, cells, nprobe, question, vector)
    found = compare_blocks(held, asked, k, key)
    return top_k(found, k, question, key)


def write_ivf(
    chunks: DataFrame, cells: Cells, path: str, key: str = "key", vector: str = "embedding"
) -> None:
    """Store the chunks in packed blocks, one folder per cell, and the centers.

    Blocks are packed before they move; rebalancing brings the blocks of a
    cell together and cuts a crowded cell into files of an even size."""
    held = pack(chunks, key, vector, one_cell(cells), cells.metric, cells.centers.shape[1])
    held = held.hint("rebalance", "cell").write.partitionBy("cell")
    held.option("parquet.block.size", STORED_BYTES).parquet(f"{path}/blocks")
    rows = [(cells.metric, i, [float(x) for x in c]) for i, c in enumerate(cells.centers)]
    spark = chunks.sparkSession
    centers = spark.createDataFrame(rows, "metric string, cell int, center array<double>")
    centers.coalesce(1).write.parquet(f"{path}/centers")


def search_ivf(
    spark: SparkSession,
    path: str,
    questions: DataFrame,
    nprobe: int,
    k: int = 5,
    key: str = "key",
    question: str = "question_id",
    vector: str = "embedding",
) -> DataFrame:
    """Search stored cells. Only folders of cells that some question probes
    are read; their list is no longer than the list of centers."""
    stored = spark.read.parquet(f"{path}/centers").orderBy("cell").toPandas()
    cells = Cells(stored["metric"].iloc[0], np.stack(stored["center"].to_list()))
    probed = list(_probing(questions, cells, nprobe, question, vector).by_cell()[0])
    held = spark.read.parquet(f"{path}/blocks").where(F.col("cell").isin(probed))
    return _probe(held, questions, cells, nprobe, k, key, question, vector)


# Folders that stored vectors are dealt to by their key.
KEY_BUCKETS = 64
# Pairs of question and chunk that are sent to every executor at most.
NEAR_ROWS = 100_000


def key_bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


def write_half(
    chunks: DataFrame,
    path: str,
    metric: str = "cosine",
    key: str = "key",
    vector: str = "embedding",
    n_cells: int = CELLS,
) -> None:
    """Store the chunks for `search_half`: in packed blocks of two bytes a component,
    a folder for each cell, which a search reads; and as they are, in folders by
    bucket of the key, of which it reads the few it reranks.

    A block is scaled by its largest component, so that no value overflows, and
    keeps the largest distance between a vector and its rounded form."""
    spark, dim = chunks.sparkSession, common_dim(chunks, vector)
    cells = survey_cells(chunks, metric, key, vector, n_cells, dim=dim)
    packed = pack(chunks, key, vector, one_cell(cells), metric, dim)

    def round_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves, scales, gaps = [], [], []
            for block in batch.column("block").to_pylist():
                rows = np.frombuffer(block).reshape(-1, dim)
                scale = float(np.abs(rows).max(initial=0.0)) or 1.0
                half = (rows / scale).astype(np.float16)
                halves.append(half.tobytes())
                scales.append(scale)
                gaps.append(float(np.linalg.norm(rows - half.astype(np.float64) * scale, axis=1).max(initial=0.0)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("cell"), batch.column("ids"), pa.array(halves, pa.binary()), pa.array(scales), pa.array(gaps)],
                ["cell", "ids", "half", "scale", "gap"],
            )

    kind = packed.schema["ids"].dataType.simpleString()
    halved = packed.mapInArrow(round_, f"cell int, ids {kind}, half binary, scale double, gap double")
    halved = halved.hint("rebalance", "cell").write.partitionBy("cell")
    halved.option("parquet.block.size", STORED_BYTES).parquet(f"{path}/half")
    valid = validate(chunks.select(key, vector), dim, vector)[0].withColumn("bucket", key_bucket(key))
    valid.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/vectors")
    rows = [(metric, i, c.tolist(), float(r)) for i, (c, r) in enumerate(zip(cells.centers, cells.radii))]
    marks = [(metric, -1, m.tolist(), 0.0) for m in cells.landmarks]
    kept = spark.createDataFrame(rows + marks, "metric string, cell int, center array<double>, radius double")
    kept.coalesce(1).write.parquet(f"{path}/cells")


def _stored_cells(spark: SparkSession, path: str) -> Cells:
    """A fixed number of centers and landmarks."""
    rows = spark.read.parquet(f"{path}/cells").toPandas()
    centers = rows[rows["cell"] >= 0].sort_values("cell")
    marks = np.stack(rows[rows["cell"] < 0]["center"].to_list())
    return Cells(rows["metric"].iloc[0], np.stack(centers["center"].to_list()), centers["radius"].to_numpy(), marks)


def search_half(
    spark: SparkSession,
    path: str,
    questions: DataFrame,
    k: int = 5,
    key: str = "key",
    question: str = "question_id",
    vector: str = "embedding",
) -> DataFrame:
    """question, key, score, rank: the true k nearest of what `write_half` stored.

    Scores on the rounded vectors lie within a known distance of the true ones, so a
    chunk whose highest possible score is below the k-th best sure one is out. The
    others, k and a few more for each question, are scored on their own vectors, read
    from the folders of their buckets."""
    cells = _stored_cells(spark, path)
    metric, dim = cells.metric, cells.centers.shape[1]
    asked = Asked(questions, question, vector, metric, dim, lambda v: cells.within_reach(v, k), len(cells.centers))
    probed = list(asked.by_cell()[0])
    held = spark.read.parquet(f"{path}/half").where(F.col("cell").isin(probed) if probed else F.lit(False))
    bounded = settled(_bounds(held, asked, k, key), "bounds")
    sure = top_k(bounded.select(question, key, F.col("low").alias("score")), k, question, key)
    floors = sure.groupBy(question).agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k)
    near = bounded.join(floors.select(question, "floor"), question, "left")
    near = near.where(F.col("floor").isNull() | (F.col("high") >= F.col("floor") - SLACK)).select(question, key)
    near = checked(settled(near, "near"), NEAR_ROWS)
    buckets = [row[0] for row in near.df.select(key_bucket(key)).distinct().collect()]
    stored = spark.read.parquet(f"{path}/vectors").where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
    stored = stored.select(key, F.col(vector).alias("_held"))
    met = stored.join(near.side, key).join(questions.select(question, F.col(vector).alias("_asked")), question)
    score = vectors.similarity(metric, F.col("_asked"), F.col("_held"))
    return top_k(met.select(question, key, score.alias("score")), k, question, key)


def _halves(blocks: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of blocks of half precision, and the largest rounding distance of each."""
    parts = [np.frombuffer(half, np.float16).reshape(-1, dim) for half in blocks["half"].to_pylist()]
    sizes = [len(part) for part in parts]
    scales, gaps = (np.repeat(blocks[c].to_numpy(), sizes) for c in ("scale", "gap"))
    return np.concatenate(parts).astype(np.float64) * scales[:, None], gaps


def _possible(near: Nearest) -> tuple[np.ndarray, ...]:
    rows = near.possible_rows()
    q, at, *_ = near.candidates()
    low, high = near.ranges()
    return q[rows], at[rows], low[rows], high[rows]


def _bounds(held: DataFrame, asked: Asked, k: int, key: str) -> DataFrame:
    """question, key, low, high: of each task, or group of chunks, those that may be
    among the k best of a question, with the least and the largest score they can have."""
    metric, dim, choose = asked.metric, asked.dim, asked.choose
    held = held.select("cell", "ids", "half", "scale", "gap")
    schema = T.StructType(
        [
            T.StructField(asked.key, asked.rows.schema[asked.key].dataType),
            T.StructField(key, held.schema["ids"].dataType.elementType),
            T.StructField("low", T.DoubleType()),
            T.StructField("high", T.DoubleType()),
        ]
    )
    arrow_schema = to_arrow_schema(schema)

    def of_group(met: tuple[pa.Array, np.ndarray], blocks: pa.Table) -> list[pa.Array]:
        (question_ids, asked_rows), ids, cell = met, _ids_of(blocks), _cells_of(blocks)
        vectors, gaps = _halves(blocks, dim)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        for first, near in _met_by_tile(asked_rows, vectors, cell, k, metric, choose, gaps):
            q, *rest = _possible(near)
            found.append((q + first, *rest))
        q, at, low, high = (np.concatenate(x) for x in zip(*found))
        return [question_ids.take(pa.array(q)), ids.take(pa.array(at)), pa.array(low), pa.array(high)]

    if not asked.small():
        return meet_in_groups(held, asked, schema, of_group)
    sent = asked.blocks().select("cell", F.col("ids").alias("question_ids"), F.col("block").alias("question_block"))
    sent = sent.withColumn("question_group", F.xxhash64("question_ids", "cell"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # For each block of questions what was found, and the ids that its places mean.
        best: dict[int, tuple[pa.Array, Nearest, list[pa.Array]]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                meeting = pa.Table.from_batches([batch.slice(row, 1)])
                group = meeting["question_group"][0].as_py()
                if group not in best:
                    asked_rows = np.frombuffer(meeting["question_block"][0].as_py()).reshape(-1, dim)
                    best[group] = meeting["question_ids"].chunk(0).flatten(), Nearest(asked_rows, k, metric), []
                _, near, ids = best[group]
                base = sum(map(len, ids))
                ids.append(meeting["ids"].chunk(0).flatten())
                near.add(*_halves(meeting, dim), base)
        for question_ids, near, ids in best.values():
            q, at, low, high = _possible(near)
            columns = [question_ids.take(pa.array(q)), pa.concat_arrays(ids).take(pa.array(at)), pa.array(low), pa.array(high)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema)

    return held.join(F.broadcast(sent), "cell").mapInArrow(keep, schema)


@dataclass(frozen=True)
class Projections:
    """Random projections cut into buckets of equal width, `tables` times."""

    directions: np.ndarray
    width: float
    spread: int

    @classmethod
    def draw(cls, dim: int, tables: int = 6, width: float = 0.5, spread: int = 64, seed: int = 7):
        directions = np.random.default_rng(seed).standard_normal((dim, tables))
        return cls(directions / np.linalg.norm(directions, axis=0), width, spread)

    def choose(self, held: np.ndarray) -> np.ndarray:
        """Row-by-cell table with one cell per table of projections."""
        tables = self.directions.shape[1]
        bucket = np.floor(held @ self.directions / self.width).astype(np.int64) % self.spread
        cell = bucket + self.spread * np.arange(tables)
        chosen = np.zeros((len(held), self.spread * tables), dtype=bool)
        np.put_along_axis(chosen, cell, True, axis=1)
        return chosen


def lsh(
    chunks: DataFrame,
    questions: DataFrame,
    projections: Projections,
    k: int = 5,
    metric: str = "cosine",
    key: str = "key",
    question: str = "question_id",
    vector: str = "embedding",
) -> DataFrame:
    """k best chunks among those sharing a bucket with the question."""
    dim, tables = projections.directions.shape
    held = pack(chunks, key, vector, projections.choose, metric, dim)
    asked = Asked(questions, question, vector, metric, dim, projections.choose, tables)
    found = compare_blocks(held, asked, k, key, distinct=True)
    once = found.groupBy(question, key).agg(F.max("score").alias("score"))
    return top_k(once, k, question, key)


def attach_fields(hits: DataFrame, chunks: DataFrame, key: str = "key") -> DataFrame:
    """Hits with the stored columns of their chunks, by one join."""
    return hits.join(chunks, key)
