"""A named corpus stored as Parquet, written by key.

A collection is a log of writes. The base holds every key once, in folders by a
hash bucket of the key; a later write adds one batch, sorted by bucket, and one log
entry that names the buckets it touches. Only logged batches are read, so a write
that fails in the middle leaves the collection as it was. Reading keeps the last
write of every key: buckets that no batch touches are read as they lie; of the
others only rows whose keys are pending meet the batches, and the rest pass by a
filter of the pending keys. `compact` folds the batches into new folders of the
touched buckets; the others stay where they are. Folders that the log has not named
since the compaction before are removed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fathom.operators.joins import BROADCAST_ROWS, checked
from fathom.session import settled

BUCKETS = 64
# Batches since the last base after which an upsert compacts.
COMPACT_AFTER = 32
# `layout` names the folder of every bucket of the base, where there is a new one.
LOG = (
    "entry int, batch string, layout map<int,string>, touched array<int>, "
    "key string, seq string, replaces string, buckets int, shape string"
)


def latest_per_key(rows: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The row with the highest seq of every key; of rows with one seq that with
    the largest hash. Repeats of a key collapse before the exchange."""
    newest = F.max_by(F.struct(*rows.columns), F.struct(seq, F.xxhash64(*rows.columns))).alias("row")
    return rows.groupBy(key).agg(newest).select("row.*")


def merged(stored: DataFrame, incoming: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """State after an upsert: last write per key wins."""
    return latest_per_key(stored.unionByName(incoming), key, seq)


class DuplicateKey(ValueError):
    """A strict insert met a key that is already there."""


def insert_strict(stored: DataFrame, incoming: DataFrame, key: str = "key") -> DataFrame:
    """stored plus incoming; fails when a key exists or repeats."""
    repeated = incoming.groupBy(key).count().where("count > 1")
    keys = checked(incoming.select(key))
    known = stored.select(key).join(keys.side, key, "left_semi")
    if repeated.limit(1).count() or known.limit(1).count():
        raise DuplicateKey(f"{key} already present")
    return stored.unionByName(incoming)


@dataclass(frozen=True)
class State:
    """What the log says: the folder of each bucket that holds rows, the batches
    since with the buckets they touch, and the next entry."""

    layout: dict[int, str] | None
    batches: tuple[tuple[str, tuple[int, ...]], ...]
    entry: int
    shape: T.StructType | None

    @property
    def touched(self) -> set[int]:
        return {bucket for _, buckets in self.batches for bucket in buckets}


@dataclass
class Collection:
    """Rows by key; the highest `seq` wins, so a replayed write changes nothing.

    With `replaces`, a column such as a page id, a newer write of a page drops the
    page's older rows even where their keys do not come again; rows whose page is
    null go by their keys only. How a collection was created is kept in its log:
    opening it later needs the path only, and other settings are refused."""

    spark: SparkSession
    path: str
    key: str | None = None
    seq: str | None = None
    buckets: int | None = None
    schema: T.StructType | None = None
    replaces: str | None = None
    compact_after: int = COMPACT_AFTER
    # Pending rows up to which their keys are sent to the base.
    pending_rows: int = BROADCAST_ROWS

    def __post_init__(self) -> None:
        entries = self._log()
        first = entries[0] if entries else None
        for name, usual in (("key", "key"), ("seq", "seq"), ("buckets", BUCKETS), ("replaces", None)):
            asked, kept = getattr(self, name), first[name] if first else None
            if first and asked is not None and asked != kept:
                raise ValueError(f"{name} of this collection is {kept}, not {asked}")
            setattr(self, name, kept if first else usual if asked is None else asked)

    # ---- the log ---------------------------------------------------------

    def _log(self) -> list:
        """Entries in order; compaction removes those before the last base."""
        try:
            rows = self.spark.read.schema(LOG).parquet(f"{self.path}/log/*").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(rows, key=lambda row: row["entry"])

    def state(self) -> State:
        layout, batches, entries = None, [], self._log()
        for row in entries:
            if row["layout"] is not None:
                layout, batches = row["layout"], []
            else:
                batches.append((row["batch"], tuple(row["touched"])))
        shape = T.StructType.fromJson(json.loads(entries[-1]["shape"])) if entries else None
        return State(layout, tuple(batches), entries[-1]["entry"] + 1 if entries else 0, shape)

    def _add_entry(self, entry: int, batch: str, layout: dict | None, touched: Iterable[int], shape: T.StructType) -> None:
        settings = (self.key, self.seq, self.replaces, self.buckets, shape.json())
        line = [(entry, batch, layout, sorted(touched), *settings)]
        # Fails if another writer has taken this entry.
        self.spark.createDataFrame(line, LOG).coalesce(1).write.parquet(f"{self.path}/log/{entry:012d}")

    # ---- files -----------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _held(self, folder: str, shape: T.StructType) -> list[int]:
        """Buckets with rows in what was just written; their number is fixed."""
        shape = T.StructType([*shape.fields, T.StructField("_bucket", T.IntegerType())])
        rows = self.spark.read.schema(shape).parquet(folder)
        return [row[0] for row in rows.select("_bucket").distinct().collect()]

    def _write_base(self, rows: DataFrame, state: State, buckets: set[int] | None = None) -> None:
        """Rows, all of the given buckets or of all, as the base of these. Rebalancing
        makes files of an even size for each bucket."""
        batch = uuid.uuid4().hex
        folder = f"{self.path}/batches/{batch}"
        dealt = rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket")
        dealt.write.partitionBy("_bucket").parquet(folder)
        kept = {} if buckets is None else {b: f for b, f in (state.layout or {}).items() if b not in buckets}
        held = self._held(folder, rows.schema)
        self._add_entry(state.entry, batch, kept | dict.fromkeys(held, batch), [], rows.schema)

    def _write_batch(self, rows: DataFrame, state: State) -> None:
        """One batch in files of an even size, one if it is small, sorted by bucket."""
        batch = uuid.uuid4().hex
        folder = f"{self.path}/batches/{batch}"
        dealt = rows.withColumn("_bucket", self._bucket()).hint("rebalance")
        dealt.sortWithinPartitions("_bucket").write.parquet(folder)
        self._add_entry(state.entry, batch, None, self._held(folder, rows.schema), rows.schema)

    def _folders(self, state: State, buckets: Iterable[int]) -> DataFrame | None:
        """Rows of some buckets of the base."""
        layout = state.layout or {}
        paths = [f"{self.path}/batches/{layout[b]}/_bucket={b}" for b in sorted(buckets) if b in layout]
        return self.spark.read.parquet(*paths) if paths else None

    def _pending(self, state: State) -> DataFrame:
        paths = [f"{self.path}/batches/{batch}" for batch, _ in state.batches]
        return self.spark.read.parquet(*paths).drop("_bucket")

    # ---- reading ---------------------------------------------------------

    def parts(self) -> tuple[DataFrame | None, list[DataFrame]]:
        """The rows of the collection in parts that are read in different ways: those
        of buckets that no batch touches, and of the others those that no pending key
        meets, then the last writes of the pending keys."""
        return self._parts(self.state())

    def _parts(self, state: State) -> tuple[DataFrame | None, list[DataFrame]]:
        layout = set(state.layout or ())
        if not state.batches:
            return self._folders(state, layout), []
        pending = self._pending(state)
        # A page's older rows may lie in any bucket.
        touched = layout if self.replaces else state.touched & layout
        quiet, base = self._folders(state, layout - touched), self._folders(state, touched)
        keys = checked(pending.select(self.key), self.pending_rows)
        if base is None:
            changed = [latest_per_key(pending, self.key, self.seq)]
        elif keys.small:
            met = base.join(keys.side, self.key, "left_semi")
            changed = [base.join(keys.side, self.key, "left_anti"), merged(met, pending, self.key, self.seq)]
        else:
            changed = [merged(base, pending, self.key, self.seq)]
        if self.replaces:
            changed = self._newest_pages(changed, keys.small)
        return quiet, changed

    def _newest_pages(self, parts: list[DataFrame], small: bool) -> list[DataFrame]:
        """Without rows of a page that has newer ones. In the base all rows of a page
        are of one write, so only the pages of the pending rows are looked up."""
        page, seq = self.replaces, self.seq
        per_page = lambda rows: rows.where(F.col(page).isNotNull()).groupBy(page).agg(F.max(seq).alias("_newest"))
        if len(parts) == 1:
            return [_not_older(parts[0], per_page(parts[0]), page, seq)]
        quiet, changed = parts
        written = per_page(changed)
        # Pages are as many as pending rows at most.
        there = F.broadcast(written) if small else written
        again = per_page(quiet.join(there.select(page), page, "left_semi"))
        changed = _not_older(_not_older(changed, written, page, seq), again, page, seq)
        return [_not_older(quiet, there, page, seq), changed]

    def scan(self) -> DataFrame:
        """The last write of every key. A collection opened with a schema counts
        as empty until its first write."""
        state = self.state()
        if state.shape is None and self.schema is None:
            raise ValueError(f"no collection at {self.path}")
        quiet, changed = self._parts(state)
        found = ([] if quiet is None else [quiet]) + changed
        if not found:
            return self.spark.createDataFrame([], state.shape or self.schema)
        return reduce(DataFrame.unionByName, found)

    # ---- writing ---------------------------------------------------------

    def _resolved(self, rows: DataFrame) -> DataFrame:
        latest = latest_per_key(rows, self.key, self.seq)
        return latest if self.replaces is None else self._newest_pages([latest], False)[0]

    def create(self, rows: DataFrame) -> None:
        state = self.state()
        if state.entry:
            raise ValueError(f"there is a collection at {self.path}")
        self._write_base(self._resolved(rows), state)

    def insert(self, rows: DataFrame) -> None:
        """Append rows with new keys; fails on a known or repeated key."""
        rows = settled(rows, "insert")
        insert_strict(self.scan(), rows, self.key)
        self._write_batch(rows, self.state())

    def upsert(self, rows: DataFrame) -> None:
        """Add rows as one batch; stored files stay as they are."""
        self._write_batch(latest_per_key(rows, self.key, self.seq), self.state())
        if len(self.state().batches) >= self.compact_after:
            self.compact()

    def compact(self) -> None:
        """Fold the batches into new folders of the buckets they touch; others stay
        as they lie. Readers of what is folded go on: folders go at the compaction
        after the one that replaced them."""
        before, state = self._log(), self.state()
        if not state.batches:
            return
        quiet, changed = self._parts(state)
        whole = self.replaces is not None or state.layout is None
        self._write_base(reduce(DataFrame.unionByName, changed), state, None if whole else state.touched)
        self._remove_unnamed(before)

    def _remove_unnamed(self, before: list) -> None:
        """Entries before the base that was in force until now, and folders that no
        entry since names."""
        bases = [row for row in before if row["layout"] is not None]
        if not bases:
            return
        first = bases[-1]["entry"]
        entries = self._log()
        named = {f for row in entries if row["entry"] >= first for f in [row["batch"], *(row["layout"] or {}).values()]}
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = files.Path(self.path)
        store = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        # The log first: what it does not name is never read.
        for row in entries:
            if row["entry"] < first:
                store.delete(files.Path(f"{self.path}/log/{row['entry']:012d}"), True)
        for row in entries:
            folders = [row["batch"], *(row["layout"] or {}).values()]
            for folder in set(folders) - named:
                store.delete(files.Path(f"{self.path}/batches/{folder}"), True)


def _not_older(rows: DataFrame, newest: DataFrame, page: str, seq: str) -> DataFrame:
    """Rows but those whose page has a newer seq; rows of no page stay."""
    newest = newest.withColumnRenamed(page, "_page")
    joined = rows.join(newest, rows[page] == newest["_page"], "left")
    stay = F.col("_newest").isNull() | F.coalesce(F.col(seq) >= F.col("_newest"), F.lit(False))
    return joined.where(stay).select(*(rows[c] for c in rows.columns))
