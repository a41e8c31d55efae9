"""Merkle manifest of a table: one digest for all rows, with a proof for each.

Each row is a leaf, the digest of its columns. The leaves of a tree (such as a
source) ascend by key; every FANOUT consecutive nodes, the last run fewer, become
the digest of their digests until one is left, the tree's root. These, in order of
the trees' names, become the root of all alike. Digests are SHA-256 over
concatenated inputs, digests as lower-case hex text.

Built levels are stored as node rows linked to their parents, each with its
siblings before and after. A recursive query ascends from every leaf: a step joins
the node, appends its siblings to the proof as a row of the step, and folds the
digest it was given with them; what a leaf's climb ends in is compared with the
root. So a leaf that was tampered with is found by its own climb, which reads the
stored siblings only.

No node is met by an unbounded number of leaves: leaves are dealt to covers of
COVER consecutive ones of a tree, and a node above several covers is stored once
for each, so a join key has COVER rows at most. Places of leaves come from sums over
ranges, not from one sort; levels shrink by FANOUT, and each is written.

Defined cases: a null column is `-`, so it differs from an empty text; a null key
comes first in its tree and a null name is a tree of its own, before all others;
rows with one key are ordered by their leaves, and equal rows are leaves of their
own, each with its row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fathom.llm.ordered import positions
from fathom.operators.joins import checked
from fathom.session import settled

FANOUT = 3
# Levels below the nodes that are stored once a cover.
COVER_LEVELS = 8
COVER = FANOUT**COVER_LEVELS
# The tree of the trees' roots.
TOP = -1
# Rows of a level in one file, about.
LEVEL_ROWS = 1 << 17
# Trees (about 50 bytes each) that are sent to every executor at most; the rows of
# more are exchanged.
TREES = 100_000


def item(column: Column) -> Column:
    """A value with its length, so that neighbours can't be shifted; `-` if null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(item, columns)), 256)


def digest(children: Column) -> Column:
    """Digest of an array of digests."""
    return F.sha2(F.array_join(children, ""), 256)


def _levels(nodes: DataFrame, total: int, largest: int) -> tuple[DataFrame | None, DataFrame, int]:
    """Of nodes (tree, idx, hash, n), `total` in trees of n, `largest` at most: runs
    (tree, level, idx, hash, children) of all levels above, what is left of each tree
    (tree, hash, height), and the number of levels. How many nodes a tree has on a
    level follows from n, so a level takes one grouping."""
    left = lambda rows, height: rows.where("n = 1").select("tree", "hash", F.lit(height).alias("height"))
    built: list[DataFrame] = []
    roots = [left(nodes, 0)]
    while largest > 1:
        level = len(built)
        runs = (
            nodes.where("n > 1")
            .groupBy("tree", F.floor(F.col("idx") / FANOUT).alias("idx"))
            .agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("children"), F.min("n").alias("n"))
            .withColumn("children", F.col("children.hash"))
            .select(
                "tree",
                F.lit(level).alias("level"),
                "idx",
                digest(F.col("children")).alias("hash"),
                "children",
                F.ceil(F.col("n") / FANOUT).alias("n"),
            )
        )
        total, largest = -(-total // FANOUT), -(-largest // FANOUT)
        # Levels shrink, and so does the number of their files.
        built.append(settled(runs.coalesce(1 + total // LEVEL_ROWS), "level"))
        nodes = built[-1].select("tree", "idx", "hash", "n")
        roots.append(left(nodes, level + 1))
    above = reduce(DataFrame.unionByName, built) if built else None
    return above, reduce(DataFrame.unionByName, roots), len(built)


def _named(tree: Column, level: Column, idx: Column) -> Column:
    return F.concat_ws(".", tree, level, idx)


def _top(tree: Column) -> Column:
    """Name of a tree's root, which is a leaf of the top tree."""
    return _named(F.lit(TOP), F.lit(0), tree)


def _nodes(runs: DataFrame) -> DataFrame:
    """The children of the runs: (tree, level, idx, parent, before, after)."""
    rows = runs.select(
        "tree", "level", "children", F.col("idx").alias("run"), F.posexplode("children").alias("at", "own")
    )
    pieces = lambda a: F.unhex(F.array_join(a, ""))
    return rows.select(
        "tree",
        "level",
        (F.col("run") * FANOUT + F.col("at")).alias("idx"),
        _named(F.col("tree"), F.col("level") + 1, F.col("run")).alias("parent"),
        pieces(F.slice("children", F.lit(1), F.col("at"))).alias("before"),
        pieces(F.slice("children", F.col("at") + 2, F.lit(FANOUT))).alias("after"),
    )


def _power(exponent: Column) -> Column:
    return F.pow(F.lit(float(FANOUT)), exponent)


def _cover(tree: Column, number: Column) -> Column:
    return F.concat_ws(".", tree, number)


def _covered(below: DataFrame, trees: DataFrame) -> DataFrame:
    """Nodes of the trees once for each cover of leaves below them: (cover, node,
    parent, before, after). `trees` has (tree, covers, height)."""
    span = _power(F.greatest(F.col("level") - COVER_LEVELS, F.lit(0))).cast("long")
    # First cover below a node, which stands over several or within one.
    within = F.floor(F.col("idx") / _power(F.lit(COVER_LEVELS) - F.col("level")))
    low = F.when(F.col("level") >= COVER_LEVELS, F.col("idx") * span).otherwise(within).cast("long")
    nodes = below.join(trees, "tree").withColumn("low", low)
    nodes = nodes.withColumn("number", F.explode(F.sequence("low", F.least(F.col("low") + span, F.col("covers")) - 1)))
    nodes = nodes.withColumn(
        "parent", F.when(F.col("level") + 1 == F.col("height"), _top(F.col("tree"))).otherwise(F.col("parent"))
    )
    return nodes.withColumn("cover", _cover(F.col("tree"), F.col("number"))).select(*_node())


def _node() -> list:
    name = _named(F.col("tree"), F.col("level"), F.col("idx"))
    return ["cover", name.alias("node"), "parent", "before", "after"]


def _over_covers(above: DataFrame, trees: DataFrame, levels: int) -> DataFrame:
    """Nodes of the top tree, which has `levels` levels, once for each cover below
    them: they stand over whole trees, by their numbers."""
    over = trees.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("covers") - 1)))
    over = over.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    over = over.select(
        _cover(F.col("tree"), F.col("number")).alias("cover"),
        "level",
        F.floor(F.col("tree") / _power(F.col("level"))).cast("long").alias("idx"),
    )
    return above.join(over, ["level", "idx"]).select(*_node())


CLIMB = """
WITH RECURSIVE climb(leaf, cover, step, node, siblings, folded) AS (
    SELECT leaf, cover, step, node, siblings, folded FROM {leaves}
    UNION ALL
    SELECT c.leaf, c.cover, c.step + 1, n.parent, concat(n.before, n.after),
        unhex(sha2(lower(concat(hex(n.before), hex(c.folded), hex(n.after))), 256))
    FROM climb c JOIN {nodes} n ON n.cover = c.cover AND n.node = c.node
)
SELECT leaf, step, siblings, CASE WHEN node = :root THEN folded END AS folded FROM climb
"""


def _climbed(leaves: DataFrame, nodes: DataFrame, root: str, files: int) -> DataFrame:
    """(leaf, step, siblings, folded): a row for each leaf and step, the last with what
    the climb ends in. `leaves` has the steps that were made already."""
    spark = leaves.sparkSession
    # As many rows as there are leaves and levels, so the guard against endless
    # recursion by rows has to go; the one by levels stays.
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        climbed = spark.sql(CLIMB, args={"root": root}, leaves=leaves, nodes=nodes)
        return settled(climbed.coalesce(files), "climb")
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def manifest(
    docs: DataFrame,
    columns: Sequence[str],
    key: str = "doc_id",
    tree: str = "source",
    tamper: Mapping[str, Column] | None = None,
) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified): of every row
    the stored digests, the digest of its proof, and the root that its climb ends in
    when some columns are replaced by others (`tamper`) after the manifest was made."""
    now = [(tamper or {}).get(c, F.col(c)) for c in columns]
    rows = docs.select(
        F.col(key).alias("key"),
        F.col(tree).cast("string").alias("name"),
        leaf([F.col(c) for c in columns]).alias("hash"),
        leaf(now).alias("now"),
    )
    rows = settled(positions(rows, ["name"], ["key", "hash", "now"], "leaves"), "leaves")
    trees = rows.groupBy("name").agg(F.count("*").alias("n"), F.ceil(F.count("*") / COVER).alias("covers"))
    trees = positions(trees.withColumn("all", F.lit(0)), ["all"], ["name"], "trees").drop("all")
    trees = settled(trees.withColumnRenamed("idx", "tree"), "trees")
    sizes = trees.agg(F.count("*").alias("trees"), F.sum("n").alias("n"), F.max("n").alias("largest")).first()
    few = checked(trees, TREES)
    named = few.hint(trees.select(F.col("name").alias("_name"), "tree", "n"))
    rows = rows.join(named, F.col("name").eqNullSafe(F.col("_name"))).select("key", "hash", "now", "idx", "tree", "n")

    below, subroots, height = _levels(rows.select("tree", "idx", "hash", "n"), sizes["n"] or 0, sizes["largest"] or 0)
    subroots = settled(subroots.coalesce(1 + sizes["trees"] // LEVEL_ROWS), "subroots")
    over = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "hash")
    over = over.withColumn("n", F.lit(sizes["trees"]))
    above, tops, levels = _levels(over, sizes["trees"], sizes["trees"])
    top = tops.first()
    root = top["hash"] if top is not None else ""
    trees = settled(trees.join(few.hint(subroots.select("tree", "height")), "tree").select("tree", "covers", "height"), "trees")
    # Two thirds of the nodes are leaves, met in the first step only: the others are what
    # every further step of the climb exchanges.
    parts = [] if below is None else [_covered(_nodes(below.where("level > 0")), few.hint(trees))]
    parts += [] if above is None else [_over_covers(_nodes(above), trees, levels)]
    empty = docs.sparkSession.createDataFrame([], "cover string, node string, parent string, before binary, after binary")
    # A tree has half as many nodes above its leaves as it has leaves.
    files = 1 + 3 * (sizes["n"] or 0) // (2 * LEVEL_ROWS)
    nodes = settled(reduce(DataFrame.unionByName, parts or [empty]).coalesce(files), "nodes")

    leaves = rows.join(few.hint(subroots.withColumnRenamed("hash", "subroot")), "tree")
    leaves = leaves.withColumn("leaf", F.monotonically_increasing_id())
    leaves = leaves.withColumn("cover", _cover(F.col("tree"), F.floor(F.col("idx") / COVER)))
    own = _named(F.col("tree"), F.lit(0), F.col("idx"))
    leaves = leaves.withColumn("node", F.when(F.col("height") == 0, _top(F.col("tree"))).otherwise(own))
    leaves = settled(leaves.select("leaf", "key", "hash", "subroot", "cover", "node", F.unhex("now").alias("folded")), "numbered")
    steps = height + levels + 1
    files = 1 + steps * (sizes["n"] or 0) // LEVEL_ROWS
    nothing = F.unhex(F.lit(""))
    begun = leaves.select("leaf", "cover", F.lit(0).alias("step"), "node", nothing.alias("siblings"), "folded")
    if below is not None:
        met = leaves.join(_covered(_nodes(below.where("level = 0")), few.hint(trees)), ["cover", "node"])
        text = F.concat(F.hex("before"), F.hex("folded"), F.hex("after"))
        folded = F.unhex(F.sha2(F.lower(text), 256))
        siblings = F.concat("before", "after")
        met = met.select("leaf", "cover", F.lit(1).alias("step"), F.col("parent").alias("node"), siblings.alias("siblings"), folded.alias("folded"))
        begun = begun.unionByName(settled(met.coalesce(1 + (sizes["n"] or 0) // LEVEL_ROWS), "met"))
    climbed = _climbed(begun, nodes, f"{TOP}.{levels}.0", files)

    steps = F.sort_array(F.collect_list(F.struct("step", "siblings")))
    proofs = climbed.groupBy("leaf").agg(steps.alias("steps"), F.max("folded").alias("folded"))
    siblings = F.transform("steps", lambda s: F.lower(F.hex(s["siblings"])))
    proofs = proofs.select(
        "leaf",
        F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        F.lower(F.hex("folded")).alias("folded_root"),
    )
    return leaves.select("leaf", "key", "hash", "subroot").join(proofs, "leaf").select(
        F.col("key").alias(key),
        F.col("hash").alias("leaf"),
        "subroot",
        F.lit(root).alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )
