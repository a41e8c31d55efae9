"""Mixing sources to target weights over a tree, in whole tokens.

The tree's levels are columns, such as domain, language, source; each child of a
node has a whole weight, 1 unless given. A node's budget is shared among its
children by weight. A child's capacity is what its leaves hold, times the epochs
allowed; where a share is above it, the child gets its capacity and the shortage
goes to its siblings by weight. As capacities are sums over subtrees, a shortage
is met by siblings first, and reaches an ancestor's other children only when a
whole subtree is used up. Shares are whole tokens, rounded down.

A leaf with target T and A tokens takes every document T div A times, and of the
next epoch, a permutation seeded by its number, the longest prefix with at most
T mod A tokens. The prefix is found from sums over ranges of the permutation; only
documents of the one range where it ends are put in order, so no leaf, however
large, is sorted in one task.

Column expressions only.

Defined cases: a null level is the empty name; a null or empty text has no
tokens; rows with one key in one leaf are taken or left together; a leaf without
tokens is taken no time beyond an empty prefix; an empty table gives no rows;
other columns are kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathom.session import settled

EPOCHS = 2
BUDGET = 60  # hundredths of the tokens there are
SEED = 11
# Hex digits of a permutation key that name its range.
RANGE = 3
TOKEN = r"[^\x20\x09-\x0D]+"

Weights = Mapping[str, Mapping[str, int]]


def tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def _weight(level: str, weights: Weights) -> Column:
    value = F.lit(1)
    for name, w in weights.get(level, {}).items():
        value = F.when(F.col(level) == name, w).otherwise(value)
    return value.cast("decimal(19,0)")


def shares(leaves: DataFrame, levels: Sequence[str], weights: Weights, budget: Column, epochs: int) -> DataFrame:
    """Leaves (levels, tokens) with their target."""
    capacities = leaves.withColumn("room", F.col("tokens").cast("decimal(19,0)") * epochs)
    parents = capacities.agg(budget.cast("decimal(19,0)").alias("budget"))
    for depth, level in enumerate(levels):
        path = list(levels[:depth])
        nodes = capacities.groupBy(*path, level).agg(F.sum("room").cast("decimal(19,0)").alias("room"))
        nodes = nodes.join(parents, path) if path else nodes.crossJoin(F.broadcast(parents))
        nodes = nodes.withColumn("w", _weight(level, weights))
        family = Window.partitionBy(*path)
        order = family.orderBy((F.col("room").cast("double") / F.col("w").cast("double")), level)
        before = F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("full", F.col("room") * left <= F.col("w") * (F.col("budget") - before))
        used = F.sum(F.when(F.col("full"), F.col("room")).otherwise(0)).over(family)
        open_ = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(family)
        nodes = nodes.withColumn("used", used).withColumn("open", open_)
        share = F.expr("(w * (budget - used)) div open").cast("decimal(19,0)")
        parents = nodes.select(*path, level, F.when(F.col("full"), F.col("room")).otherwise(share).alias("budget"))
    return leaves.join(parents, list(levels)).withColumn("target", F.col("budget").cast("long")).drop("budget")


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Weights,
    key: str = "doc_id",
    text: str = "text",
    budget: int = BUDGET,
    epochs: int = EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """(levels, key, n_tokens, target of the leaf, copies) for every key and leaf."""
    names = list(levels)
    rows = docs.select(
        F.col(key).alias("key"),
        *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()),
        tokens(text).alias("n"),
    )
    rows = settled(rows.groupBy(*names, "key").agg(F.sum("n").alias("n")), "mix")
    leaves = rows.groupBy(*names).agg(F.sum("n").alias("tokens"))
    total = F.expr(f"sum(tokens) * {budget} div 100")
    targets = shares(settled(leaves, "leaves"), names, weights, total, epochs)
    some = F.col("tokens") > 0
    targets = targets.withColumn("full", F.when(some, F.expr("target div greatest(tokens, 1)")).otherwise(0))
    targets = targets.withColumn("rest", F.when(some, F.col("target") % F.greatest("tokens", F.lit(1))).otherwise(0))
    targets = settled(targets, "targets")

    placed = rows.join(targets, names).withColumn(
        "place", F.md5(F.concat_ws(":", F.lit(seed), "full", F.coalesce(F.col("key").cast("string"), F.lit(""))))
    )
    placed = placed.withColumn("range", F.substring("place", 1, RANGE))
    ranges = placed.groupBy(*names, "range").agg(F.sum("n").alias("held"))
    running = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = settled(ranges.withColumn("upto", F.sum("held").over(running)), "ranges")
    placed = placed.join(ranges, [*names, "range"])

    whole = placed.where("upto <= rest").withColumn("more", F.lit(1))
    none = placed.where("upto - held > rest").withColumn("more", F.lit(0))
    inside = Window.partitionBy(*names, "range").orderBy("place", "key").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where("upto > rest and upto - held <= rest")
    edge = edge.withColumn("sum", F.sum("n").over(inside) + F.col("upto") - F.col("held"))
    edge = edge.withColumn("more", (F.col("sum") <= F.col("rest")).cast("int")).drop("sum")
    return (
        whole.unionByName(none)
        .unionByName(edge)
        .select(
            F.col("key").alias(key), *names, F.col("n").alias("n_tokens"), "target",
            (F.col("full") + F.col("more")).cast("long").alias("copies"),
        )
    )


def taken(docs: DataFrame, levels: Mapping[str, Column], weights: Weights, key: str = "doc_id", **how) -> DataFrame:
    """The documents of the mix, all columns kept, with how many copies of each; a
    column `copies` of the documents is replaced."""
    chosen = mix(docs, levels, weights, key, **how).where("copies > 0")
    chosen = chosen.select(F.col(key).alias("_key"), *(F.col(n).alias(f"_{n}") for n in levels), "copies")
    # Levels are worked out before the join, under names that the table does not have.
    own = {f"{n}_{'_'.join(docs.columns)}": F.coalesce(c.cast("string"), F.lit("")) for n, c in levels.items()}
    named = docs.withColumns(own)
    same = named[key].eqNullSafe(chosen["_key"])
    for name, level in zip(own, levels):
        same = same & (named[name] == chosen[f"_{level}"])
    return named.join(chosen, same).select(*(named[c] for c in docs.columns if c != "copies"), chosen["copies"])
