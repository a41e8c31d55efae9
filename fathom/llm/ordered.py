"""Global order without one task that sorts everything: ranges of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathom.session import settled

# Ranges at most, so that their first keys stay small on the driver.
MOST_RANGES = 1 << 16
# Rows of a range that holds small rows only.
RANGE_ROWS = 1 << 17


def range_starts(keys: DataFrame, key: str, ranges: int) -> list[str]:
    """The least key of each of about `ranges` (MOST_RANGES at most) even ranges of a
    string column that sorts by bytes."""
    ranges = max(1, min(ranges, MOST_RANGES))
    dealt = keys.select(key).repartitionByRange(ranges, key).groupBy(F.spark_partition_id().alias("part"))
    return sorted(row["first"] for row in dealt.agg(F.min(key).alias("first")).collect())


def range_of(key: Column, starts: Sequence[str]) -> Column:
    """Number of the range a key lies in, by bisection; 0 below the first start."""
    bounds = F.split(F.lit(",".join(starts)), ",")
    steps = max(len(starts) - 1, 1).bit_length()

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        right = F.get(bounds, middle) <= key
        return F.struct(
            F.when(right, middle).otherwise(acc["low"]).alias("low"),
            F.when(right, acc["high"]).otherwise(middle).alias("high"),
        )

    begin = F.struct(F.lit(0).alias("low"), F.lit(len(starts)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, halve, lambda acc: acc["low"])


def positions(rows: DataFrame, group: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """The rows with `idx`, their place from 0 within the group. A group may hold any
    share of the rows: ranges of it are numbered each, from sums over the ranges
    before. The rows must be small, as they are written once."""
    cuts = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    dealt = rows.repartitionByRange(ranges, *cuts).withColumn("part", F.spark_partition_id())
    dealt = settled(dealt, label)
    counts = dealt.groupBy(*group, "part").agg(F.count("*").alias("held"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    counts = settled(counts.select(*(F.col(c).alias(f"_{c}") for c in (*group, "part")), "before"), label)
    same = F.lit(True)
    for c in (*group, "part"):
        same = same & dealt[c].eqNullSafe(counts[f"_{c}"])
    inside = Window.partitionBy(*group, "part").orderBy(*(F.col(c).asc_nulls_first() for c in order))
    numbered = dealt.withColumn("idx", F.row_number().over(inside) - 1)
    return (
        numbered.join(counts, same)
        .withColumn("idx", (F.col("idx") + F.col("before")).cast("long"))
        .select(*rows.columns, "idx")
    )
