"""Top-k with a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Scores are rounded before they are compared, as summation order differs
# between runs.
SCORE_DIGITS = 6


def top_k(
    scored: DataFrame,
    k: int,
    group: str = "question_id",
    key: str = "key",
    score: str = "score",
    digits: int = SCORE_DIGITS,
) -> DataFrame:
    """Best k rows per group by rounded score, then key, with their rank.

    A rank filter right above the window lets Spark keep k rows per group and
    partition before the exchange, so a hot group never meets in one task."""
    rounded = scored.withColumn(score, F.round(score, digits))
    return ranked(rounded, [F.desc(score), F.asc(key)], group).where(F.col("rank") <= k)


def ranked(rows: DataFrame, order: Sequence[Column], group: str = "question_id") -> DataFrame:
    window = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window))
