"""Exact match and token F1 of ranked answers, as in the public SQuAD scorer.

predictions(qid, rank, answer), gold(qid, answers array<string>)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathom.functions.metrics import answer_tokens, exact_match, token_f1


def score_answers(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """qid, rank, em, f1. Answers are split into tokens once each, before the
    one join on qid; both metrics are worked out inside the joined row."""
    asked = predictions.select("qid", "rank", answer_tokens(F.col("answer")).alias("tokens"))
    known = gold.select("qid", F.transform("answers", answer_tokens).alias("golds"))
    return asked.join(known, "qid").select(
        "qid",
        "rank",
        exact_match(F.col("tokens"), F.col("golds")).alias("em"),
        token_f1(F.col("tokens"), F.col("golds")).alias("f1"),
    )


def score_exact(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """qid, rank, em."""
    return score_answers(predictions, gold).select("qid", "rank", "em")


def score_f1(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """qid, rank, f1."""
    return score_answers(predictions, gold).select("qid", "rank", "f1")


def best_within(scores: DataFrame, k: int) -> DataFrame:
    """qid, em, f1: best over the first k answers."""
    return (
        scores.where(F.col("rank") <= k)
        .groupBy("qid")
        .agg(F.max("em").alias("em"), F.max("f1").alias("f1"))
    )


def report(scores: DataFrame, k: int = 5, method: str = "method") -> DataFrame:
    """Per method: em, f1, em_at_k, f1_at_k as percentages over its questions."""
    first = F.col("rank") == 1
    per_question = scores.groupBy(method, "qid").agg(
        F.max(F.when(first, F.col("em"))).alias("em"),
        F.max(F.when(first, F.col("f1"))).alias("f1"),
        F.max(F.when(F.col("rank") <= k, F.col("em"))).alias("em_at_k"),
        F.max(F.when(F.col("rank") <= k, F.col("f1"))).alias("f1_at_k"),
    )
    return per_question.groupBy(method).agg(
        *[
            (100 * F.avg(F.coalesce(F.col(name), F.lit(0)))).alias(name)
            for name in ("em", "f1", "em_at_k", "f1_at_k")
        ]
    )
