"""Retrieval methods compared on one retrieval: by words, by vectors, both reranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fathom.functions.metrics import answer_tokens, exact_match, token_f1
from fathom.operators import evaluate, hybrid, reader
from fathom.operators.ranking import ranked
from fathom.session import settled

# Method: the branches whose hits it takes, and whether they are reranked.
METHODS = {
    "bm25": ((hybrid.FULLTEXT,), False),
    "vector": ((hybrid.VECTOR,), False),
    "bm25_rerank": ((hybrid.FULLTEXT,), True),
    "vector_rerank": ((hybrid.VECTOR,), True),
    "hybrid_rerank": ((hybrid.VECTOR, hybrid.FULLTEXT), True),
}


def method_answers(
    vector_hits: DataFrame,
    text_hits: DataFrame,
    questions: DataFrame,
    texts: hybrid.Texts,
    k: int = 5,
    scorer: hybrid.PairScore = hybrid.overlap_logit,
    read: reader.Reader = reader.lexical_reader,
) -> DataFrame:
    """method, question_id, rank, key, ans. Each pair of a question and a chunk is
    scored and read once, however many methods come upon it; the methods differ only
    in which hits they take and how they order them."""
    hits = settled(hybrid.union_hits(vector_hits, text_hits), "hits")
    pairs = hybrid.with_texts(hits.select("question_id", "key").distinct(), questions, texts, k)
    pairs = reader.read_answers(pairs, read).select(
        "question_id", "key", "ans", hybrid.normalize_score(scorer(F.col("question"), F.col("text"))).alias("pair")
    )
    found = settled(hits.join(pairs, ["question_id", "key"]), "answers")

    def of(method: str, branches: tuple[str, ...], reranking: bool) -> DataFrame:
        order: list[Column] = [F.asc("source_order"), F.asc("source_rank")]
        own = found.where(F.col("source").isin(*branches)).withColumnRenamed("rank", "source_rank")
        own = ranked(own, [F.desc("pair"), *order] if reranking else order).where(F.col("rank") <= k)
        return own.select(F.lit(method).alias("method"), "question_id", "rank", "key", "ans")

    return reduce(DataFrame.unionByName, [of(name, *how) for name, how in METHODS.items()])


def method_report(answers: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """method, em, f1, em_at_k, f1_at_k over all questions of gold(qid, answers)."""
    known = gold.select(F.col("qid").alias("question_id"), F.transform("answers", answer_tokens).alias("golds"))
    guessed = answers.withColumn("tokens", answer_tokens(F.coalesce("ans", F.lit(""))))
    scored = guessed.join(known, "question_id").select(
        "method",
        F.col("question_id").alias("qid"),
        "rank",
        exact_match(F.col("tokens"), F.col("golds")).alias("em"),
        token_f1(F.col("tokens"), F.col("golds")).alias("f1"),
    )
    return evaluate.report(scored, k)
