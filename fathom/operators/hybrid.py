"""Vector and full-text hits for mixed questions, merged and reranked.

Tables
    questions(question_id, question, search_type, embedding)
    chunks(key, text, embedding, ...)
    hits(question_id, key, score, rank, source, source_order)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from fathom.functions.columns import round_nearest
from fathom.functions.text import standard
from fathom.hooks import HashedEmbedding
from fathom.operators import fulltext, knn
from fathom.operators.joins import BROADCAST_ROWS, checked
from fathom.operators.ranking import ranked

# Codes of the search types and the labels a user picks. Fixed values.
VECTOR, FULLTEXT, HYBRID = "vector", "fulltext", "hybrid"
CODES = {"VEC": VECTOR, "FT": FULLTEXT}
LABELS = {"vector only": "VEC", "fulltext only": "FT"}
DEFAULT_CODE = "VEC_FT"
# Range of the reranker's raw scores and digits of the normalised ones.
LOGIT_RANGE = 10
NORMAL_DIGITS = 4

PairScore = Callable[[Column, Column], Column]


def search_type(code: Column) -> Column:
    """Known codes pick one branch; anything else means both."""
    return (
        F.when(code == "VEC", VECTOR).when(code == "FT", FULLTEXT).otherwise(HYBRID)
    )


def code_of_label(label: Column) -> Column:
    return (
        F.when(label == "vector only", LABELS["vector only"])
        .when(label == "fulltext only", LABELS["fulltext only"])
        .otherwise(DEFAULT_CODE)
    )


def valid_questions(questions: DataFrame) -> DataFrame:
    return questions.where(F.length("question") > 0)


def route(questions: DataFrame, branch: str) -> DataFrame:
    """Questions that take the given branch."""
    return questions.where(search_type(F.col("search_type")).isin(branch, HYBRID))


def union_hits(vector_hits: DataFrame, text_hits: DataFrame) -> DataFrame:
    """All vector hits, then all full-text hits; a chunk found by both stays
    twice."""
    columns = ["question_id", "key", "score", "rank"]

    def marked(hits: DataFrame, source: str, order: int) -> DataFrame:
        return hits.select(
            *columns, F.lit(source).alias("source"), F.lit(order).alias("source_order")
        )

    return marked(vector_hits, VECTOR, 0).unionByName(marked(text_hits, FULLTEXT, 1))


def overlap_logit(question: Column, context: Column) -> Column:
    """Stand-in for a reranking model: share of the question's distinct words
    found in the context, on the model's -10 to 10 scale."""
    asked = F.array_distinct(standard(question))
    shared = F.size(F.array_intersect(asked, standard(context)))
    share = shared / F.nullif(F.size(asked), F.lit(0))
    return F.coalesce(share, F.lit(0.0)) * (2 * LOGIT_RANGE) - LOGIT_RANGE


def normalize_score(logit: Column) -> Column:
    """[-10, 10] to [0, 1] with four digits, ties to the even digit."""
    return round_nearest((logit + LOGIT_RANGE) / (2 * LOGIT_RANGE), NORMAL_DIGITS)


def rerank(candidates: DataFrame, scorer: PairScore = overlap_logit) -> DataFrame:
    """Replace the index score by the pair score and reorder. Candidates with
    equal scores keep the order they came in; the old score stays in
    `index_score`."""
    scored = candidates.withColumn("index_score", F.col("score")).withColumn(
        "score", normalize_score(scorer(F.col("question"), F.col("text")))
    )
    return ranked(
        scored.withColumnRenamed("rank", "source_rank"),
        [F.desc("score"), F.asc("source_order"), F.asc("source_rank")],
    )


def keep_order(candidates: DataFrame) -> DataFrame:
    """Candidates in the order of the union."""
    return ranked(
        candidates.withColumn("index_score", F.col("score")).withColumnRenamed("rank", "source_rank"),
        [F.asc("source_order"), F.asc("source_rank")],
    )


def drop_repeats(hits: DataFrame) -> DataFrame:
    """First occurrence of each chunk per question."""
    first = F.min(F.struct("source_order", "rank", "score", "source")).alias("first")
    return hits.groupBy("question_id", "key").agg(first).select("question_id", "key", "first.*")


def search_branches(
    chunks: DataFrame,
    index: fulltext.TextIndex,
    questions: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    cells: knn.Cells | None = None,
    embedding: HashedEmbedding | None = None,
) -> DataFrame:
    """Union of the hits of both branches, each for the questions routed to it. With
    `embedding`, questions that go by vector are embedded here."""
    asked = valid_questions(questions)
    by_vector = route(asked, VECTOR)
    if embedding is not None:
        by_vector = embedding.embed(by_vector, "question")
    vector_hits = knn.exact(chunks, by_vector, k, metric, cells=cells)
    text_hits = fulltext.bm25_top_k(index, route(asked, FULLTEXT), k)
    return union_hits(vector_hits, text_hits)


# A table of chunk texts, or what gives one for some hits.
Texts = DataFrame | Callable[[DataFrame], DataFrame]


def with_texts(hits: DataFrame, questions: DataFrame, texts: Texts, k: int = 5) -> DataFrame:
    """Hits with their question and chunk text.

    There are at most 2k hits per question, so a number of questions that is
    checked for that many rows bounds them; then the hits, without the question
    texts, are broadcast and the chunk texts stay put."""
    asked = checked(questions.select("question_id", "question"), max(1, BROADCAST_ROWS // (2 * k)))
    held = texts if isinstance(texts, DataFrame) else texts(hits)
    found = held.select("key", "text").join(asked.hint(hits), "key")
    return found.join(asked.side, "question_id")


def contexts(
    hits: DataFrame,
    questions: DataFrame,
    texts: Texts,
    k: int = 5,
    reranking: bool = True,
    scorer: PairScore = overlap_logit,
    dedupe: bool = False,
) -> DataFrame:
    """question_id, question, key, text, score, index_score, source, rank of the k
    best of the hits of both branches."""
    candidates = with_texts(drop_repeats(hits) if dedupe else hits, questions, texts, k)
    ordered = rerank(candidates, scorer) if reranking else keep_order(candidates)
    return ordered.where(F.col("rank") <= k).select(
        "question_id", "question", "key", "text", "score", "index_score", "source", "rank"
    )


def search(
    chunks: DataFrame,
    index: fulltext.TextIndex,
    questions: DataFrame,
    texts: DataFrame | None = None,
    k: int = 5,
    metric: str = "cosine",
    reranking: bool = True,
    scorer: PairScore = overlap_logit,
    dedupe: bool = False,
    cells: knn.Cells | None = None,
    embedding: HashedEmbedding | None = None,
) -> DataFrame:
    """question_id, question, key, text, score, index_score, source, rank of
    the k best chunks per question. The pair scorer sees at most 2k chunks per
    question. `texts` holds key and text where `chunks` holds vectors only."""
    hits = search_branches(chunks, index, questions, k, metric, cells, embedding)
    return contexts(hits, questions, chunks if texts is None else texts, k, reranking, scorer, dedupe)


def return_fields(hits: DataFrame, fields: list[str]) -> DataFrame:
    """Chosen payload columns and the score; the rest is never read."""
    return hits.select(*fields, "score")
