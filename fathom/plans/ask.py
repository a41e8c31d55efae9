"""From questions to presented answers, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathom.functions import present
from fathom.hooks import HashedEmbedding
from fathom.operators import hybrid, reader
from fathom.operators.fulltext import TextIndex
from fathom.operators.knn import Cells

K = 5


def ask(
    questions: DataFrame,
    chunks: DataFrame,
    index: TextIndex,
    page_info: DataFrame,
    texts: DataFrame | None = None,
    k: int = K,
    reranking: bool = True,
    scorer: hybrid.PairScore = hybrid.overlap_logit,
    read: reader.Reader = reader.lexical_reader,
    page_id: Column | None = None,
    strict: bool = False,
    dedupe: bool = False,
    cells: Cells | None = None,
    embedding: HashedEmbedding | None = None,
) -> DataFrame:
    """k answers per question: retrieve, read, look up the page, assemble.

    `embedding` is what the chunks were embedded by: the questions' vectors are then
    worked out from their texts within the search. `page_id` finds the page of a chunk; by default the part of the key before
    the dash."""
    contexts = hybrid.search(
        chunks, index, questions, texts, k,
        reranking=reranking, scorer=scorer, dedupe=dedupe, cells=cells, embedding=embedding,
    )
    return answered(contexts, page_info, read, page_id, strict)


def answered(
    contexts: DataFrame,
    page_info: DataFrame,
    read: reader.Reader = reader.lexical_reader,
    page_id: Column | None = None,
    strict: bool = False,
) -> DataFrame:
    """Contexts read, with their pages."""
    found = reader.read_answers(contexts, read)
    if page_id is None:
        page_id = F.substring_index(F.col("key").cast("string"), "-", 1).cast("bigint")
    return reader.assemble(reader.attach_pages(found.withColumn("id", page_id), page_info, strict))


def presented(answers: DataFrame) -> DataFrame:
    """Answers with snippet, link and confidence."""
    return answers.select(
        "*",
        present.snippet_before(F.col("text"), F.col("ans"), start=F.col("ans_start")).alias("snippet_before"),
        present.snippet_after(F.col("text"), F.col("ans"), start=F.col("ans_start")).alias("snippet_after"),
        present.source_url(F.col("href"), F.col("ans")).alias("url"),
        present.confidence(F.col("score")).alias("confidence"),
    )
