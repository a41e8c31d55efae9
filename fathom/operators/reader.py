"""Answers from question and context pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from fathom.functions import spans
from fathom.functions.columns import bind
from fathom.functions.text import standard, word_ranges

Reader = Callable[[Column, Column], Column]


def expand_pairs(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Every hit with its question."""
    return hits.join(questions.select("question_id", "question"), "question_id")


def lexical_reader(question: Column, context: Column) -> Column:
    """Stand-in for a reading model: struct<tokens,start,end,ranges>.

    A word outside the question scores 1, plus 2 as a start when it follows a
    word of the question and plus 2 as an end when one follows it. Context
    words come one per position."""
    return bind(
        F.struct(standard(question).alias("q"), standard(context).alias("c"), word_ranges(context).alias("ranges")),
        lambda p: _word_logits(p["q"], p["c"], p["ranges"]),
    )


def _word_logits(asked: Column, words: Column, ranges: Column) -> Column:
    known = F.transform(words, lambda w: F.array_contains(asked, w))

    def logits(is_known: Column, step: int) -> Column:
        def score(own: Column, at: Column) -> Column:
            beside = F.coalesce(F.get(is_known, at + step), F.lit(False))
            return F.when(own, 0.0).otherwise(1.0) + F.when(beside, 2.0).otherwise(0.0)

        return F.transform(is_known, score)

    return bind(
        known,
        lambda flags: F.struct(
            words.alias("tokens"),
            logits(flags, -1).alias("start"),
            logits(flags, 1).alias("end"),
            ranges.alias("ranges"),
        ),
    )


def read_answers(pairs: DataFrame, reader: Reader = lexical_reader) -> DataFrame:
    """Pairs with `ans`, `QA_score`, `ans_start` and `ans_end`.

    `reader` returns struct<tokens,start,end> and may add a `mask`, and `ranges`, the
    character range of each token. With ranges the answer is cut from the text as it
    stands there; without, its tokens are joined and the places are null."""
    read = pairs.withColumn("_read", reader(F.col("question"), F.col("text")))
    fields = read.schema["_read"].dataType.fieldNames()
    span = spans.best_span(
        F.col("_read.start"), F.col("_read.end"), F.col("_read.mask") if "mask" in fields else None
    )
    found = read.withColumn("_span", span)
    start, end = F.col("_span.span_start"), F.col("_span.span_end")
    if "ranges" in fields:
        first, last = F.get("_read.ranges", start)["start"], F.get("_read.ranges", end)["end"]
        answer = F.substring("text", first + 1, last - first)
    else:
        first = last = F.lit(None).cast("int")
        answer = spans.span_text(F.col("_read.tokens"), start, end)
    return (
        found.withColumns({"ans_start": first, "ans_end": last})
        .withColumn("ans", answer)
        .withColumn("QA_score", spans.span_score(F.col("_read.start"), F.col("_read.end"), start, end))
        .drop("_read", "_span")
    )


def attach_pages(
    answers: DataFrame, page_info: DataFrame, strict: bool = False, on: str = "id"
) -> DataFrame:
    """Title and link by page id. An answer of an unknown page stays without them;
    with `strict` it fails the job."""
    info = page_info.select(on, "title", "href", F.lit(True).alias("_known"))
    found = answers.join(info, on, "left")
    if strict:
        missing = F.raise_error(F.concat(F.lit("unknown page: "), F.coalesce(F.col(on).cast("string"), F.lit("null"))))
        # In the title, so that no optimiser drops the check.
        title = F.when(F.col("_known"), F.col("title")).otherwise(missing.cast("string"))
        found = found.withColumn("title", title)
    return found.drop("_known")


def assemble(answers: DataFrame) -> DataFrame:
    """The eight answer columns, in context order, plus what identifies them and the
    answer's place in the text, where the reader gives one."""
    return answers.select(
        "question_id",
        "rank",
        F.col("score").cast("double").alias("score"),
        "ans",
        F.col("score").cast("double").alias("HNSW_score"),
        "QA_score",
        "href",
        "id",
        "title",
        "text",
        "index_score",
        "ans_start",
        "ans_end",
    )
