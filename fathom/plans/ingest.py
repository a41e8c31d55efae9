"""From a page dump to paragraphs ready for an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathom.operators import corpus
from fathom.sources import dump
from fathom.sources.collection import Collection


def articles(pages: DataFrame, strict: bool = False) -> DataFrame:
    """Clean articles of parsed pages, without redirects and internal pages."""
    kept = corpus.drop_internal(corpus.drop_redirects(pages))
    return corpus.clean_articles(corpus.project_articles(kept), strict=strict)


def dump_to_paragraphs(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """key, id, chunk, tags, text of every paragraph of a dump."""
    split = corpus.paragraphs(articles(dump.read_pages(spark, path), strict))
    return split.select(corpus.chunk_key(F.col("id"), F.col("chunk")).alias("key"), "*")


def load_dump(
    spark: SparkSession,
    path: str,
    collection: Collection,
    seq: int,
    embed: Callable[[Column], Column],
    strict: bool = False,
) -> None:
    """Read a dump and upsert its embedded paragraphs.

    `seq` orders dumps: paragraphs of a newer dump replace those of an older
    one with the same key, and in a collection that `replaces` "id" all older
    paragraphs of the same article. `embed` is an embedding hook."""
    chunks = dump_to_paragraphs(spark, path, strict)
    collection.upsert(
        chunks.withColumn("embedding", embed(F.col("text"))).withColumn("seq", F.lit(seq).cast("bigint"))
    )
