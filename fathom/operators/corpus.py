"""From page rows to clean paragraphs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from fathom.functions import wikitext
from fathom.functions.columns import bind, strip
from fathom.functions.wikitext import TAGS

# Title prefixes of pages about the encyclopedia itself. Fixed values.
INTERNAL_NAMESPACES = ("Category", "Draft", "File", "Help", "Template", "Wikipedia")

Clean = Callable[[Column], Column]


def drop_redirects(pages: DataFrame, redirect: str = "redirect") -> DataFrame:
    return pages.where(F.col(redirect).isNull())


def is_internal(title: Column, namespaces: Iterable[str] = INTERNAL_NAMESPACES) -> Column:
    """The part before the first colon names an internal namespace."""
    named = title.contains(":") & F.substring_index(title, ":", 1).isin(*namespaces)
    # A page without a title is in no namespace.
    return F.coalesce(named, F.lit(False))


def drop_internal(
    pages: DataFrame, title: str = "title", namespaces: Iterable[str] = INTERNAL_NAMESPACES
) -> DataFrame:
    return pages.where(~is_internal(F.col(title), namespaces))


def project_articles(pages: DataFrame, clean: Clean | None = None) -> DataFrame:
    """page_id, title, text; `clean` is any Column to Column function."""
    text = F.col("revision.text._VALUE")
    return pages.select(
        F.col("id").alias("page_id"),
        "title",
        (clean(text) if clean else text).alias("text"),
    )


def clean_articles(articles: DataFrame, text: str = "text", strict: bool = False) -> DataFrame:
    """Clean one text column step by step; null text stays null."""
    for step in wikitext.steps(strict):
        articles = articles.withColumn(text, step(F.col(text)))
    return articles


def paragraphs(
    articles: DataFrame, key: str = "page_id", text: str = "text", gap: str = r"\n\s*\n"
) -> DataFrame:
    """One row per paragraph: id, chunk, tags, text.

    A tag line names a section: it becomes the `tags` value of the paragraphs
    up to the next one. Sections, paragraphs and chunk numbers are all worked
    out inside the article's row."""
    sections = F.split(F.col(text), rf"(?m)^(?={TAGS})")

    def blocks(section: Column) -> Column:
        tags = F.trim(F.regexp_extract(section, rf"^{TAGS}([^\n]*)", 1))
        body = F.regexp_replace(section, rf"^{TAGS}[^\n]*", "")
        pieces = F.filter(F.transform(F.split(body, gap), strip), lambda p: p != "")
        return bind(
            tags,
            lambda t: F.transform(pieces, lambda p: F.struct(t.alias("tags"), p.alias("text"))),
        )

    found = F.flatten(F.transform(sections, blocks))
    return articles.select(F.col(key).alias("id"), F.posexplode(found).alias("chunk", "block")).select(
        "id", "chunk", "block.tags", "block.text"
    )


def chunk_key(id_: Column, chunk: Column) -> Column:
    return F.concat_ws("-", id_.cast("string"), chunk.cast("string"))
