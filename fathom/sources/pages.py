"""Links of HTML pages and the title and link lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Comments, scripts and styles hold no links.
NO_LINKS = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
QUOTES = r"""^["']|["']$"""


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos, href of every anchor in document order."""
    shown = F.regexp_replace(html, NO_LINKS, "")
    quoted = F.regexp_extract_all(shown, F.lit(ANCHOR), F.lit(1))
    found = pages.select(key, F.posexplode_outer(quoted).alias("pos", "href"))
    return found.where(F.col("href").isNotNull()).withColumn(
        "href", F.replace(F.regexp_replace("href", QUOTES, ""), F.lit("&amp;"), F.lit("&"))
    )


def classify_links(links: DataFrame, wanted: str = "articles-multistream", data: str = "xml") -> DataFrame:
    """Links that contain `wanted`, as class 'xml' where they also contain
    `data`, else 'index'."""
    kind = F.when(F.contains("href", F.lit(data)), "xml").otherwise("index")
    return links.where(F.contains("href", F.lit(wanted))).withColumn("kind", kind)


def skip_first(links: DataFrame, key: str = "page_id") -> DataFrame:
    """Drop the first link of each class on each page."""
    window = Window.partitionBy(key, "kind").orderBy("pos")
    return links.withColumn("_nth", F.row_number().over(window)).where(F.col("_nth") > 1).drop("_nth")


def write_links(links: DataFrame, path: str, href: str = "href") -> None:
    """One link per line."""
    links.select(href).write.text(path)


def lines_by_position(text: Column) -> Column:
    """Generator of (id, value): line n of a text belongs to page id n."""
    return F.posexplode(F.split(text, "\n"))


def read_positional(spark: SparkSession, path: str, name: str) -> DataFrame:
    """id, `name` from text whose 0-based line number is the page id; several
    files are read in the order of their names, as one text.

    Splits are numbered by their file and where they start in it: a line's
    number is the count of lines in earlier splits plus its place in its own, so
    files of any size are read in parallel. Ingest once and keep the table."""
    lines = spark.read.text(path).select(
        F.col("value").alias(name),
        F.struct("_metadata.file_path", "_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
    )
    splits = lines.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # One row per split, so this window is as small as the list of splits.
    earlier = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("split", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return lines.join(starts, "split").select(
        (F.col("before") + F.col("at") - F.col("first")).alias("id"), name
    )


def page_info(titles: DataFrame, hrefs: DataFrame, on: list[str] | None = None) -> DataFrame:
    """id, title, href."""
    return titles.join(hrefs, on or ["id"])
