"""Queries over sources, filters, the cleaner and paragraphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathom import hooks
from fathom.functions import wikitext
from fathom.operators import corpus
from fathom.plans import ingest
from fathom.plans.catalog import query, table, texts
from fathom.session import fresh_path, settled
from fathom.sources import dump, pages, records
from fathom.sources.collection import Collection


# ---- links ---------------------------------------------------------------

LINKS = r"""
WITH shown AS (
  SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g') AS h
  FROM pages),
found AS (
  SELECT page_id, regexp_extract_all(h, '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*"([^"]*)"', 1) AS hrefs FROM shown),
links AS (
  SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, replace(hrefs[i], '&amp;', '&') AS href
  FROM found, unnest(range(1, len(hrefs) + 1)) AS t(i))
"""
KINDS = LINKS + """, kinds AS (
  SELECT page_id, pos, href, CASE WHEN contains(href, 'en') THEN 'xml' ELSE 'index' END AS kind
  FROM links WHERE contains(href, 'e'))
"""


@query("page_links", LINKS + "SELECT page_id, pos, href FROM links")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_links(texts(spark, sf, "pages"))


@query("classify_links", KINDS + "SELECT page_id, pos, href, kind FROM kinds")
def classify_links(spark: SparkSession, sf: str) -> DataFrame:
    return pages.classify_links(page_links(spark, sf), "e", "en")


@query(
    "links_skip_first",
    KINDS + """SELECT page_id, pos, href, kind FROM (
      SELECT *, row_number() OVER (PARTITION BY page_id, kind ORDER BY pos) AS nth FROM kinds) WHERE nth > 1""",
)
def links_skip_first(spark: SparkSession, sf: str) -> DataFrame:
    return pages.skip_first(classify_links(spark, sf))


# ---- dump ----------------------------------------------------------------

TITLED = """
WITH titled AS (
  SELECT doc_id, text, lang, source,
         CASE lang WHEN 'en' THEN '' WHEN 'fr' THEN 'Help:' WHEN 'de' THEN 'Star Trek: ' ELSE 'Category:' END
           || source || ' ' || doc_id AS title,
         CASE WHEN source IN ('src1', 'src2', 'src3') THEN lang END AS redirect
  FROM documents)
"""


def titled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as page rows: titles in several namespaces, some redirects."""
    lang = F.col("lang")
    prefix = (
        F.when(lang == "en", "").when(lang == "fr", "Help:").when(lang == "de", "Star Trek: ")
    ).otherwise("Category:")
    return texts(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(prefix, "source", F.lit(" "), F.col("doc_id").cast("string")).alias("title"),
        F.when(
            F.col("source").isin("src1", "src2", "src3"), F.struct(F.col("lang").alias("_title"))
        ).alias("redirect"),
        F.struct(F.struct(F.col("text").alias("_VALUE")).alias("text")).alias("revision"),
    )


def page_xml(rows: DataFrame, *more: str) -> DataFrame:
    """Page rows written out as XML, beside some of their columns."""

    def escaped(c):
        for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(mark), F.lit(name))
        return c

    turn = F.when(
        F.col("redirect").isNotNull(),
        F.concat(F.lit('<redirect title="'), F.col("redirect._title"), F.lit('" />')),
    ).otherwise("")
    return rows.select(
        *more,
        F.concat(
            F.lit("  <page>\n    <title>"),
            escaped(F.col("title")),
            F.lit("</title>\n    <id>"),
            F.col("id").cast("string"),
            F.lit("</id>\n    "),
            turn,
            F.lit('<revision>\n      <text xml:space="preserve">'),
            escaped(F.col("revision.text._VALUE")),
            F.lit("</text>\n    </revision>\n  </page>"),
        ).alias("value")
    )


@query(
    "wiki_scan",
    TITLED + "SELECT doc_id AS page_id, title, redirect IS NOT NULL AS redirected, text FROM titled",
)
def wiki_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "dump")
    page_xml(titled(spark, sf)).write.option("compression", "bzip2").text(path)
    return dump.read_pages(spark, path).select(
        F.col("id").alias("page_id"),
        "title",
        F.col("redirect").isNotNull().alias("redirected"),
        F.col("revision.text._VALUE").alias("text"),
    )


@query(
    "wiki_scan_rejects",
    TITLED + "SELECT doc_id AS page_id, title, text, doc_id % 7 = 3 AS rejected FROM titled WHERE doc_id % 7 <> 3 "
    "UNION ALL SELECT doc_id, NULL, NULL, true FROM titled WHERE doc_id % 7 = 3",
)
def wiki_scan_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh page loses the end of its title; it is reported, not lost."""
    path = fresh_path(spark, "dump")
    broken = F.when(F.col("id") % 7 == 3, F.replace(F.col("value"), F.lit("</title>"), F.lit(""))).otherwise(F.col("value"))
    page_xml(titled(spark, sf), "id").select(broken.alias("value")).write.text(path)
    good, bad = dump.read_pages_and_rejects(spark, path)
    nothing = F.lit(None).cast("string")
    number = F.regexp_extract("xml", "<id>(\\d+)</id>", 1).cast("bigint")
    return good.select(
        F.col("id").alias("page_id"), "title", F.col("revision.text._VALUE").alias("text"), F.lit(False).alias("rejected")
    ).unionByName(
        bad.select(number.alias("page_id"), nothing.alias("title"), nothing.alias("text"), F.lit(True).alias("rejected"))
    )


@query(
    "wiki_scan_streams",
    TITLED + "SELECT doc_id AS page_id, title, text FROM titled WHERE doc_id // 100 % 2 = 0",
)
def wiki_scan_streams(spark: SparkSession, sf: str) -> DataFrame:
    """A dump of streams of a hundred pages each, of which every second one is read
    from its offset."""
    pages_ = page_xml(titled(spark, sf), "id").withColumn("stream", F.floor(F.col("id") / 100))
    parts = F.array_sort(F.collect_list(F.struct("id", "value")))
    streams = pages_.groupBy("stream").agg(F.array_join(parts["value"], "\n").alias("xml"))
    index = settled(dump.write_streams(streams, fresh_path(spark, "streams")), "stream-index")
    found = dump.read_streams(index.where(F.col("stream") % 2 == 0))
    return found.select(F.col("id").alias("page_id"), "title", F.col("revision.text._VALUE").alias("text"))


@query("clean_hook", TITLED + "SELECT doc_id AS page_id, title, lower(left(text, 100)) AS text FROM titled")
def clean_hook(spark: SparkSession, sf: str) -> DataFrame:
    """Any function of a column cleans the articles."""
    return corpus.project_articles(titled(spark, sf), clean=lambda text: F.lower(F.substring(text, 1, 100)))


@query("filter_redirects", TITLED + "SELECT doc_id AS id, title FROM titled WHERE redirect IS NULL")
def filter_redirects(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.drop_redirects(titled(spark, sf)).select("id", "title")


@query(
    "filter_namespaces",
    TITLED + "SELECT doc_id AS id, title FROM titled WHERE lang NOT IN ('fr', 'es')",
)
def filter_namespaces(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.drop_internal(titled(spark, sf)).select("id", "title")


@query("project_pages", TITLED + "SELECT doc_id AS page_id, title, text FROM titled")
def project_pages(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.project_articles(titled(spark, sf))


def index_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A compressed dump index of the documents, read back."""
    path = fresh_path(spark, "dump-index")
    line = F.concat_ws(
        ":", F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"), "source", "lang"
    )
    table(spark, sf, "documents").select(line).write.option("compression", "bzip2").text(path)
    return dump.read_index(spark, path)


@query("dump_index", "SELECT doc_id // 100 AS \"offset\", doc_id AS page_id, source || ':' || lang AS title FROM documents")
def dump_index(spark: SparkSession, sf: str) -> DataFrame:
    return index_lines(spark, sf)


@query("stream_offsets", "SELECT DISTINCT doc_id // 100 AS \"offset\" FROM documents")
def stream_offsets(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "offsets")
    dump.write_offsets(dump.stream_offsets(index_lines(spark, sf)), path)
    return dump.read_offsets(spark, path)


@query("stream_count", "SELECT count(DISTINCT doc_id // 100) AS streams FROM documents")
def stream_count(spark: SparkSession, sf: str) -> DataFrame:
    return dump.stream_count(dump.stream_offsets(index_lines(spark, sf)))


@query(
    "page_info",
    """WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS lines, source FROM documents)
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS id, lines[i] AS title, source || '/' || lines[i] AS href
    FROM parts, unnest(range(1, len(lines) + 1)) AS t(i)""",
)
def page_info(spark: SparkSession, sf: str) -> DataFrame:
    """Each document serves as a title file, its copy with a prefix as the
    matching link file."""
    docs = texts(spark, sf, "documents")
    prefix = F.concat("source", F.lit("/"))
    marked = F.concat(prefix, F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), prefix)))
    titles = docs.select("doc_id", pages.lines_by_position(F.col("text")).alias("id", "title"))
    hrefs = docs.select("doc_id", pages.lines_by_position(marked).alias("id", "href"))
    return pages.page_info(titles, hrefs, ["doc_id", "id"])


@query(
    "page_info_files",
    """SELECT row_number() OVER (ORDER BY doc_id % 4, doc_id) - 1 AS id, source || ' ' || doc_id AS title,
         'http://' || lang || '/' || doc_id AS href FROM documents""",
)
def page_info_files(spark: SparkSession, sf: str) -> DataFrame:
    """Title and link files of several parts, one line per document."""

    def written(line: Column) -> str:
        path = fresh_path(spark, "lines")
        docs = table(spark, sf, "documents").withColumn("part", F.col("doc_id") % 4)
        for part in range(4):
            # Files in order, as many as the rows need.
            lines = docs.where(F.col("part") == part).orderBy("doc_id").select(line.alias("value"))
            lines.write.text(f"{path}/part={part}")
        return path

    number = F.col("doc_id").cast("string")
    titles = written(F.concat("source", F.lit(" "), number))
    hrefs = written(F.concat(F.lit("http://"), "lang", F.lit("/"), number))
    return pages.page_info(
        pages.read_positional(spark, titles, "title"), pages.read_positional(spark, hrefs, "href")
    )


# ---- records -------------------------------------------------------------


def record_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs, vectors = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    joined = docs.join(vectors, docs.doc_id == vectors.vec_id)
    return joined.select(
        F.to_json(
            F.struct(F.col("doc_id").alias("id"), F.col("label").alias("chunk"), "text", "lang", "n_chars", "embedding")
        ).alias("value")
    )


@query(
    "index_records",
    """SELECT doc_id || '-' || label AS "key", doc_id AS id, label AS chunk, CAST(len(embedding) AS INTEGER) AS dim,
         round(CAST(embedding[1] AS DOUBLE), 6) AS first_value, text, lang, CAST(n_chars AS VARCHAR) AS n_chars, 5 AS n_fields
       FROM documents JOIN embeddings ON doc_id = vec_id""",
)
def index_records(spark: SparkSession, sf: str) -> DataFrame:
    """Written as JSON lines and read back."""
    path = fresh_path(spark, "records")
    record_lines(spark, sf).write.text(path)
    read = records.read_records(spark, path)
    return read.select(
        "key",
        "id",
        "chunk",
        F.size("embedding").alias("dim"),
        F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"),
        F.col("fields")["text"].alias("text"),
        F.col("fields")["lang"].alias("lang"),
        F.col("fields")["n_chars"].alias("n_chars"),
        F.size("fields").alias("n_fields"),
    )


@query(
    "payload_map",
    """SELECT doc_id, unnest(['lang', 'n_chars', 'source']) AS field,
              unnest([lang, CAST(n_chars AS VARCHAR), source]) AS value FROM documents""",
)
def payload_map(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    fields = records.payload_map(["lang", "n_chars", "source"])
    return docs.select("doc_id", F.explode(fields).alias("field", "value"))


# ---- cleaner -------------------------------------------------------------


def wrapped(spark: SparkSession, sf: str, *parts: str) -> DataFrame:
    """Documents with markup put around their text: parts are column names or
    literal text marked by a leading '='."""
    pieces = [F.lit(p[1:]) if p.startswith("=") else F.col(p) for p in parts]
    return texts(spark, sf, "documents").select("doc_id", F.concat(*pieces).alias("text"))


def cleaned(rows: DataFrame, step) -> DataFrame:
    return rows.select("doc_id", step(F.col("text")).alias("text"))


@query("clean_cut_tail", "SELECT doc_id, text || chr(10) AS text FROM documents")
def clean_cut_tail(spark: SparkSession, sf: str) -> DataFrame:
    rows = wrapped(spark, sf, "text", "=\n== Notes on ", "lang", "= ==\n", "text", "=\n== References ==\n", "source")
    return cleaned(rows, wikitext.cut_tail)


@query(
    "clean_links",
    """SELECT doc_id, lang || ' ' || text || ' ' || source || ' b|' || lang || ' [[File:' || source || '|t y w]]' AS text
       FROM documents""",
)
def clean_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = wrapped(
        spark, sf, "=[[", "source", "=|", "lang", "=]] ", "text", "= [[", "source",
        "=]] [[a|b|", "lang", "=]] [[File:", "source", "=|t [[z|y]] w]]",
    )
    return cleaned(rows, wikitext.resolve_links)


@query("clean_markup", "SELECT doc_id, lang || text || source AS text FROM documents")
def clean_markup(spark: SparkSession, sf: str) -> DataFrame:
    rows = wrapped(
        spark, sf, "=<!-- a\n b --><nowiki>", "lang", "=</nowiki><ref name=\"q\">x\ny</ref>'''", "text",
        "='''<ref name=z /><br /><span class=\"c\"></span><div></div><sup></sup><sub></sub><u></u>&nbsp;",
        "=<small></small><blockquote></blockquote><gallery mode=a>\nq\n</gallery><imagemap>r</imagemap>",
        "=<math>x^2\n</math><code>s</code>", "source",
    )
    return cleaned(rows, wikitext.drop_markup)


@query(
    "intro_tags",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN '!!tags: ' || source || ' of ' || lang || ' ' || chr(10) || chr(10) || text
         ELSE '!!tags: ' || chr(10) || chr(10) || text END AS text FROM documents""",
)
def intro_tags(spark: SparkSession, sf: str) -> DataFrame:
    described = F.concat(
        F.lit("{{Short description|"), "source", F.lit("  of|"), "lang", F.lit("}}"), "text"
    )
    text = F.when(F.col("lang") == "en", described).otherwise(F.col("text"))
    return texts(spark, sf, "documents").select("doc_id", wikitext.intro_tags(text).alias("text"))


@query(
    "section_tags",
    """SELECT doc_id, text || chr(10) || '!!tags:  ' || source || ' its a  ' || lang || ' b ' || chr(10) || chr(10)
         || chr(10) || text || chr(10) || '!!tags:  top   ' || source || '    ' || chr(10) || chr(10) || 'end' AS text
       FROM documents""",
)
def section_tags(spark: SparkSession, sf: str) -> DataFrame:
    rows = wrapped(
        spark, sf, "text", "=\n== ", "source", "=, It's A ==\n{{Main|", "lang", "=, B}}\n", "text",
        "=\n== Top ==\n=== ", "source", "= ===\n\nend",
    )
    return cleaned(rows, wikitext.section_tags)


@query(
    "bracket_tokens",
    """SELECT doc_id, ' <! ' || source || ' !>  {{ x|  }} ' || replace(text, '|}', '!>') || ' [[ ' || lang || ' ]] { <! ' AS text
       FROM documents""",
)
def bracket_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = wrapped(spark, sf, "={|", "source", "=|}{{x|}}", "text", "=[[", "lang", "=]]{{|")
    return cleaned(rows, wikitext.pad_brackets)


@query(
    "drop_list_lines",
    """SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^[*#:]')), chr(10))
         || chr(10) || lang AS text FROM documents""",
)
def drop_list_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = wrapped(spark, sf, "text", "=\n* ", "source", "=\n#\n: q\n", "lang")
    return cleaned(rows, wikitext.drop_list_lines)


# Lines of a text with single spaces and the ending the cleaner gives them.
REBUILT = """array_to_string(list_transform(
  list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^[*#:]')),
  lambda x: CASE WHEN trim(regexp_replace(x, '\\s+', ' ', 'g')) = '' THEN chr(10)
            ELSE trim(regexp_replace(x, '\\s+', ' ', 'g')) || ' ' || chr(10) END), '')"""


@query(
    "drop_nested",
    f"SELECT doc_id, chr(10) || chr(10) || {REBUILT} || 'a z ' || chr(10) AS text FROM documents",
)
def drop_nested(spark: SparkSession, sf: str) -> DataFrame:
    rows = wrapped(
        spark, sf, "={{ box ", "source", "= {{ in }} [[\n* x }}\n", "lang", "= }}\n", "text",
        "=\na [[ File ", "lang", "= {{ ]] z <! t",
    )
    return cleaned(rows, wikitext.drop_nested)


def finalized(sql: str) -> str:
    """SQL of the last cleaning step over an SQL text expression."""
    left = r"'\{\{|\}\}|\||\(\s*\)|\(\s*;\s*\)|\s*;\s*'"
    return (
        rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({sql}, {left}, ' ', 'g'), "
        rf"' +', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
    )


@query(
    "clean_finalize",
    "SELECT doc_id, " + finalized(
        "'  {{a}} ' || text || ' ( ; ) (  ) x' || chr(10) || ' ; y' || chr(10) || chr(10) || chr(10) || chr(10) || lang || '  '"
    ) + " AS text FROM documents",
)
def clean_finalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = wrapped(spark, sf, "=  {{a}} ", "text", "= ( ; ) (  ) x\n ; y\n\n\n\n", "lang", "=  ")
    return cleaned(rows, wikitext.finalize)


def marked_up(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as small articles in wikitext."""
    return wrapped(
        spark, sf, "={{Short description|", "source", "=}}\n'''", "lang", "=''' [[a|", "source",
        "=]]<ref>x</ref>\n\n== H ", "lang", "= ==\n", "text",
        "=\n{{cvt|2|m}} z\n* item\n== See also ==\n[[q]]",
    )


@query(
    "clean_articles",
    "SELECT doc_id, " + finalized(
        "'!!tags: ' || source || ' ' || chr(10) || chr(10) || chr(10) || lang || ' ' || source || ' ' || chr(10) || chr(10)"
        " || '!!tags: h ' || lang || ' ' || chr(10) || chr(10) || " + REBUILT + " || 'z ' || chr(10) || chr(10)"
    ) + " AS text FROM documents",
)
def clean_articles(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.clean_articles(marked_up(spark, sf))


# ---- paragraphs ----------------------------------------------------------

PARAGRAPHS = """
WITH parts AS (
  SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p
  FROM documents),
paragraphs AS (
  SELECT doc_id AS id, CAST(i - 1 AS INTEGER) AS chunk, source AS tags, p[i] AS text
  FROM parts, unnest(range(1, len(p) + 1)) AS t(i))
"""


@query("paragraphs", PARAGRAPHS + "SELECT id, chunk, tags, text FROM paragraphs")
def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """The documents have no blank lines, so each line is a paragraph here."""
    rows = wrapped(spark, sf, "=!!tags: ", "source", "= \n", "text")
    return corpus.paragraphs(rows, "doc_id", gap=r"\n")


@query("chunk_keys", PARAGRAPHS + "SELECT id || '-' || chunk AS \"key\", id, chunk FROM paragraphs")
def chunk_keys(spark: SparkSession, sf: str) -> DataFrame:
    split = paragraphs(spark, sf)
    return split.select(corpus.chunk_key(F.col("id"), F.col("chunk")).alias("key"), "id", "chunk")


# ---- a dump to a searchable collection ------------------------------------


def text_sizes():
    """A small embedding: characters, spaces and e's of a text."""

    def encode(texts):
        return np.array([[len(t), t.count(" "), t.count("e")] for t in texts], np.float32)

    return encode


@query(
    "ingest_dump",
    TITLED + """, kept AS (
      SELECT doc_id, """ + finalized(REBUILT) + """ AS body FROM titled WHERE redirect IS NULL AND lang NOT IN ('fr', 'es')),
    parts AS (
      SELECT doc_id, list_filter(list_transform(regexp_split_to_array(body, '\\n\\s*\\n'),
        lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM kept)
    SELECT doc_id || '-' || (i - 1) AS "key", doc_id AS id, CAST(i - 1 AS INTEGER) AS chunk, '' AS tags, p[i] AS text,
      CAST(7 AS BIGINT) AS seq, CAST(length(p[i]) AS DOUBLE) AS size, CAST(length(p[i]) - length(replace(p[i], ' ', '')) AS DOUBLE) AS spaces,
      CAST(length(p[i]) - length(replace(p[i], 'e', '')) AS DOUBLE) AS es
    FROM parts, unnest(range(1, len(p) + 1)) AS t(i)""",
)
def ingest_dump(spark: SparkSession, sf: str) -> DataFrame:
    """From a compressed dump to a collection of embedded paragraphs."""
    path = fresh_path(spark, "dump")
    page_xml(titled(spark, sf)).write.option("compression", "bzip2").text(path)
    target = Collection(spark, fresh_path(spark, "collection"), replaces="id")
    ingest.load_dump(spark, path, target, 7, hooks.embedder(text_sizes))
    value = lambda i: F.col("embedding")[i].cast("double")
    return target.scan().select(
        "key", "id", "chunk", "tags", "text", "seq", value(0).alias("size"), value(1).alias("spaces"), value(2).alias("es")
    )
