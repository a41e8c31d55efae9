"""Content-addressed archive of web records.

Records have WARC form: a header block, a payload, an end. The archive keeps the
exact header bytes of every record in one table, and every payload once in
another, under its SHA-256; a join on the digest gives back the original bytes.
Payloads are checked against their digest on reading, and the header's own SHA-1
against the payload.

Of records with equal payloads of at least REVISIT_BYTES bytes the one with the
largest key is the response and the others are revisits that refer to it;
smaller payloads are stored once as well, but all their records are responses.

Only keys and digests are grouped; payload bytes move once, when the one to be
stored is picked, in an exchange on key and digest that no hot payload skews.

Defined cases: a null payload is empty; a null url has no target line; line
breaks in a url are percent-encoded; a row with a null key is a revisit if a row
with a key has its payload, else a response; rows with the key of the response
and its payload are responses too; an empty table gives an empty archive; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathom.llm.arrow import type_of, utf8
from fathom.session import settled

REVISIT_BYTES = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:record:"
END = b"\r\n\r\n"


def _line(name: str, *value: Column) -> Column:
    """A header line; nothing if a value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), *value, F.lit("\r\n")), F.lit(""))


def _reference(key: Column) -> Column:
    return F.concat(F.lit(f"<{_ID}"), key.cast("string"), F.lit(">"))


def header(key: str, url: str) -> Column:
    """Exact header bytes: WARC lines, then the HTTP lines of the block."""
    revisit = F.col("record_type") == "revisit"
    target = F.replace(F.replace(F.col(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", F.col("bytes").cast("string")),
        F.lit("\r\n"),
    )
    length = F.length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    warc = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _reference(F.col(key))),
        _line("WARC-Target-URI", target),
        _line("WARC-Payload-Digest", F.lit("sha1:"), F.col("sha1")),
        _line("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, _reference(F.col("holder")))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(warc, http).cast("binary")


def write(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html"
) -> None:
    """Write the archive of a table to `folder`/headers and `folder`/payloads."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), utf8(payload).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = rows.select(
        "key", "url", "digest", F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("bytes")
    )
    narrow = settled(narrow, "records")
    holders = settled(narrow.groupBy("digest").agg(F.max("key").alias("holder")), "holders")

    large = (F.col("bytes") >= REVISIT_BYTES) & F.col("holder").isNotNull()
    other = ~F.col("key").eqNullSafe(F.col("holder"))
    typed = narrow.join(holders, "digest").withColumn(
        "record_type", F.when(large & other, "revisit").otherwise("response")
    )
    typed.select("digest", header("key", "url").alias("header")).write.parquet(f"{folder}/headers")

    # Joined and made unique by the same two columns, so payloads move once.
    name = lambda column: F.coalesce(F.col(column).cast("string"), F.lit("")).alias("name")
    stored = rows.select("digest", name("key"), "payload").join(
        holders.select("digest", name("holder")), ["digest", "name"], "left_semi"
    )
    stored = stored.dropDuplicates(["digest", "name"])
    # zstd keeps the one copy small.
    stored.select("digest", "payload").write.option("compression", "zstd").parquet(f"{folder}/payloads")


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, payload) of every stored payload; fails on one that has changed."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    broken = F.raise_error(F.concat(F.lit("changed payload: "), F.col("digest"))).cast("binary")
    sound = F.sha2("payload", 256) == F.col("digest")
    return stored.select("digest", F.when(sound, F.col("payload")).otherwise(broken).alias("payload"))


def _field(text: Column, name: str) -> Column:
    value = F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(value != "", value)


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, header) and the parsed fields of every record."""
    rows = spark.read.schema("digest string, header binary").parquet(f"{folder}/headers")
    text = F.col("header").cast("string")
    identity = lambda name: F.regexp_extract(_field(text, name), f"^<{_ID}(.*)>$", 1)
    return rows.select(
        "digest",
        "header",
        _field(text, "WARC-Type").alias("record_type"),
        identity("WARC-Record-ID").alias("record"),
        identity("WARC-Refers-To").alias("refers_to"),
        _field(text, "WARC-Target-URI").alias("url"),
        F.regexp_extract(_field(text, "WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("sha1"),
    )


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with the size and digest of its payload as stored; the
    payloads themselves are not moved."""
    held = payloads(spark, folder).select(
        "digest", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")
    )
    rows = headers(spark, folder).join(settled(held, "held"), "digest")
    wrong = F.raise_error(F.concat(F.lit("header and payload differ: "), F.col("record"))).cast("string")
    checked = F.when(F.col("sha1") == F.col("payload_digest"), F.col("payload_digest")).otherwise(wrong)
    return rows.withColumn("payload_digest", checked)


def originals(spark: SparkSession, folder: str) -> DataFrame:
    """(record, record_type, content): the exact bytes of every record. A revisit
    has no payload in its own record."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    joined = headers(spark, folder).join(payloads(spark, folder), "digest")
    return joined.select("record", "record_type", F.concat("header", body, F.lit(END)).alias("content"))


def key_of(record: str, pages: DataFrame, key: str = "page_id") -> Column:
    """A record's name as a key of the table it was written from."""
    return F.col(record).cast(type_of(pages, key))
