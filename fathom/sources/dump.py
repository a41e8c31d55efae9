"""Page dumps: XML pages, their index and the stream offsets."""

from __future__ import annotations

import bz2
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PAGE = (
    "id bigint, title string, redirect struct<_title: string>, "
    "revision struct<text: struct<_VALUE: string>>"
)
PAGE_END = "</page>"


def parse_page(xml: Column, mode: str = "FAILFAST") -> Column:
    """One <page> element to a struct; text keeps its outer whitespace. A page
    that does not parse fails the job, or is `_broken` in permissive mode."""
    options = {"rowTag": "page", "ignoreSurroundingSpaces": "false", "mode": mode}
    if mode == "FAILFAST":
        return F.from_xml(xml, PAGE, options)
    return F.from_xml(xml, f"{PAGE}, _broken string", {**options, "columnNameOfCorruptRecord": "_broken"})


def page_elements(spark: SparkSession, path: str) -> DataFrame:
    """The text of every page element.

    Lines end at </page>, so Spark splits files, bz2 streams included, and
    each split yields whole pages; a root element or none makes no difference."""
    pieces = spark.read.option("lineSep", PAGE_END).text(path)
    start = F.instr("value", "<page>")
    xml = F.concat(F.substring("value", start, F.length("value")), F.lit(PAGE_END))
    return pieces.where(start > 0).select(xml.alias("xml"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """id, title, redirect, revision of every page of a dump; fails on a page that
    does not parse."""
    return page_elements(spark, path).select(parse_page(F.col("xml")).alias("page")).select("page.*")


def read_pages_and_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The pages that parse, and the text of those that do not."""
    parsed = page_elements(spark, path).select("xml", parse_page(F.col("xml"), "PERMISSIVE").alias("page"))
    broken = F.col("page").isNull() | F.col("page._broken").isNotNull()
    return parsed.where(~broken).select("page.*").drop("_broken"), parsed.where(broken).select("xml")


def parse_index_line(line: Column) -> list[Column]:
    """offset:page-id:title; titles may hold more colons."""
    parts = F.split(line, ":", 3)
    return [
        parts[0].cast("bigint").alias("offset"),
        parts[1].cast("bigint").alias("page_id"),
        parts[2].alias("title"),
    ]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.length("value") > 0)
    return lines.select(*parse_index_line(F.col("value")))


def stream_offsets(index: DataFrame) -> DataFrame:
    """Distinct offsets in ascending order."""
    return index.select("offset").distinct().orderBy("offset")


def write_offsets(offsets: DataFrame, path: str) -> None:
    """One offset per line."""
    offsets.select(F.col("offset").cast("string")).write.text(path)


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.length("value") > 0)
    return lines.select(F.col("value").cast("bigint").alias("offset"))


def stream_count(offsets: DataFrame) -> DataFrame:
    return offsets.agg(F.count(F.lit(1)).alias("streams"))


# Bytes read at once from a stream.
READ_BYTES = 1 << 18


def write_streams(streams: DataFrame, path: str) -> DataFrame:
    """Write (stream, xml) rows as multistream files below `path`, one for each task,
    and give (stream, file, offset) of each stream: its pages are compressed by
    themselves, so they can be read from its offset on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A name of its own, so that a task that runs again leaves no mixed file.
        store, folder = fs.FileSystem.from_uri(path)
        name = f"{uuid.uuid4().hex}.xml.bz2"
        store.create_dir(folder)
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for batch in batches:
                offsets = []
                for xml in batch.column(1).to_pylist():
                    offsets.append(out.tell())
                    out.write(bz2.compress(xml.encode()))
                files = pa.array([f"{path}/{name}"] * len(offsets), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), files, pa.array(offsets, pa.int64())], ["stream", "file", "offset"]
                )

    return streams.select("stream", "xml").mapInArrow(run, "stream long, file string, offset long")


def read_streams(streams: DataFrame, tasks: int | None = None) -> DataFrame:
    """Pages of chosen streams, given as (file, offset): each is read from its offset
    to its own end, and nothing else of the file. Streams are dealt to tasks."""
    n = tasks or streams.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([_stream(file, offset)], pa.string())], ["text"])

    texts = streams.select("file", "offset").repartition(n).mapInArrow(run, "text string")
    pieces = texts.select(F.explode(F.split("text", PAGE_END)).alias("value"))
    start = F.instr("value", "<page>")
    xml = F.concat(F.substring("value", start, F.length("value")), F.lit(PAGE_END))
    return pieces.where(start > 0).select(parse_page(xml).alias("page")).select("page.*")


def _stream(file: str, offset: int) -> str:
    store, name = fs.FileSystem.from_uri(file)
    unpack, parts = bz2.BZ2Decompressor(), []
    with store.open_input_file(name) as source:
        source.seek(offset)
        while not unpack.eof:
            data = source.read(READ_BYTES)
            if not data:
                raise ValueError(f"the stream at {offset} of {file} has no end")
            parts.append(unpack.decompress(data))
    return b"".join(parts).decode()
