"""Index records: JSON objects with id, chunk, embedding and any other fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CORE = "id bigint, chunk int, embedding array<float>"


def parse_records(lines: DataFrame, line: str = "value") -> DataFrame:
    """key, id, chunk, embedding, fields; every field but the vector is kept as
    text in the map."""
    value = F.col(line)
    core = F.from_json(value, CORE)
    every = F.from_json(value, "map<string,string>")
    parsed = lines.select(core.alias("c"), every.alias("f"))
    return parsed.select(
        F.concat_ws("-", "c.id", "c.chunk").alias("key"),
        "c.id",
        "c.chunk",
        "c.embedding",
        F.map_filter("f", lambda k, _: k != "embedding").alias("fields"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return parse_records(spark.read.text(path))


def payload_map(fields: list[str]) -> Column:
    """The named columns as a map of texts."""
    return F.create_map(*[c for f in fields for c in (F.lit(f), F.col(f).cast("string"))])
