"""Corpus pipeline: five stages over `documents`, each one of the operators.

Toxic documents go; of each group of near-duplicates (five-word shingles,
similarity 0.8) one document stays; documents that hold benchmark windows go;
secrets are replaced by a mark inside their documents, which stay; the last
stage takes a mix of the sources and says how many copies of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.llm import decontaminate, minhash, mixing, secrets, toxicity
from fathom.llm.queries import MIX_WEIGHTS, fold, mix_levels
from fathom.plans.catalog import query, table
from fathom.session import settled


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scored by a model fitted on the labelled documents of this stage's input."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1)
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their secrets; n_chars follows the text."""
    columns = docs.columns
    done = secrets.redacted(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.taken(docs, mix_levels(), MIX_WEIGHTS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

# A fitted model decides in the first stage, so no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


query("pipeline", ORACLE_SQL)(run)
