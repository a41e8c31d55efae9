"""A corpus prepared once and opened for any number of questions.

Below one path lie the text index with its blocks of postings, what texts are
embedded by, the vectors in blocks of half precision, and the texts by bucket of
their key. A batch of questions reads the buckets of its terms, the cells in its
reach and the buckets of its hits; nothing is analyzed, embedded or packed again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathom.hooks import HashedEmbedding
from fathom.operators import fulltext, hybrid, knn, reader
from fathom.plans.ask import K, answered
from fathom.session import settled

DIM = 256


def texts_by_bucket(rows: DataFrame) -> DataFrame:
    """Texts in the order of their folders. They are not exchanged: a task writes a file
    for each bucket, as of the blocks of postings."""
    return rows.withColumn("bucket", knn.key_bucket("key")).sortWithinPartitions("bucket", "key")


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    index: fulltext.TextIndex
    embedding: HashedEmbedding

    @classmethod
    def write(cls, docs: DataFrame, path: str, key: str = "key", text: str = "text", dim: int = DIM) -> Store:
        """Prepare the texts of a corpus. A text without words has no vector and is
        found by neither branch."""
        rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        index = fulltext.write_index(rows, f"{path}/index", blocks=True)
        # The words as the index has them, so that no text is split again.
        words = index.words.select("key", "terms", "tfs")
        embedding = HashedEmbedding.fit(words, "terms", dim)
        embedding.write(docs.sparkSession, f"{path}/embedding")
        # Written first, as cells are surveyed and vectors stored in several passes.
        vectors = settled(embedding.embed(words, "terms", counts="tfs"), "embedded")
        knn.write_half(vectors, f"{path}/vectors")
        texts_by_bucket(rows).write.partitionBy("bucket").parquet(f"{path}/texts")
        return cls.read(docs.sparkSession, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Store:
        index = fulltext.read_index(spark, f"{path}/index", blocks=True)
        return cls(spark, path, index, HashedEmbedding.read(spark, f"{path}/embedding"))

    def vector_hits(self, questions: DataFrame, k: int = K) -> DataFrame:
        asked = self.embedding.embed(questions, "question")
        return knn.search_half(self.spark, f"{self.path}/vectors", asked, k)

    def text_hits(self, questions: DataFrame, k: int = K) -> DataFrame:
        return fulltext.bm25_top_k(self.index, questions, k, full_scoring_rows=0)

    def hits(self, questions: DataFrame, k: int = K) -> DataFrame:
        """Hits of both branches, each for the questions routed to it, written: at most
        2k rows for each question."""
        asked = hybrid.valid_questions(questions)
        by_vector = self.vector_hits(hybrid.route(asked, hybrid.VECTOR), k)
        by_text = self.text_hits(hybrid.route(asked, hybrid.FULLTEXT), k)
        return settled(hybrid.union_hits(by_vector, by_text), "hits")

    def texts(self, hits: DataFrame) -> DataFrame:
        """Texts of the buckets that the hits lie in."""
        buckets = [row[0] for row in hits.select(knn.key_bucket("key")).distinct().collect()]
        rows = self.spark.read.parquet(f"{self.path}/texts")
        return rows.where(F.col("bucket").isin(buckets) if buckets else F.lit(False)).select("key", "text")

    def contexts(self, questions: DataFrame, k: int = K, **how) -> DataFrame:
        return hybrid.contexts(self.hits(questions, k), questions, self.texts, k, **how)

    def ask(
        self,
        questions: DataFrame,
        page_info: DataFrame,
        k: int = K,
        read: reader.Reader = reader.lexical_reader,
        page_id: Column | None = None,
        strict: bool = False,
        **how,
    ) -> DataFrame:
        """k answers per question, as `plans.ask.ask` gives them."""
        return answered(self.contexts(questions, k, **how), page_info, read, page_id, strict)
