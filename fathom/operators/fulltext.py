"""Term counts, statistics, TF-IDF and BM25 for whole tables of questions.

The index has one row per document, its distinct words with their counts. Scoring
takes the questions to the documents: a task adds up the scores of its own
documents and hands on k of them for each question, so nothing but those is
exchanged. For few questions over a large corpus there are postings as well,
stored by bucket of the term in blocks with the block's peak: only the buckets of
the asked terms are read, and only blocks of documents that can still get in."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fathom.functions.text import ANALYZERS, Analyzer, Stems, english, english_unstemmed, standard, stemmed
from fathom.operators.joins import BROADCAST_ROWS, Side, checked
from fathom.operators.ranking import SCORE_DIGITS, top_k
from fathom.session import bound_batches, settled

K1 = 1.2
B = 0.75
# Documents of one file that follow each other share a range of 2 ** RANGE_BITS;
# a block holds a term's postings of one range.
RANGE_BITS = 6
TERM_BUCKETS = 64


def analyzed(docs: DataFrame, key: str, text: str, analyzer: Analyzer = standard) -> DataFrame:
    """key, token: one row per word occurrence."""
    return docs.select(F.col(key).alias("key"), F.explode(analyzer(F.col(text))).alias("token"))


def count_words(docs: DataFrame, key: str, text: str, analyzer: Analyzer = standard) -> DataFrame:
    """key, dl, terms, tfs: one row per document with its length and its distinct
    words and their counts.

    Words are numbered over a batch of documents and counted by sorting the numbers,
    so a document's words are counted where it lies and nothing is exchanged. The
    English analyzer stems the batch's distinct words, not every occurrence."""
    bound_batches(docs.sparkSession)
    stems = analyzer is english
    words = F.coalesce((english_unstemmed if stems else analyzer)(F.col(text)), F.array().cast("array<string>"))
    rows = docs.select(F.col(key).alias("key"), words.alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Stems() if stems else None
        for batch in batches:
            if batch.num_rows:
                yield _counted(batch, known)

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, dl int, terms array<string>, tfs array<int>")


def _counted(batch: pa.RecordBatch, known: Stems | None) -> pa.RecordBatch:
    lists = batch.column(1)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    coded = (words if known is None else stemmed(words, known)).dictionary_encode()
    n = max(len(coded.dictionary), 1)
    row = np.repeat(np.arange(len(lengths)), lengths)
    pairs, tf = np.unique(row * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    ends = np.searchsorted(pairs, np.arange(len(lengths) + 1) * n).astype(np.int32)
    terms = coded.dictionary.take(pa.array(pairs % n))
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array(lengths.astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(ends), terms),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int32))),
        ],
        ["key", "dl", "terms", "tfs"],
    )


def exploded(words: DataFrame) -> DataFrame:
    """key, dl, term, tf: a row for each word of each document."""
    rows = words.select("key", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("word"))
    return rows.select("key", "dl", F.col("word.terms").alias("term"), F.col("word.tfs").alias("tf"))


def postings(docs: DataFrame, key: str, text: str, analyzer: Analyzer = standard) -> DataFrame:
    return exploded(count_words(docs, key, text, analyzer))


def document_frequency(posts: DataFrame) -> DataFrame:
    """term, df; partial counts are combined before the exchange."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@dataclass(frozen=True)
class TextIndex:
    """Term statistics of a corpus.

    words(key, dl, terms, tfs)   one row per document
    terms(term, df, peak)        peak: largest tf part any document reaches
    blocks(bucket, term, range, peak, keys, dls, tfs)   postings, where stored
    """

    words: DataFrame
    terms: DataFrame
    analyzer: str = "standard"
    k1: float = K1
    b: float = B
    blocks: DataFrame | None = None

    @property
    def documents(self) -> DataFrame:
        """key, dl of every document."""
        return self.words.select("key", "dl")

    @property
    def postings(self) -> DataFrame:
        return exploded(self.words)

    @cached_property
    def size(self) -> tuple[int, float]:
        """Number of documents and their mean length."""
        row = self.words.agg(F.count("*").alias("n"), F.avg("dl").alias("dl")).first()
        return row["n"], row["dl"] or 0.0

    @property
    def n_docs(self) -> Column:
        return F.lit(self.size[0])

    @property
    def avg_dl(self) -> Column:
        return F.lit(self.size[1])

    def saturation(self) -> Column:
        return _saturation(self.avg_dl, self.k1, self.b)


def _saturation(avg_dl: Column, k1: float, b: float) -> Column:
    tf = F.col("tf").cast("double")
    return tf / (tf + k1 * (1 - b + b * F.col("dl") / avg_dl))


def build_index(
    docs: DataFrame,
    key: str = "key",
    text: str = "text",
    analyzer: str = "standard",
    k1: float = K1,
    b: float = B,
) -> TextIndex:
    """Index as a lazy plan over the documents."""
    words = count_words(docs, key, text, ANALYZERS[analyzer])
    return TextIndex(words, _term_table(words, k1, b), analyzer, k1, b)


def _term_table(words: DataFrame, k1: float, b: float) -> DataFrame:
    peak = F.max(_saturation(words.agg(F.avg("dl")).scalar(), k1, b))
    return exploded(words).groupBy("term").agg(F.count(F.lit(1)).alias("df"), peak.alias("peak"))


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def _block_table(index: TextIndex) -> DataFrame:
    """Postings in blocks: those of one term in one range of documents. What a
    block can add to a score is known from its peak, without its postings.

    Documents of a range lie side by side, so blocks are built where they lie. A range
    that lies in two tasks has two blocks of a term; bounds add up both peaks."""
    rows = index.words.select("range", "key", "dl", "terms", "tfs")
    bound_batches(rows.sparkSession)
    scale = (index.k1, index.b, index.size[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_ranges(batches):
            yield _blocks(held, *scale)

    kind = rows.schema["key"].dataType.simpleString()
    schema = f"term string, range bigint, peak double, keys array<{kind}>, dls array<int>, tfs array<int>"
    return rows.mapInArrow(run, schema).select(term_bucket(F.col("term")).alias("bucket"), "*")


def _whole_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose ranges, in the first column, lie side by side, none cut in two."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([*waiting, batch]).combine_chunks().to_batches()[0]
        # The last range may go on in the next batch.
        ranges = held.column(0).to_numpy(zero_copy_only=False)
        done = int(np.flatnonzero(ranges != ranges[-1]).max(initial=-1)) + 1
        if done:
            yield held.slice(0, done)
        waiting = [held.slice(done)]
    yield from waiting


def _blocks(held: pa.RecordBatch, k1: float, b: float, mean: float) -> pa.RecordBatch:
    """Blocks of some documents, by range and term, postings in key order."""
    held = held.take(pc.sort_indices(held.column(1)))
    lists = held.column(3)
    row = np.repeat(np.arange(held.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    coded = lists.flatten().dictionary_encode()
    ranges, own = np.unique(held.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
    n = max(len(coded.dictionary), 1)
    block = own[row] * n + coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(block, kind="stable")
    block, row = block[order], row[order]
    tf, dl = held.column(4).flatten().take(pa.array(order)), held.column(2).take(pa.array(row))
    counts = tf.to_numpy(zero_copy_only=False).astype(np.float64)
    part = counts / (counts + k1 * (1 - b + b * dl.to_numpy(zero_copy_only=False) / mean)) if len(row) else counts
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    ends = pa.array(np.append(starts, len(block)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            coded.dictionary.take(pa.array(block[starts] % n)),
            pa.array(ranges[block[starts] // n]),
            pa.array(np.maximum.reduceat(part, starts) if len(starts) else part),
            pa.ListArray.from_arrays(ends, held.column(1).take(pa.array(row))),
            pa.ListArray.from_arrays(ends, dl),
            pa.ListArray.from_arrays(ends, tf),
        ],
        ["term", "range", "peak", "keys", "dls", "tfs"],
    )


def _ranged(words: DataFrame) -> DataFrame:
    return words.withColumn("range", F.shiftright(F.monotonically_increasing_id(), RANGE_BITS))


def write_index(
    docs: DataFrame,
    path: str,
    key: str = "key",
    text: str = "text",
    analyzer: str = "standard",
    k1: float = K1,
    b: float = B,
    blocks: bool = False,
) -> TextIndex:
    """Analyze the corpus once and store the index below `path`, with `blocks` also
    the postings by bucket of their term, for questions that are to read little."""
    spark = docs.sparkSession
    _ranged(count_words(docs, key, text, ANALYZERS[analyzer])).write.parquet(f"{path}/words")
    words = spark.read.parquet(f"{path}/words")
    _term_table(words, k1, b).write.parquet(f"{path}/terms")
    if blocks:
        index = read_index(spark, path, analyzer, k1, b, blocks=False)
        # Not exchanged: a task that reads 128 MB of words writes a file for each bucket.
        table = _block_table(index).sortWithinPartitions("bucket", "term", "range")
        table.write.partitionBy("bucket").parquet(f"{path}/blocks")
    return read_index(spark, path, analyzer, k1, b, blocks)


def read_index(
    spark: SparkSession,
    path: str,
    analyzer: str = "standard",
    k1: float = K1,
    b: float = B,
    blocks: bool = False,
) -> TextIndex:
    """Open an index stored by `write_index` with the same settings."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return TextIndex(read("words"), read("terms"), analyzer, k1, b, read("blocks") if blocks else None)


def question_terms(
    questions: DataFrame, analyzer: str = "standard", stem: bool = False
) -> DataFrame:
    """question_id, term, qtf. Questions are not stemmed unless asked."""
    name = "english_unstemmed" if analyzer == "english" and not stem else analyzer
    words = questions.select("question_id", F.explode(ANALYZERS[name](F.col("question"))).alias("term"))
    return words.groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def match_any(index: TextIndex, terms: DataFrame) -> DataFrame:
    """Documents that hold at least one of the terms."""
    wanted = checked(terms.select("term").distinct()).side
    return (
        index.postings.join(wanted, "term", "left_semi")
        .select("key")
        .distinct()
    )


def inverse_frequency(index: TextIndex) -> DataFrame:
    """term, df, idf with the natural log of N over df."""
    return index.terms.select("term", "df", F.log(index.n_docs / F.col("df")).alias("idf"))


def tfidf_weights(index: TextIndex, qterms: DataFrame) -> DataFrame:
    """question_id, term, weight: qtf * idf."""
    weight = (F.col("qtf") * F.col("idf")).alias("weight")
    return inverse_frequency(index).join(qterms, "term").select("question_id", "term", weight)


def tfidf_top_k(index: TextIndex, questions: DataFrame, k: int = 5, stem: bool = False) -> DataFrame:
    """question_id, key, score, rank of the k documents with the largest sum of qtf *
    tf * idf over the terms they share with a question."""
    weighted = settled(tfidf_weights(index, question_terms(questions, index.analyzer, stem)), "question-terms")
    return top_k(_local_best(index, weighted, k, saturate=False), k)


def weighted_terms(index: TextIndex, qterms: DataFrame) -> DataFrame:
    """question_id, term, df, weight, bound: what a term is worth and the most
    it can add to any document's score."""
    df = F.col("df")
    idf = F.log(1 + (index.n_docs - df + 0.5) / (df + 0.5))
    return (
        index.terms.join(qterms, "term")
        .withColumn("weight", F.col("qtf") * idf)
        .select("question_id", "term", "df", "weight", (F.col("weight") * F.col("peak")).alias("bound"))
    )


# Rows (question, term) and questions that are taken to the documents at once; more
# are taken in several passes.
TERM_ROWS = 1_000_000
QUESTIONS = 4096
# Scores of a slice of documents held at once, and products before they are added up.
CELLS = 1 << 20
PRODUCTS = 1 << 22


def _local_best(index: TextIndex, weighted: DataFrame, k: int, saturate: bool) -> DataFrame:
    """question_id, key, score of k documents for each question and task, which hold
    the best k of all, for stored weights. A document's words are in one row, so its scores are added
    up where it lies and only the best leave the task."""
    parts = _passes(weighted.select("question_id", "term", "weight"))
    return reduce(
        DataFrame.unionByName, [_best_of_pass(index, weighted.where(part), k, saturate) for weighted, part in parts]
    )


def _passes(weighted: DataFrame) -> list[tuple[DataFrame, Column]]:
    """The weighted terms as often as there are passes over the documents, each with
    the filter of the questions of its pass."""
    sizes = weighted.agg(F.count("*").alias("n"), F.approx_count_distinct("question_id").alias("q")).first()
    passes = max(1, -(-sizes["n"] // TERM_ROWS), -(-sizes["q"] * 5 // (4 * QUESTIONS)))
    part = F.pmod(F.xxhash64("question_id"), F.lit(passes))
    return [(weighted, part == n if passes > 1 else F.lit(True)) for n in range(passes)]


def _asked(weighted: DataFrame) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Questions, terms, and for each term, from its start on, the numbers of the
    questions that ask it and what it is worth there."""
    asked = weighted.toArrow().combine_chunks()
    questions, terms = pc.unique(asked["question_id"]), pc.unique(asked["term"])
    term = pc.index_in(asked["term"], terms).to_numpy().astype(np.int64)
    order = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[order], np.arange(len(terms) + 1))
    question = pc.index_in(asked["question_id"], questions).to_numpy().astype(np.int64)[order]
    return questions, terms, starts, question, asked["weight"].to_numpy()[order]


def _best_of_pass(index: TextIndex, weighted: DataFrame, k: int, saturate: bool) -> DataFrame:
    bound_batches(weighted.sparkSession)
    scale = (index.k1, index.b, index.size[1]) if saturate else None
    shared = index.words.sparkSession.sparkContext.broadcast(_asked(weighted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, *held = shared.value
        if not len(questions):
            return
        best = Best(len(questions), k)
        rows = max(1, CELLS // len(questions))
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                best.add(_scores(part, *held, len(questions), scale), part.column(0).to_numpy(zero_copy_only=False))
        if len(best.question):
            yield best.rows(questions, batch.schema.field(0).type)

    kinds = [(df.schema[c].dataType.simpleString()) for df, c in ((weighted, "question_id"), (index.words, "key"))]
    chosen = index.words.select("key", "dl", "terms", "tfs")
    return chosen.mapInArrow(run, f"question_id {kinds[0]}, key {kinds[1]}, score double")


def _scores(
    part: pa.RecordBatch,
    terms: pa.Array,
    starts: np.ndarray,
    question: np.ndarray,
    weight: np.ndarray,
    n_questions: int,
    scale: tuple[float, float, float] | None,
) -> np.ndarray:
    """Scores of each question (row) and document (column); -inf where they share no
    term."""
    n = part.num_rows
    lists = part.column(2)
    row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    number = pc.fill_null(pc.index_in(lists.flatten(), terms), -1).to_numpy(zero_copy_only=False)
    known = number >= 0
    row, number = row[known], number[known]
    value = part.column(3).flatten().to_numpy(zero_copy_only=False)[known].astype(np.float64)
    if scale is not None:
        k1, b, mean = scale
        dl = part.column(1).to_numpy(zero_copy_only=False)
        value = value / (value + k1 * (1 - b + b * dl[row] / mean))
    return _added(row, number, value, starts, question, weight, n_questions, n)


def _added(
    row: np.ndarray,
    number: np.ndarray,
    value: np.ndarray,
    starts: np.ndarray,
    question: np.ndarray,
    weight: np.ndarray,
    n_questions: int,
    n: int,
) -> np.ndarray:
    """Scores from postings: the place of a document, the number of a term, and the
    term's part there."""
    total = np.zeros(n_questions * n)
    met = np.zeros(n_questions * n, bool)
    many = starts[number + 1] - starts[number]
    done = np.cumsum(many)
    at = 0
    while at < len(number):
        end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PRODUCTS, "right")))
        times = many[at:end]
        place = np.repeat(starts[number[at:end]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        cell = question[place] * n + np.repeat(row[at:end], times)
        total += np.bincount(cell, weight[place] * np.repeat(value[at:end], times), len(total))
        met[cell] = True
        at = end
    return np.where(met, total, -np.inf).reshape(n_questions, n)


class Best:
    """The k best documents of each question so far, by rounded score, then key."""

    def __init__(self, questions: int, k: int):
        self.k = k
        self.least = np.full(questions, -np.inf)
        self.question, self.score, self.key = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        if scores.shape[1] > self.k:
            cut = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
            # Scores are compared after rounding, so a little less may still count.
            self.least = np.maximum(self.least, cut - TOLERANCE)
        question, column = np.nonzero((scores >= self.least[:, None]) & (scores > -np.inf))
        scale = 10.0**SCORE_DIGITS
        score = np.concatenate([self.score, np.floor(scores[question, column] * scale + 0.5) / scale])
        key = keys[column] if self.key is None else np.concatenate([self.key, keys[column]])
        question = np.concatenate([self.question, question])
        place = np.unique(key, return_inverse=True)[1]
        order = np.lexsort((place, -score, question))
        question, score, key = question[order], score[order], key[order]
        rank = np.arange(len(question)) - np.searchsorted(question, np.arange(len(self.least)))[question]
        last = rank == self.k - 1
        self.least[question[last]] = np.maximum(self.least[question[last]], score[last] - TOLERANCE)
        keep = rank < self.k
        self.question, self.score, self.key = question[keep], score[keep], key[keep]

    def rows(self, questions: pa.Array, kind: pa.DataType) -> pa.RecordBatch:
        found = [questions.take(pa.array(self.question)), pa.array(self.key, kind), pa.array(self.score)]
        return pa.RecordBatch.from_arrays(found, ["question_id", "key", "score"])


# Matching rows (one per question term and document holding it) up to which
# every matching document is scored.
FULL_SCORING_ROWS = 2_000_000_000
# Ranges of each question, those with the largest bounds, that are scored first to
# learn what a good score is.
FIRST_RANGES = 4
# Scores are compared after rounding, so bounds give way by more than that.
TOLERANCE = 10.0 ** (1 - SCORE_DIGITS)


def bm25_top_k(
    index: TextIndex,
    questions: DataFrame,
    k: int = 5,
    stem: bool = False,
    full_scoring_rows: int = FULL_SCORING_ROWS,
) -> DataFrame:
    """question_id, key, score, rank of the k best documents per question.

    Where the questions match more than `full_scoring_rows` rows and the index has
    blocks, documents that cannot be among the k best are not read; the result is
    the same."""
    weighted = settled(weighted_terms(index, question_terms(questions, index.analyzer, stem)), "question-terms")
    if index.blocks is not None and (weighted.agg(F.sum("df")).first()[0] or 0) > full_scoring_rows:
        return pruned_top_k(index, weighted, k)
    return top_k(_local_best(index, weighted, k, saturate=True), k)


def bounds(index: TextIndex, weighted: DataFrame) -> DataFrame:
    """question_id, range, bound: the most that a document of a range can score, from
    the peaks of the blocks alone."""
    asked = checked(weighted.select("question_id", "term", "weight"))
    directory = _asked_blocks(index, weighted).select("term", "range", "peak")
    met = directory.join(asked.side, "term")
    return met.groupBy("question_id", "range").agg(F.sum(F.col("weight") * F.col("peak")).alias("bound"))


def _asked_blocks(index: TextIndex, weighted: DataFrame) -> DataFrame:
    """Blocks in the buckets of the asked terms, a filter on the folders that are read."""
    buckets = [row[0] for row in weighted.select(term_bucket(F.col("term"))).distinct().collect()]
    return index.blocks.where(F.col("bucket").isin(buckets) if buckets else F.lit(False))


def _range_best(index: TextIndex, weighted: DataFrame, ranges: DataFrame, k: int, shared: Side | None) -> DataFrame:
    """question_id, key, score of documents of some ranges of each question, which hold
    the best k of all."""
    weighted, ranges = weighted.select("question_id", "term", "weight"), ranges.select("question_id", "range")
    whole = ranges if shared is None else ranges.join(shared.side, "range", "left_anti")
    found = [_best_of_ranges(index, asked.where(part), whole.where(part), k) for asked, part in _passes(weighted)]
    if shared is not None:
        found.append(_summed_scores(index, weighted, ranges.join(shared.side, "range", "left_semi")))
    return reduce(DataFrame.unionByName, found)


def _best_of_ranges(index: TextIndex, weighted: DataFrame, ranges: DataFrame, k: int) -> DataFrame:
    """question_id, key, score of k documents for each question and task, from ranges
    whose documents have keys of their own.

    Blocks of a range meet in one task, once for all questions, so a document's scores
    are added up there and only the best leave the task."""
    spark, ranges = weighted.sparkSession, settled(ranges, "ranges")
    bound_batches(spark)
    questions, terms, *_ = asked = _asked(weighted)
    numbers = spark.createDataFrame(pa.table({"term": terms, "number": np.arange(len(terms), dtype=np.int32)}))
    wanted = settled(ranges.groupBy("range").agg(F.collect_list("question_id").alias("questions")), "wanted")
    blocks = _asked_blocks(index, weighted)
    per = lambda rows, n: rows.groupBy("question_id").agg(F.count("*").alias(n))
    pairs = per(ranges, "n").join(per(weighted, "m"), "question_id").agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    if (pairs or 0) <= BROADCAST_ROWS:
        met = ranges.join(weighted, "question_id").select("term", "range").distinct()
        blocks = blocks.join(F.broadcast(met), ["term", "range"], "left_semi")
    else:
        blocks = blocks.join(checked(wanted.select("range")).side, "range", "left_semi")
    columns = ["range", "number", "keys", "dls", "tfs", "questions"]
    blocks = blocks.join(F.broadcast(numbers), "term").withColumn("questions", F.lit(None).cast(wanted.schema["questions"].dataType))
    # A range's questions go before its blocks.
    heads = wanted.select("range", F.lit(-1).alias("number"), *(F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in columns[2:5]), "questions")
    rows = blocks.select(columns).unionByName(heads).repartition("range").sortWithinPartitions("range", "number")
    scale = (index.k1, index.b, index.size[1])
    shared = spark.sparkContext.broadcast((questions, *asked[2:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, *held = shared.value
        best = Best(len(questions), k)
        for rows in _whole_ranges(batches):
            for part in _few_ranges(rows, max(1, CELLS // (max(1, len(questions)) << RANGE_BITS))):
                scores, keys = _scores_of_blocks(part, questions, *held, scale)
                if len(keys):
                    best.add(scores, keys.to_numpy(zero_copy_only=False))
        if len(best.question):
            yield best.rows(questions, keys.type)

    kinds = [df.schema[c].dataType.simpleString() for df, c in ((weighted, "question_id"), (index.words, "key"))]
    return rows.mapInArrow(run, f"question_id {kinds[0]}, key {kinds[1]}, score double")


def _few_ranges(rows: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    starts = np.flatnonzero(np.diff(rows.column(0).to_numpy(zero_copy_only=False), prepend=-1))[::most].tolist()
    for first, end in zip(starts, [*starts[1:], rows.num_rows]):
        yield rows.slice(first, end - first)


def _scores_of_blocks(
    part: pa.RecordBatch,
    questions: pa.Array,
    starts: np.ndarray,
    question: np.ndarray,
    weight: np.ndarray,
    scale: tuple[float, float, float],
) -> tuple[np.ndarray, pa.Array]:
    """Scores of each question (row) and document (column) of some ranges, -inf where
    they share no term or the question does not look at the range; the documents."""
    number = part.column(1).to_numpy(zero_copy_only=False)
    ranges, own = np.unique(part.column(0).to_numpy(zero_copy_only=False), return_inverse=True)

    def lists(column: int, rows: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """For each value of these rows' lists the range, and the values."""
        chosen = part.column(column).filter(pa.array(rows))
        sizes = pc.list_value_length(chosen).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.repeat(np.flatnonzero(rows), sizes), chosen.flatten()

    row, asking = lists(5, number < 0)
    wants = np.zeros((len(questions), len(ranges)), bool)
    wants[pc.index_in(asking, questions).to_numpy(zero_copy_only=False), own[row]] = True
    row, keys = lists(2, number >= 0)
    coded = keys.dictionary_encode()
    place, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    dl, tf = (lists(c, number >= 0)[1].to_numpy(zero_copy_only=False).astype(np.float64) for c in (3, 4))
    k1, b, mean = scale
    scores = _added(place, number[row], tf / (tf + k1 * (1 - b + b * dl / mean)), starts, question, weight, len(questions), n)
    range_of = np.zeros(n, np.int64)
    range_of[place] = own[row]
    scores[~wants[:, range_of]] = -np.inf
    return scores, coded.dictionary


def _shared_ranges(index: TextIndex) -> Side | None:
    """Ranges, if any, with a document that has no key or one that others have too: its
    score is the sum over all of them, wherever they lie."""
    keys = settled(index.words.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    repeated = index.words.join(checked(keys).side, "key", "left_semi").select("range")
    ranges = repeated.unionByName(index.words.where(F.col("key").isNull()).select("range")).distinct()
    ranges = settled(ranges, "shared")
    return None if ranges.isEmpty() else checked(ranges)


def _summed_scores(index: TextIndex, weighted: DataFrame, ranges: DataFrame) -> DataFrame:
    """question_id, key, score of the documents of some ranges of each question, those
    of one key added up."""
    wanted = checked(settled(ranges.join(weighted, "question_id"), "look-ups"))
    met = _asked_blocks(index, weighted).select("term", "range", "keys", "dls", "tfs").join(wanted.side, ["term", "range"])
    rows = met.select("question_id", "weight", F.explode(F.arrays_zip("keys", "dls", "tfs")).alias("post"))
    rows = rows.select(
        "question_id", "weight", F.col("post.keys").alias("key"), F.col("post.dls").alias("dl"), F.col("post.tfs").alias("tf")
    )
    return rows.groupBy("question_id", "key").agg(F.sum(F.col("weight") * index.saturation()).alias("score"))


def pruned_top_k(index: TextIndex, weighted: DataFrame, k: int) -> DataFrame:
    """The k best documents per question from blocks. The ranges with the largest
    bounds are scored first; their k-th score is a floor, and of the other ranges
    only those are read whose bound reaches it."""
    shared = _shared_ranges(index)
    bounded = settled(bounds(index, weighted), "bounds")
    order = Window.partitionBy("question_id").orderBy(F.desc("bound"), "range")
    first = settled(bounded.withColumn("n", F.row_number().over(order)).where(F.col("n") <= FIRST_RANGES), "first")
    seeds = settled(top_k(_range_best(index, weighted, first, k, shared), k), "seeds")
    floors = seeds.groupBy("question_id").agg(F.min("score").alias("floor"), F.count("*").alias("n"))
    floors = floors.where(F.col("n") == k).select("question_id", "floor")
    rest = bounded.join(first.select("question_id", "range"), ["question_id", "range"], "left_anti")
    rest = rest.join(floors, "question_id", "left")
    rest = rest.where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - TOLERANCE))
    found = top_k(_range_best(index, weighted, rest, k, shared), k)
    return top_k(seeds.drop("rank").unionByName(found.drop("rank")), k)
