"""Queries over full-text, vector and hybrid search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom import hooks
from fathom.functions import text as analysis, vectors
from fathom.operators import fulltext, hybrid, knn
from fathom.plans.catalog import query, table, texts
from fathom.session import fresh_path, settled

K = 5


def words(column: str) -> str:
    """SQL list of the words of a text column."""
    return rf"list_filter(string_split_regex(lower({column}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '')"


# ---- full text -----------------------------------------------------------

TOKENS = f"WITH toks AS (SELECT doc_id AS key, {words('text')} AS w FROM documents)"
POSTINGS = TOKENS + """,
lens AS (SELECT key, CAST(len(w) AS INTEGER) AS dl FROM toks),
post AS (SELECT key, term, CAST(count(*) AS INTEGER) AS tf FROM (SELECT key, unnest(w) AS term FROM toks) GROUP BY key, term),
stat AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY term)
"""
QUESTION_TERMS = POSTINGS + f""",
qt AS (SELECT question_id, term, count(*) AS qtf
       FROM (SELECT item_id AS question_id, unnest({words('text')}) AS term FROM benchmark) GROUP BY question_id, term)
"""
BM25 = QUESTION_TERMS + """,
bm AS (
  SELECT question_id, key,
         round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM qt JOIN post USING (term) JOIN freq USING (term) JOIN lens USING (key), stat GROUP BY question_id, key),
bm_hits AS (
  SELECT question_id, key, score, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM bm)
  WHERE rank <= 5)
"""


def questions_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question")
    )


def stored_index(spark: SparkSession, sf: str) -> fulltext.TextIndex:
    docs = table(spark, sf, "documents")
    return fulltext.write_index(docs, fresh_path(spark, "text-index"), "doc_id")


def lazy_index(spark: SparkSession, sf: str) -> fulltext.TextIndex:
    return fulltext.build_index(table(spark, sf, "documents"), "doc_id")


@query(
    "analyze_standard",
    TOKENS + "SELECT key AS doc_id, CAST(len(w) AS INTEGER) AS n, array_to_string(w, ' ') AS words FROM toks",
)
def analyze_standard(spark: SparkSession, sf: str) -> DataFrame:
    return analyzed(spark, sf, "standard")


def analyzed(spark: SparkSession, sf: str, analyzer: str) -> DataFrame:
    tokens = analysis.ANALYZERS[analyzer](F.col("text"))
    rows = texts(spark, sf, "documents").select("doc_id", tokens.alias("w"))
    return rows.select("doc_id", F.size("w").alias("n"), F.array_join("w", " ").alias("words"))


STOPS = ", ".join(f"'{w}'" for w in analysis.STOP_WORDS)


@query(
    "analyze_english_unstemmed",
    TOKENS + f""", kept AS (SELECT key, list_filter(w, lambda x: x NOT IN ({STOPS})) AS w FROM toks)
    SELECT key AS doc_id, CAST(len(w) AS INTEGER) AS n, array_to_string(w, ' ') AS words FROM kept""",
)
def analyze_english_unstemmed(spark: SparkSession, sf: str) -> DataFrame:
    return analyzed(spark, sf, "english_unstemmed")


def _stem_sql() -> str:
    """CTEs that stem the distinct words of `vocabulary`(word), one for each step."""
    shape = lambda s: f"""list_reduce(list_prepend('', string_split({s}, '')), lambda a, x: a || CASE
        WHEN x = '' THEN '' WHEN x IN ('a', 'e', 'i', 'o', 'u') OR x = 'y' AND a LIKE '%c' THEN 'v' ELSE 'c' END)"""  # noqa: E731
    measure = lambda s: f"len(regexp_extract_all({shape(s)}, 'vc'))"
    cut = lambda n: f"left(w, length(w) - {n})"
    doubled = lambda s: f"(length({s}) > 1 AND right({s}, 1) = left(right({s}, 2), 1) AND {shape(s)} LIKE '%c')"
    short = lambda s: f"({shape(s)} LIKE '%cvc' AND right({s}, 1) NOT IN ('w', 'x', 'y'))"

    def longest(name: str, source: str, rules, condition: str) -> str:
        """The longest suffix of a list that a word ends with, swapped if what is left allows it."""
        pairs = ", ".join(f"('{s}', '{r}')" for s, r in rules)
        return f"""
    {name} AS (
      SELECT word, long_enough, CASE WHEN suffix IS NOT NULL AND ({condition}) THEN stem || new ELSE w END AS w
      FROM (SELECT s.*, b.suffix, b.new, left(w, length(w) - length(b.suffix)) AS stem FROM {source} s LEFT JOIN (
        SELECT word, arg_max(suffix, length(suffix)) AS suffix, arg_max(new, length(suffix)) AS new
        FROM {source} JOIN (VALUES {pairs}) r(suffix, new) ON ends_with(w, suffix) GROUP BY word) b USING (word)))"""

    steps = [f"""
    plural AS (
      SELECT word, length(word) > 2 AS long_enough, CASE WHEN word LIKE '%sses' OR word LIKE '%ies' THEN left(word, length(word) - 2)
        WHEN word LIKE '%s' AND word NOT LIKE '%ss' THEN left(word, length(word) - 1) ELSE word END AS w FROM vocabulary),
    past AS (
      SELECT word, long_enough, w AS whole, CASE WHEN w LIKE '%eed' THEN CASE WHEN {measure(cut(3))} > 0 THEN {cut(1)} ELSE w END
        WHEN w LIKE '%ed' AND {shape(cut(2))} LIKE '%v%' THEN {cut(2)}
        WHEN w LIKE '%ing' AND {shape(cut(3))} LIKE '%v%' THEN {cut(3)} ELSE w END AS w FROM plural),
    mended AS (
      SELECT word, long_enough, CASE WHEN w = whole OR whole LIKE '%eed' THEN w WHEN w LIKE '%at' OR w LIKE '%bl' OR w LIKE '%iz' THEN w || 'e'
        WHEN {doubled("w")} AND right(w, 1) NOT IN ('l', 's', 'z') THEN {cut(1)}
        WHEN {doubled("w")} THEN CASE WHEN {measure("w")} = 1 AND {short("w")} THEN w || 'e' ELSE w END
        WHEN {measure("w")} = 1 AND {short("w")} THEN w || 'e' ELSE w END AS w FROM past),
    vowelled AS (
      SELECT word, long_enough, CASE WHEN w LIKE '%y' AND {shape(cut(1))} LIKE '%v%' THEN {cut(1)} || 'i' ELSE w END AS w FROM mended)"""]
    steps.append(longest("second", "vowelled", analysis.STEP_2, f"{measure('stem')} > 0"))
    steps.append(longest("third", "second", analysis.STEP_3, f"{measure('stem')} > 0"))
    gone = f"{measure('stem')} > 1 AND (suffix <> 'ion' OR stem LIKE '%s' OR stem LIKE '%t')"
    steps.append(longest("fourth", "third", [(s, "") for s in analysis.STEP_4], gone))
    steps.append(f"""
    fifth AS (
      SELECT word, long_enough, CASE WHEN w LIKE '%e' AND ({measure(cut(1))} > 1 OR {measure(cut(1))} = 1 AND NOT {short(cut(1))})
        THEN {cut(1)} ELSE w END AS w FROM fourth),
    stems AS (
      SELECT word, CASE WHEN NOT long_enough THEN word WHEN w LIKE '%l' AND {doubled("w")} AND {measure("w")} > 1 THEN {cut(1)}
        ELSE w END AS stem FROM fifth)""")
    return ",".join(steps)


BARE = r"""regexp_replace(text, '[''’＇][sS]([^\p{L}\p{M}\p{N}]|$)', '\1', 'g')"""
ENGLISH = f"""
WITH kept AS (SELECT doc_id AS key, list_filter({words(BARE)}, lambda x: x NOT IN ({STOPS})) AS w FROM documents),
vocabulary AS (SELECT DISTINCT unnest(w) AS word FROM kept),""" + _stem_sql() + """,
placed AS (SELECT key, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM kept)
"""


@query(
    "analyze_english",
    ENGLISH + """SELECT kept.key AS doc_id, CAST(len(w) AS INTEGER) AS n, coalesce(words, '') AS words FROM kept LEFT JOIN (
      SELECT key, string_agg(stem, ' ' ORDER BY i) AS words FROM placed JOIN stems USING (word) GROUP BY key) USING (key)""",
)
def analyze_english(spark: SparkSession, sf: str) -> DataFrame:
    return analyzed(spark, sf, "english")


@query("postings", POSTINGS + "SELECT key, dl, term, tf FROM post JOIN lens USING (key)")
def postings(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.postings(table(spark, sf, "documents"), "doc_id", "text")


@query("doc_freq", POSTINGS + "SELECT term, df FROM freq")
def doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.document_frequency(postings(spark, sf))


@query("idf", POSTINGS + "SELECT term, df, round(ln(n / df), 6) AS idf FROM freq, stat")
def idf(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.inverse_frequency(lazy_index(spark, sf)).withColumn("idf", F.round("idf", 6))


@query("match_any", QUESTION_TERMS + "SELECT DISTINCT key FROM post WHERE term IN (SELECT term FROM qt)")
def match_any(spark: SparkSession, sf: str) -> DataFrame:
    terms = fulltext.question_terms(questions_of(spark, sf))
    return fulltext.match_any(lazy_index(spark, sf), terms)


@query(
    "tfidf_topk",
    QUESTION_TERMS + """, s AS (
      SELECT question_id, key, round(sum(qtf * tf * ln(n / df)), 6) AS score
      FROM qt JOIN post USING (term) JOIN freq USING (term), stat GROUP BY question_id, key)
    SELECT question_id, key, score, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM s)
    WHERE rank <= 5""",
)
def tfidf_topk(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.tfidf_top_k(stored_index(spark, sf), questions_of(spark, sf), K)


@query("bm25_topk", BM25 + "SELECT question_id, key, score, rank FROM bm_hits")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.bm25_top_k(stored_index(spark, sf), questions_of(spark, sf), K)


@query("bm25_topk_pruned", BM25 + "SELECT question_id, key, score, rank FROM bm_hits")
def bm25_topk_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """From stored blocks of postings: those in the buckets of the asked terms, and of
    these only ranges of documents that can still get in."""
    docs, path = table(spark, sf, "documents"), fresh_path(spark, "text-index")
    index = fulltext.write_index(docs, path, "doc_id", blocks=True)
    return fulltext.bm25_top_k(index, questions_of(spark, sf), K, full_scoring_rows=0)


@query(
    "bm25_english",
    ENGLISH + f""",
    post AS (SELECT key, stem AS term, CAST(count(*) AS INTEGER) AS tf FROM placed JOIN stems USING (word) GROUP BY key, stem),
    lens AS (SELECT key, len(w) AS dl FROM kept), stat AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
    freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    qt AS (SELECT question_id, term, count(*) AS qtf FROM (
      SELECT item_id AS question_id, unnest(list_filter({words(BARE)}, lambda x: x NOT IN ({STOPS}))) AS term FROM benchmark)
      GROUP BY question_id, term),
    bm AS (SELECT question_id, key,
        round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
      FROM qt JOIN post USING (term) JOIN freq USING (term) JOIN lens USING (key), stat GROUP BY question_id, key)
    SELECT question_id, key, score, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM bm)
    WHERE rank <= 5""",
)
def bm25_english(spark: SparkSession, sf: str) -> DataFrame:
    """Documents are stemmed, questions are not."""
    docs = table(spark, sf, "documents")
    index = fulltext.write_index(docs, fresh_path(spark, "text-index"), "doc_id", analyzer="english")
    return fulltext.bm25_top_k(index, questions_of(spark, sf), K)


# ---- vectors -------------------------------------------------------------

NEXT = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
A, B = "CAST(a.embedding AS DOUBLE[])", "CAST(b.embedding AS DOUBLE[])"
SQUARED = f"list_sum(list_transform(list_zip({A}, {B}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector beside the one with the next id."""
    rows = table(spark, sf, "embeddings")
    a = rows.select("vec_id", F.col("embedding").alias("x"))
    b = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id")


def distance(spark: SparkSession, sf: str, name: str, measure) -> DataFrame:
    return neighbours(spark, sf).select(
        "vec_id", F.round(measure(F.col("x"), F.col("y")), 6).alias(name)
    )


@query("dist_l2", f"SELECT a.vec_id, round({SQUARED}, 6) AS l2 {NEXT}")
def dist_l2(spark: SparkSession, sf: str) -> DataFrame:
    return distance(spark, sf, "l2", vectors.squared_l2)


@query("dist_dot", f"SELECT a.vec_id, round(list_dot_product({A}, {B}), 6) AS dot {NEXT}")
def dist_dot(spark: SparkSession, sf: str) -> DataFrame:
    return distance(spark, sf, "dot", vectors.dot)


@query("dist_cosine", f"SELECT a.vec_id, round(1 - list_cosine_similarity({A}, {B}), 6) AS cosine {NEXT}")
def dist_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return distance(spark, sf, "cosine", vectors.cosine_distance)


def chunks_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), "embedding")


@query(
    "knn_single",
    f"""SELECT b.vec_id AS key, round(list_cosine_similarity({A}, {B}), 6) AS score FROM embeddings b,
      (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) a ORDER BY score DESC, key LIMIT 5""",
)
def knn_single(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunks_of(spark, sf)
    asked = chunks.orderBy("key").first()["embedding"]
    return knn.nearest_to_one(chunks, asked, K).select("key", "score")


def nearest(
    measure: str, asked: str = "embeddings", asked_id: str = "a.vec_id", held: str = "embeddings"
) -> str:
    """SQL of the five nearest chunks of every asked vector."""
    return f"""SELECT question_id, key, score, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM (
        SELECT {asked_id} AS question_id, b.vec_id AS key, round({measure}, 6) AS score FROM {asked} a, {held} b))
      WHERE rank <= 5"""


COSINE = f"list_cosine_similarity({A}, {B})"


def asked_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return chunks_of(spark, sf).withColumnRenamed("key", "question_id")


@query("knn_batch", nearest(COSINE))
def knn_batch(spark: SparkSession, sf: str) -> DataFrame:
    return knn.exact(chunks_of(spark, sf), asked_vectors(spark, sf), K)


@query("knn_batch_dot", nearest(f"list_dot_product({A}, {B})"))
def knn_batch_dot(spark: SparkSession, sf: str) -> DataFrame:
    return knn.exact(chunks_of(spark, sf), asked_vectors(spark, sf), K, "dot")


@query("knn_batch_l2", nearest(f"-{SQUARED}"))
def knn_batch_l2(spark: SparkSession, sf: str) -> DataFrame:
    return knn.exact(chunks_of(spark, sf), asked_vectors(spark, sf), K, "l2")


@query("knn_ivf")
def knn_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the cells are read for each question."""
    chunks, path = chunks_of(spark, sf), fresh_path(spark, "ivf")
    knn.write_ivf(chunks, knn.train_ivf(chunks), path)
    return knn.search_ivf(spark, path, asked_vectors(spark, sf), nprobe=16, k=K)


GIVEN_CELLS, GIVEN_PROBES = 16, 4


@query(
    "knn_ivf_given",
    f"""WITH c AS (SELECT vec_id AS cell, embedding FROM embeddings ORDER BY vec_id LIMIT {GIVEN_CELLS}),
    near AS (
      SELECT a.vec_id, b.cell, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.cell) AS n
      FROM embeddings a, c b),
    met AS (
      SELECT q.vec_id AS question_id, h.vec_id AS key FROM near q JOIN near h USING (cell)
      WHERE q.n <= {GIVEN_PROBES} AND h.n = 1)
    SELECT question_id, key, score, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM (
        SELECT question_id, key, round({COSINE}, 6) AS score
        FROM met JOIN embeddings a ON a.vec_id = question_id JOIN embeddings b ON b.vec_id = key))
    WHERE rank <= {K}""",
)
def knn_ivf_given(spark: SparkSession, sf: str) -> DataFrame:
    """Cells around given centers, the vectors with the smallest ids."""
    chunks = chunks_of(spark, sf)
    first = chunks.orderBy("key").limit(GIVEN_CELLS).toPandas()["embedding"]
    cells = knn.Cells("cosine", knn.project(np.stack(first.to_list()), "cosine"))
    return knn.ivf(chunks, asked_vectors(spark, sf), cells, GIVEN_PROBES, K)


@query("knn_half", nearest(COSINE))
def knn_half(spark: SparkSession, sf: str) -> DataFrame:
    """Stored in half precision; few rows are scored on their own vectors."""
    path = fresh_path(spark, "half")
    knn.write_half(chunks_of(spark, sf), path)
    return knn.search_half(spark, path, asked_vectors(spark, sf), K)


@query("knn_half_l2", nearest(f"-{SQUARED}"))
def knn_half_l2(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "half")
    knn.write_half(chunks_of(spark, sf), path, "l2")
    return knn.search_half(spark, path, asked_vectors(spark, sf), K)


@query("knn_lsh")
def knn_lsh(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunks_of(spark, sf)
    dim = chunks.select(F.size("embedding")).first()[0]
    return knn.lsh(chunks, asked_vectors(spark, sf), knn.Projections.draw(dim), K)


@query(
    "hit_attributes",
    f"SELECT question_id, key, score, rank, lang, source FROM ({nearest(COSINE)}) JOIN documents ON doc_id = key",
)
def hit_attributes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "lang", "source")
    return knn.attach_fields(knn_batch(spark, sf), docs)


HALF = """CASE WHEN x = 0 THEN 0.0
  ELSE round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END"""


@query(
    "quantize_f16",
    f"""SELECT vec_id, pos, CAST({HALF} AS DOUBLE) AS value FROM (
      SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS x
      FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i))""",
)
def quantize_f16(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", vectors.to_half("embedding").alias("half"))
    return rows.select("vec_id", F.posexplode("half").alias("pos", "value")).withColumn(
        "value", F.col("value").cast("double")
    )


@query(
    "validate_vectors",
    "SELECT vec_id, label NOT IN (3, 5, 7) AS valid FROM embeddings",
)
def validate_vectors(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = knn.validate(damaged_vectors(spark, sf), 64)
    return good.select("vec_id", F.lit(True).alias("valid")).unionByName(
        bad.select("vec_id", F.lit(False).alias("valid"))
    )


def damaged_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of three labels are damaged: too short, NaN, a null."""
    v, label = F.col("embedding"), F.col("label")
    tail = F.slice(v, 2, 63)
    nothing = F.lit(None).cast("float")
    damaged = (
        F.when(label == 3, tail)
        .when(label == 5, F.concat(F.array(F.lit(float("nan")).cast("float")), tail))
        .when(label == 7, F.concat(F.array(nothing), tail))
        .otherwise(v)
    )
    return table(spark, sf, "embeddings").select("vec_id", damaged.alias("embedding"))


SOUND = "(SELECT * FROM embeddings WHERE label NOT IN (3, 5, 7))"


def knn_dirty(spark: SparkSession, sf: str, metric: str) -> DataFrame:
    """Exact search over damaged vectors: the sound rows find each other."""
    rows = damaged_vectors(spark, sf).withColumnRenamed("vec_id", "key")
    return knn.exact(rows, rows.withColumnRenamed("key", "question_id"), K, metric)


@query("knn_batch_dirty", nearest(COSINE, SOUND, held=SOUND))
def knn_batch_dirty(spark: SparkSession, sf: str) -> DataFrame:
    return knn_dirty(spark, sf, "cosine")


@query("knn_batch_dirty_dot", nearest(f"list_dot_product({A}, {B})", SOUND, held=SOUND))
def knn_batch_dirty_dot(spark: SparkSession, sf: str) -> DataFrame:
    return knn_dirty(spark, sf, "dot")


@query("knn_batch_dirty_l2", nearest(f"-{SQUARED}", SOUND, held=SOUND))
def knn_batch_dirty_l2(spark: SparkSession, sf: str) -> DataFrame:
    return knn_dirty(spark, sf, "l2")


@query(
    "embed_text",
    POSTINGS + """,
    cells AS (SELECT key, bucket, sum(tf) AS n FROM (
      SELECT key, tf, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 256 AS bucket FROM post) GROUP BY key, bucket),
    rare AS (SELECT bucket, ln(((SELECT n FROM stat) + 1) / (count(*) + 1)) AS idf FROM cells GROUP BY bucket),
    held AS (SELECT key, sqrt(sum(pow(n * idf, 2))) AS size, max(n * idf) AS top FROM cells JOIN rare USING (bucket) GROUP BY key)
    SELECT lens.key AS doc_id, CAST(256 AS INTEGER) AS dim, CAST(CASE WHEN size > 0 THEN 1 ELSE 0 END AS DOUBLE) AS length,
      round(CAST(CAST(CASE WHEN size > 0 THEN top / size ELSE 0 END AS FLOAT) AS DOUBLE), 6) AS largest
    FROM lens LEFT JOIN held USING (key)""",
)
def embed_text(spark: SparkSession, sf: str) -> DataFrame:
    embedded = hooks.hashed_embedding(texts(spark, sf, "documents"), "text")
    return embedded.select(
        "doc_id",
        F.size("embedding").alias("dim"),
        F.round(vectors.norm(F.col("embedding")), 4).alias("length"),
        F.round(F.array_max("embedding").cast("double"), 6).alias("largest"),
    )


def letters():
    """A small embedding: characters, spaces and e's of a text."""

    def encode(texts):
        return np.array([[len(t), t.count(" "), t.count("e")] for t in texts], np.float32)

    return encode


@query(
    "embed_hook",
    """SELECT doc_id, CAST(length(text) + 3 AS DOUBLE) AS size,
      CAST(length(text) - length(replace(text, ' ', '')) + 1 AS DOUBLE) AS spaces,
      CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS es FROM documents""",
)
def embed_hook(spark: SparkSession, sf: str) -> DataFrame:
    """A model's function embeds the texts, with its prompt before them."""
    embed = hooks.embedder(letters, prompt="q: ")
    rows = texts(spark, sf, "documents").select("doc_id", embed(F.col("text")).alias("v"))
    return rows.select("doc_id", *(F.col("v")[i].cast("double").alias(n) for i, n in enumerate(("size", "spaces", "es"))))


# ---- hybrid --------------------------------------------------------------

CODE = "CASE item_id % 4 WHEN 0 THEN 'VEC' WHEN 1 THEN 'FT' WHEN 2 THEN 'VEC_FT' ELSE 'xyz' END"
TYPE = f"CASE {CODE} WHEN 'VEC' THEN 'vector' WHEN 'FT' THEN 'fulltext' ELSE 'hybrid' END"


def mixed_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts as questions of all search types."""
    kind = F.col("item_id") % 4
    code = F.when(kind == 0, "VEC").when(kind == 1, "FT").when(kind == 2, "VEC_FT").otherwise("xyz")
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"), code.alias("search_type")
    )


def embedded(spark: SparkSession, sf: str) -> tuple[DataFrame, hooks.HashedEmbedding]:
    """Every document with its vector, and what questions are embedded by."""
    docs = texts_of(spark, sf)
    embedding = hooks.HashedEmbedding.fit(docs, "text")
    return settled(embedding.embed(docs, "text").select("key", "embedding"), "vectors"), embedding


def texts_of(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text")


@query(
    "search_type",
    f"""SELECT item_id AS question_id, {TYPE} AS search_type,
      CASE item_id % 3 WHEN 0 THEN 'VEC' WHEN 1 THEN 'FT' ELSE 'VEC_FT' END AS code FROM benchmark""",
)
def search_type(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.col("question_id") % 3
    label = F.when(shown == 0, "vector only").when(shown == 1, "fulltext only").otherwise("hybrid")
    return mixed_questions(spark, sf).select(
        "question_id",
        hybrid.search_type(F.col("search_type")).alias("search_type"),
        hybrid.code_of_label(label).alias("code"),
    )


@query("valid_questions", "SELECT conv_id, turn FROM conversations WHERE role <> 'system' AND text <> ''")
def valid_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as questions; those of one role count as empty."""
    typed = F.when(F.col("role") == "system", "").otherwise(F.col("text"))
    rows = table(spark, sf, "conversations").withColumn("question", typed)
    return hybrid.valid_questions(rows).select("conv_id", "turn")


@query(
    "route_questions",
    f"""WITH q AS (SELECT item_id AS question_id, {TYPE} AS kind FROM benchmark)
    SELECT question_id, 'vector' AS branch FROM q WHERE kind <> 'fulltext'
    UNION ALL SELECT question_id, 'fulltext' AS branch FROM q WHERE kind <> 'vector'""",
)
def route_questions(spark: SparkSession, sf: str) -> DataFrame:
    asked = mixed_questions(spark, sf)

    def branch(name: str) -> DataFrame:
        return hybrid.route(asked, name).select("question_id", F.lit(name).alias("branch"))

    return branch(hybrid.VECTOR).unionByName(branch(hybrid.FULLTEXT))


# Vectors of documents and questions, one row for each component that is not zero.
VECTORS = BM25 + """,
bucketed AS (SELECT DISTINCT term, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 256 AS bucket
             FROM (SELECT term FROM post UNION ALL SELECT term FROM qt)),
doc_cells AS (SELECT key, bucket, sum(tf) AS c FROM post JOIN bucketed USING (term) GROUP BY key, bucket),
asked_cells AS (SELECT question_id, bucket, sum(qtf) AS c FROM qt JOIN bucketed USING (term) GROUP BY question_id, bucket),
held_in AS (SELECT bucket, count(*) AS held FROM doc_cells GROUP BY bucket),
rare AS (SELECT bucket, ln((n + 1) / (coalesce(held, 0) + 1)) AS idf
         FROM (SELECT DISTINCT bucket FROM bucketed) LEFT JOIN held_in USING (bucket), stat),
doc_vec AS (SELECT key, bucket, CAST(CAST(c * idf / sqrt(sum(pow(c * idf, 2)) OVER (PARTITION BY key)) AS FLOAT) AS DOUBLE) AS v
            FROM doc_cells JOIN rare USING (bucket) WHERE idf > 0),
asked_vec AS (SELECT question_id, bucket, CAST(CAST(c * idf / sqrt(sum(pow(c * idf, 2)) OVER (PARTITION BY question_id)) AS FLOAT) AS DOUBLE) AS v
              FROM asked_cells JOIN rare USING (bucket) WHERE idf > 0),
doc_size AS (SELECT key, sqrt(sum(v * v)) AS size FROM doc_vec GROUP BY key),
asked_size AS (SELECT question_id, sqrt(sum(v * v)) AS size FROM asked_vec GROUP BY question_id),
alike AS (SELECT question_id, key, sum(a.v * d.v) AS dot FROM asked_vec a JOIN doc_vec d USING (bucket) GROUP BY question_id, key),
near AS (SELECT question_id, toks.key, round(coalesce(dot / a.size / d.size, 0), 6) AS score
         FROM asked_size a CROSS JOIN toks LEFT JOIN doc_size d USING (key) LEFT JOIN alike USING (question_id, key)),
all_vec_hits AS (SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM near) WHERE rank <= 5)
"""
UNION = VECTORS + f""",
q AS (SELECT item_id AS question_id, text AS question, {TYPE} AS kind FROM benchmark),
vec_hits AS (SELECT * FROM all_vec_hits),
hits AS (
  SELECT h.*, 'vector' AS source, 0 AS source_order FROM vec_hits h JOIN q USING (question_id) WHERE kind <> 'fulltext'
  UNION ALL
  SELECT h.*, 'fulltext' AS source, 1 AS source_order FROM bm_hits h JOIN q USING (question_id) WHERE kind <> 'vector')
"""
OVERLAP = f"""len(list_intersect(list_distinct({words('question')}), {words('text')}))
  / nullif(len(list_distinct({words('question')})), 0)"""
RERANKED = UNION + f""",
scored AS (
  SELECT h.question_id, h.key, h.score AS index_score, h.source, h.source_order, h.rank AS source_rank, q.question, d.text,
         coalesce({OVERLAP}, 0) * 20 - 10 AS logit
  FROM hits h JOIN q USING (question_id) JOIN documents d ON d.doc_id = h.key),
reranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source_order, source_rank) AS INTEGER) AS rank
  FROM (SELECT *, round_even((logit + 10) / 20, 4) AS score FROM scored))
"""


@query("hybrid_union", UNION + "SELECT question_id, key, score, rank, source, source_order FROM hits")
def hybrid_union(spark: SparkSession, sf: str) -> DataFrame:
    asked, (chunks, embedding) = mixed_questions(spark, sf), embedded(spark, sf)
    return hybrid.search_branches(chunks, stored_index(spark, sf), asked, K, embedding=embedding)


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid.with_texts(
        hybrid_union(spark, sf), mixed_questions(spark, sf), texts_of(spark, sf)
    )


@query(
    "rerank_scores",
    RERANKED + "SELECT question_id, key, source, round(logit, 6) AS logit FROM scored",
)
def rerank_scores(spark: SparkSession, sf: str) -> DataFrame:
    logit = hybrid.overlap_logit(F.col("question"), F.col("text"))
    return candidates(spark, sf).select("question_id", "key", "source", F.round(logit, 6).alias("logit"))


@query(
    "normalize_scores",
    """SELECT vec_id, pos, round_even((x * 20 + 10) / 20, 4) AS score FROM (
      SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS x
      FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i))""",
)
def normalize_scores(spark: SparkSession, sf: str) -> DataFrame:
    values = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode(values).alias("pos", "x"))
    return rows.select("vec_id", "pos", hybrid.normalize_score(F.col("x") * 20).alias("score"))


@query(
    "rerank_topk",
    RERANKED + "SELECT question_id, key, source, score, index_score, rank FROM reranked WHERE rank <= 5",
)
def rerank_topk(spark: SparkSession, sf: str) -> DataFrame:
    return (
        hybrid.rerank(candidates(spark, sf))
        .where(F.col("rank") <= K)
        .select("question_id", "key", "source", "score", "index_score", "rank")
    )


@query(
    "hybrid_norerank",
    UNION + """SELECT question_id, key, source, score, rank FROM (
      SELECT question_id, key, source, score,
             CAST(row_number() OVER (PARTITION BY question_id ORDER BY source_order, rank) AS INTEGER) AS rank FROM hits)
      WHERE rank <= 5""",
)
def hybrid_norerank(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid_contexts(spark, sf, reranking=False).select("question_id", "key", "source", "score", "rank")


def hybrid_contexts(spark: SparkSession, sf: str, reranking: bool = True) -> DataFrame:
    chunks, embedding = embedded(spark, sf)
    return hybrid.search(
        chunks, stored_index(spark, sf), mixed_questions(spark, sf), texts_of(spark, sf), K,
        reranking=reranking, embedding=embedding,
    )


@query(
    "hybrid_search",
    RERANKED + "SELECT question_id, question, key, text, source, score, index_score, rank FROM reranked WHERE rank <= 5",
)
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid_contexts(spark, sf)


@query("vector_search", VECTORS + "SELECT question_id, key, score, rank FROM all_vec_hits")
def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    """Questions against every document by vectors of their texts."""
    chunks, embedding = embedded(spark, sf)
    return knn.exact(chunks, embedding.embed(mixed_questions(spark, sf), "question"), K)


def shared_words():
    """A small reranker: distinct words that both texts hold, ten at most."""

    def score(questions, contexts):
        return np.array([min(len(set(q.split(" ")) & set(c.split(" "))), 10) for q, c in zip(questions, contexts)], np.float64)

    return score


@query(
    "rerank_hook",
    BM25 + """SELECT question_id, key, CAST(round_even((shared + 10) / 20, 4) AS DOUBLE) AS score, rank FROM (
      SELECT question_id, key, shared, CAST(row_number() OVER (PARTITION BY question_id ORDER BY shared DESC, rank) AS INTEGER) AS rank
      FROM (SELECT question_id, key, h.rank, least(10, len(list_intersect(list_distinct(string_split(b.text, ' ')),
              list_distinct(string_split(d.text, ' '))))) AS shared
            FROM bm_hits h JOIN benchmark b ON item_id = question_id JOIN documents d ON doc_id = key))""",
)
def rerank_hook(spark: SparkSession, sf: str) -> DataFrame:
    """A model's function scores the pairs."""
    hits = bm25_topk(spark, sf).withColumn("source_order", F.lit(0))
    pairs = hybrid.with_texts(hits, questions_of(spark, sf), texts_of(spark, sf))
    return hybrid.rerank(pairs, hooks.scorer(shared_words)).select("question_id", "key", "score", "rank")


@query("return_fields", BM25 + "SELECT key, lang, source, score FROM bm_hits JOIN documents ON doc_id = key")
def return_fields(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "key")
    found = knn.attach_fields(bm25_topk(spark, sf), docs)
    return hybrid.return_fields(found, ["key", "lang", "source"])
