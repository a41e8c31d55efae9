"""Search operators against brute force on small, skewed data."""

import math
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F, types as T

from fathom import hooks
from fathom.functions import vectors
from fathom.operators import fulltext, hybrid, knn
from fathom.session import fresh_path


# ---- full text -----------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents where one word is everywhere, a third are copies and some are
    empty."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(300):
        if i % 3 == 0:
            docs.append((i, "the w1 w2 w3 copy"))
        elif i % 50 == 1:
            docs.append((i, " .. "))
        else:
            docs.append((i, "the " + " ".join(rng.choice(words, 1 + i % 17))))
    asked = [(q, "the the " + " ".join(rng.choice(words, 3))) for q in range(20)] + [(90, "the"), (91, "zz")]
    return docs, asked


def brute_bm25(docs, asked, k):
    bags = {i: Counter(t.replace(".", "").split()) for i, t in docs}
    sizes = {i: sum(b.values()) for i, b in bags.items()}
    mean, n = sum(sizes.values()) / len(sizes), len(docs)
    df = Counter(w for b in bags.values() for w in b)
    out = set()
    for q, t in asked:
        scores = {}
        for w, qtf in Counter(t.split()).items():
            for i, b in bags.items():
                if w in b:
                    idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    part = qtf * idf * b[w] / (b[w] + 1.2 * (0.25 + 0.75 * sizes[i] / mean))
                    scores[i] = scores.get(i, 0) + part
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]
        out |= {(q, i, rank) for rank, (i, _) in enumerate(best, 1)}
    return out


def frames(spark, corpus):
    docs, asked = corpus
    return (
        spark.createDataFrame(docs, "key bigint, text string").repartition(4),
        spark.createDataFrame(asked, "question_id bigint, question string"),
    )


@pytest.mark.parametrize("rows", [0, 10**9])
@pytest.mark.parametrize("k", [1, 5, 150])
def test_bm25_is_brute_force_with_and_without_early_exits(spark, corpus, rows, k):
    docs, asked = frames(spark, corpus)
    index = fulltext.write_index(docs, fresh_path(spark, "test-index"), blocks=True)
    found = fulltext.bm25_top_k(index, asked, k, full_scoring_rows=rows)
    assert {(r.question_id, r.key, r["rank"]) for r in found.collect()} == brute_bm25(*corpus, k)


def test_scores_in_several_passes_and_slices(spark, corpus, monkeypatch):
    """Few questions a pass, few scores and products held at once."""
    monkeypatch.setattr(fulltext, "QUESTIONS", 4)
    monkeypatch.setattr(fulltext, "CELLS", 60)
    monkeypatch.setattr(fulltext, "PRODUCTS", 7)
    docs, asked = frames(spark, corpus)
    found = fulltext.bm25_top_k(fulltext.build_index(docs), asked, 5)
    assert {(r.question_id, r.key, r["rank"]) for r in found.collect()} == brute_bm25(*corpus, 5)


def test_tasks_hand_on_k_documents_for_each_question(spark, corpus):
    docs, asked = frames(spark, corpus)
    index = fulltext.write_index(docs, fresh_path(spark, "test-index"))
    weighted = fulltext.weighted_terms(index, fulltext.question_terms(asked))
    local = fulltext._local_best(index, weighted, 3, saturate=True)
    per = local.groupBy(F.spark_partition_id().alias("task"), "question_id").count().collect()
    assert max(r["count"] for r in per) == 3
    # Nothing but these is exchanged: the scores' own plan has no exchange.
    assert "Exchange" not in local._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_tfidf_is_brute_force(spark, corpus):
    docs, asked = frames(spark, corpus)
    bags = {i: Counter(t.replace(".", "").split()) for i, t in corpus[0]}
    df = Counter(w for b in bags.values() for w in b)
    want = set()
    for q, t in corpus[1]:
        scores = {}
        for w, qtf in Counter(t.split()).items():
            for i, b in bags.items():
                if w in b:
                    scores[i] = scores.get(i, 0) + qtf * b[w] * math.log(len(bags) / df[w])
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:4]
        want |= {(q, i, rank) for rank, (i, _) in enumerate(best, 1)}
    found = fulltext.tfidf_top_k(fulltext.build_index(docs), asked, 4)
    assert {(r.question_id, r.key, r["rank"]) for r in found.collect()} == want


def test_blocks_are_read_by_bucket_and_bound(spark):
    """Only folders of the asked terms' buckets are read, and of a common term only
    the ranges that can still get in."""
    docs = [(i, f"common filler{i % 7} own{i}" + (" rare" if i in (5, 700) else "")) for i in range(1000)]
    frame = spark.createDataFrame(docs, "key bigint, text string").coalesce(1)
    index = fulltext.write_index(frame, fresh_path(spark, "test-index"), blocks=True)
    asked = spark.createDataFrame([(1, "rare common")], "question_id bigint, question string")
    weighted = fulltext.weighted_terms(index, fulltext.question_terms(asked))
    plan = fulltext._asked_blocks(index, weighted)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(", "")
    found = fulltext.bm25_top_k(index, asked, 2, full_scoring_rows=0).collect()
    assert [(r.key, r["rank"]) for r in found] == [(5, 1), (700, 2)]
    bounded = fulltext.bounds(index, weighted).collect()
    floor = min(r.score for r in found)
    # 16 ranges hold the common term; two can still reach the second best score.
    assert len(bounded) == 16 and sum(r.bound >= floor - fulltext.TOLERANCE for r in bounded) == 2


def test_scores_of_ranges_stay_where_their_blocks_meet(spark, corpus):
    """Postings are not exploded into a row for each question, and a task hands on k
    documents for each question."""
    docs, asked = frames(spark, corpus)
    index = fulltext.write_index(docs, fresh_path(spark, "test-index"), blocks=True)
    found = fulltext.bm25_top_k(index, asked, 3, full_scoring_rows=0)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    weighted = fulltext.weighted_terms(index, fulltext.question_terms(asked))
    ranges = fulltext.bounds(index, weighted)
    best = fulltext._range_best(index, weighted, ranges, 3, None)
    per = best.groupBy(F.spark_partition_id().alias("task"), "question_id").count().collect()
    assert max(r["count"] for r in per) == 3


@pytest.mark.parametrize("pairs", [0, 10**6])
def test_ranges_in_slices_and_passes(spark, corpus, monkeypatch, pairs):
    monkeypatch.setattr(fulltext, "QUESTIONS", 4)
    monkeypatch.setattr(fulltext, "CELLS", 60)
    monkeypatch.setattr(fulltext, "BROADCAST_ROWS", pairs)
    docs, asked = frames(spark, corpus)
    index = fulltext.write_index(docs, fresh_path(spark, "test-index"), blocks=True)
    found = fulltext.bm25_top_k(index, asked, 5, full_scoring_rows=0)
    assert {(r.question_id, r.key, r["rank"]) for r in found.collect()} == brute_bm25(*corpus, 5)


def test_rows_of_one_key_add_up_in_their_ranges(spark):
    """Keys that several documents have, in one range and in several, and no key."""
    docs = [(i if i % 90 else None if i % 180 else 5, f"common w{i % 4} own{i}") for i in range(300)]
    frame = spark.createDataFrame(docs, "key bigint, text string").coalesce(1)
    index = fulltext.write_index(frame, fresh_path(spark, "test-index"), blocks=True)
    asked = spark.createDataFrame([(1, "common own90 w3"), (2, "w1 own7")], "question_id bigint, question string")
    weighted = fulltext.weighted_terms(index, fulltext.question_terms(asked))
    rows = fulltext.exploded(index.words).join(weighted, "term")
    summed = rows.groupBy("question_id", "key").agg(F.sum(F.col("weight") * index.saturation()).alias("score"))
    want = {(r.question_id, r.key, r["rank"]) for r in fulltext.top_k(summed, 4).collect()}
    shared = fulltext._shared_ranges(index)
    assert sorted(r["range"] for r in shared.df.collect()) == [0, 1, 2, 4]
    found = fulltext.top_k(fulltext._range_best(index, weighted, fulltext.bounds(index, weighted), 4, shared), 4)
    assert {(r.question_id, r.key, r["rank"]) for r in found.collect()} == want
    assert (1, None, 1) in want or (1, 5, 1) in want


def test_blocks_are_built_where_documents_lie(spark):
    """No posting is exchanged, and the blocks hold every posting once, with its peak."""
    docs = [(i, f"common w{i % 5} w{i % 5} own{i}") for i in range(400)] + [(400, None), (401, "")]
    frame = spark.createDataFrame(docs, "key bigint, text string").repartition(3)
    index = fulltext.write_index(frame, fresh_path(spark, "test-index"), blocks=True)
    assert "Exchange" not in fulltext._block_table(index)._jdf.queryExecution().executedPlan().toString()
    rows = index.blocks.collect()
    held = [(k, d, r.term, t) for r in rows for k, d, t in zip(r["keys"], r.dls, r.tfs)]
    assert sorted(held) == sorted(tuple(r) for r in index.postings.select("key", "dl", "term", "tf").collect())
    mean = index.size[1]
    for r in rows:
        assert r["keys"] == sorted(r["keys"])
        peak = max(t / (t + 1.2 * (1 - 0.75 + 0.75 * d / mean)) for d, t in zip(r.dls, r.tfs))
        assert abs(r.peak - peak) < 1e-12


def test_keys_of_text_and_empty_tables(spark):
    docs = spark.createDataFrame([("b-1", "x y"), ("a-1", "x y"), ("c", None)], "key string, text string")
    asked = spark.createDataFrame([("q", "x")], "question_id string, question string")
    index = fulltext.write_index(docs, fresh_path(spark, "test-index"), blocks=True)
    for rows in (0, 10**9):
        found = fulltext.bm25_top_k(index, asked, 5, full_scoring_rows=rows).collect()
        assert [(r.question_id, r.key, r["rank"]) for r in found] == [("q", "a-1", 1), ("q", "b-1", 2)]
        assert fulltext.bm25_top_k(index, asked.limit(0), 5, full_scoring_rows=rows).count() == 0
    none = fulltext.build_index(docs.limit(0))
    assert fulltext.bm25_top_k(none, asked).count() == 0 and none.documents.count() == 0


def test_lazy_index_equals_stored_index(spark, corpus):
    docs, asked = frames(spark, corpus)
    lazy = fulltext.build_index(docs)
    stored = fulltext.write_index(docs, fresh_path(spark, "test-index"))
    assert stored.size == lazy.size
    for name in ("documents", "postings", "terms"):
        a, b = getattr(lazy, name), getattr(stored, name)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))
    assert lazy.documents.count() == 300


def test_stemmed_index_and_unstemmed_questions(spark):
    docs = spark.createDataFrame([(1, "cats running"), (2, "a dog")], "key bigint, text string")
    asked = spark.createDataFrame([(1, "cat"), (2, "cats"), (3, "running")], "question_id bigint, question string")
    index = fulltext.build_index(docs, analyzer="english")
    plain = fulltext.bm25_top_k(index, asked)
    assert {r.question_id for r in plain.collect()} == {1}
    assert {r.question_id for r in fulltext.bm25_top_k(index, asked, stem=True).collect()} == {1, 2, 3}


# ---- vectors -------------------------------------------------------------


def sample(seed, n, dim=8):
    """A third identical vectors, one zero vector, one huge vector."""
    rows = np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)
    rows[::3] = rows[0]
    rows[1], rows[2] = 0, rows[2] * 100
    return rows


def brute_nearest(asked, held, metric, k):
    a, h = knn.project(asked, metric), knn.project(held, metric)
    scores = -((a[:, None] - h[None]) ** 2).sum(-1) if metric == "l2" else a @ h.T
    scores = np.round(scores, 6)
    out = set()
    for q, row in enumerate(scores):
        order = sorted(range(len(row)), key=lambda i: (-row[i], i))[:k]
        out |= {(q, i, rank) for rank, i in enumerate(order, 1)}
    return out


def vector_frame(spark, rows, name):
    data = [(i, [float(x) for x in r]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, f"{name} bigint, embedding array<float>").repartition(3)


@pytest.mark.parametrize("metric", vectors.METRICS)
@pytest.mark.parametrize("broadcast", [True, False])
def test_exact_search_is_brute_force(spark, monkeypatch, metric, broadcast):
    if not broadcast:
        monkeypatch.setattr(knn, "BROADCAST_BYTES", 0)
    held, asked = sample(1, 200), sample(2, 30)
    found = knn.exact(
        vector_frame(spark, held, "key"), vector_frame(spark, asked, "question_id"), 7, metric,
        n_cells=3, n_landmarks=20,
    )
    got = {(r.question_id, r.key, r["rank"]) for r in found.collect()}
    assert got == brute_nearest(asked, held, metric, 7)


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_many_questions_meet_in_groups(spark, monkeypatch, metric):
    """Room for one copy of the questions, but not for one in each cell: they are
    exchanged in groups of bounded size, by exact and by half-precision search."""
    held, asked = sample(1, 300), sample(2, 40)
    dim = held.shape[1]
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 8 * dim * 40)
    monkeypatch.setattr(knn, "GROUP_BYTES", 8 * dim * 16)
    meet, sides = knn.meet_in_groups, []
    monkeypatch.setattr(knn, "meet_in_groups", lambda *x: sides.append(x) or meet(*x))
    chunks, questions = vector_frame(spark, held, "key"), vector_frame(spark, asked, "question_id")
    path = fresh_path(spark, "test-half")
    knn.write_half(chunks, path, metric, n_cells=3)
    want = brute_nearest(asked, held, metric, 7)
    for found in (knn.exact(chunks, questions, 7, metric, n_cells=3), knn.search_half(spark, path, questions, 7)):
        assert {(r.question_id, r.key, r["rank"]) for r in found.collect()} == want
    assert len(sides) == 2


def test_questions_meet_the_cells_of_a_group_once(spark, monkeypatch):
    """Chunks of all cells that fit one group give k rows for a question, not k for each cell."""
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 0)
    held, asked = sample(1, 300), sample(2, 40)
    seen, top = [], knn.top_k
    monkeypatch.setattr(knn, "top_k", lambda rows, *x: seen.append(rows.count()) or top(rows, *x))
    chunks, questions = vector_frame(spark, held, "key"), vector_frame(spark, asked, "question_id")
    found = knn.exact(chunks, questions, 5, "l2", n_cells=16)
    assert {(r.question_id, r.key, r["rank"]) for r in found.collect()} == brute_nearest(asked, held, "l2", 5)
    assert seen == [40 * 5]


def test_groups_of_questions_are_filled(spark, monkeypatch):
    """A question that looks at all cells of a group is counted once, so questions that
    fit one group are not dealt to one for each cell."""
    dim, metric = 8, "dot"
    monkeypatch.setattr(knn, "GROUP_BYTES", 8 * dim * 320)
    monkeypatch.setattr(knn, "ASKED_ROWS", 8)
    monkeypatch.setattr(knn, "DEALT_ROWS", 8)
    monkeypatch.setattr(knn, "MEETINGS_PER_CORE", 0)
    held, asked = vector_frame(spark, sample(1, 300, dim), "key"), vector_frame(spark, sample(2, 320, dim), "q")
    cells = knn.survey_cells(held, metric, n_cells=16)
    everywhere = lambda v: np.ones((len(v), len(cells.centers)), dtype=bool)
    blocks = knn.pack(held, "key", "embedding", knn.one_cell(cells), metric, dim)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("asked", "held")])
    sizes = lambda met, rows: [pa.array([len(met[0])]), pa.array([pc.sum(pc.list_value_length(rows["ids"])).as_py()])]
    found = knn.meet_in_groups(blocks, knn.Asked(asked, "q", "embedding", metric, dim, everywhere, 16), schema, sizes)
    assert [tuple(r) for r in found.collect()] == [(320, 300)]


@pytest.mark.parametrize("metric", ["dot", "l2"])
@pytest.mark.parametrize("shape", ["plain", "equal", "far", "sizes"])
def test_screening_loses_no_neighbour(metric, shape):
    """Equal vectors, vectors far from the origin and of very different lengths."""
    draw = np.random.default_rng(3)
    held, asked = draw.normal(size=(5000, 8)), draw.normal(size=(50, 8))
    if shape == "equal":
        held = held[draw.integers(0, 20, 5000)]
        asked = held[:50]
    if shape == "far":
        held, asked = held / 100 + 1000, asked / 100 + 1000
    if shape == "sizes":
        held = held * 10.0 ** draw.integers(-6, 6, (5000, 1))
    near = knn.Nearest(asked, 5, metric)
    near.add(held)
    rows = near.best_rows()
    q, at, score, _ = near.candidates()
    true = -((asked[:, None] - held[None]) ** 2).sum(-1) if metric == "l2" else asked @ held.T
    for i, row in enumerate(np.round(true, 6)):
        own = rows[q[rows] == i]
        np.testing.assert_allclose(np.round(score[own], 6), np.sort(row)[::-1][:5], rtol=1e-9, atol=2e-6)
        if shape in ("plain", "equal"):
            assert at[own].tolist() == np.lexsort((np.arange(len(row)), -row))[:5].tolist()


def test_exact_search_prunes_cells_of_clustered_data(spark):
    centers = np.eye(8)[:4] * 50
    held = np.concatenate([c + np.random.default_rng(i).normal(size=(100, 8)) for i, c in enumerate(centers)])
    cells = knn.survey_cells(vector_frame(spark, held, "key"), "l2", "key", "embedding", 8, 100)
    reach = cells.within_reach(centers[:1] + 0.1, 3)
    assert 0 < reach.sum() < reach.size


def test_fewer_chunks_than_k(spark):
    held, asked = sample(1, 4), sample(2, 3)
    found = knn.exact(vector_frame(spark, held, "key"), vector_frame(spark, asked, "question_id"), 9)
    assert found.count() == 12


def test_cosine_example(spark):
    rows = vector_frame(spark, [[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 0.5, 0], [0, 1, 0.5]], "key")
    asked = [1.0, 0.0, 1.0]
    best = knn.nearest_to_one(rows, asked, 2).collect()
    assert [r.key for r in best] == [0, 2]
    column = F.array(*[F.lit(x) for x in asked])
    shown = rows.orderBy("key").select(F.round(vectors.cosine_distance(F.col("embedding"), column), 6).alias("d"))
    assert [r.d for r in shown.collect()] == [0.292893, 1.0, 0.292893, 0.367544, 0.683772]


def test_approximate_search_recall(spark):
    rows = np.random.default_rng(5).standard_normal((400, 16)).astype(np.float32)
    chunks, asked = vector_frame(spark, rows, "key"), vector_frame(spark, rows[:50], "question_id")
    true = {(r.question_id, r.key) for r in knn.exact(chunks, asked, 5).collect()}
    cells = knn.train_ivf(chunks, 8)

    def recall(found):
        return len({(r.question_id, r.key) for r in found.collect()} & true) / len(true)

    few, many, all_ = (recall(knn.ivf(chunks, asked, cells, n)) for n in (1, 4, 8))
    assert few < many < all_ == 1.0
    path = fresh_path(spark, "test-ivf")
    knn.write_ivf(chunks, cells, path)
    assert recall(knn.search_ivf(spark, path, asked, 4)) == many
    one = knn.search_ivf(spark, path, asked.where("question_id = 0"), 1)
    assert len({f for f in one.inputFiles() if "/blocks/" in f}) < spark.read.parquet(f"{path}/blocks").count()
    assert recall(knn.lsh(chunks, asked, knn.Projections.draw(16, 6, 0.5))) > 0.8


def test_invalid_vectors_are_set_apart(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 2.0]), (2, [1.0]), (3, [float("nan"), 1.0]), (4, None), (5, [float("-inf"), 0.0]), (6, [None, 1.0])],
        "key bigint, embedding array<float>",
    )
    good, bad = knn.validate(rows, 2)
    assert [r.key for r in good.collect()] == [1]
    assert sorted(r.key for r in bad.collect()) == [2, 3, 4, 5, 6]


def test_half_precision(spark):
    values = [0.1, 65504.0, 1e-7, -2.5]
    rows = spark.createDataFrame([(values,)], "v array<float>")
    got = rows.select(vectors.to_half("v").alias("v")).first().v
    assert got == [float(x) for x in np.array(values, dtype=np.float16)]


# ---- hybrid --------------------------------------------------------------


def hits(spark, rows):
    return spark.createDataFrame(rows, "question_id bigint, key string, score double, rank int")


def test_union_keeps_repeats_and_order(spark):
    merged = hybrid.union_hits(
        hits(spark, [(1, "a", 0.9, 1), (1, "b", 0.8, 2)]), hits(spark, [(1, "b", 7.0, 1), (1, "c", 6.0, 2)])
    )
    assert merged.count() == 4
    kept = hybrid.keep_order(merged).where("rank <= 2").orderBy("rank")
    assert [r.key for r in kept.collect()] == ["a", "b"]
    assert sorted(r.key for r in hybrid.drop_repeats(merged).collect()) == ["a", "b", "c"]


def test_rerank_is_stable(spark):
    rows = spark.createDataFrame(
        [(1, "q", "x", "t1", 0.5, 1, "vector", 0), (1, "q", "y", "t2", 9.0, 1, "fulltext", 1), (1, "q", "z", "t3", 0.4, 2, "vector", 0)],
        "question_id bigint, question string, key string, text string, score double, rank int, source string, source_order int",
    )
    same = hybrid.rerank(rows, lambda q, t: F.lit(0.0)).orderBy("rank").collect()
    assert [(r.key, r.score, r.index_score) for r in same] == [("x", 0.5, 0.5), ("z", 0.5, 0.4), ("y", 0.5, 9.0)]


# ---- hooks ---------------------------------------------------------------


def test_model_hooks(spark):
    def make_encode():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    def make_score():
        return lambda qs, ts: np.array([float(len(q) - len(t)) for q, t in zip(qs, ts)])

    def make_read():
        def read(qs, ts):
            words = [t.split() for t in ts]
            return [
                {"tokens": np.array(w), "start": 1.0 * (np.arange(len(w)) == 1), "end": 1.0 * (np.arange(len(w)) == 2)}
                for w in words
            ]

        return read

    from fathom.operators import reader

    rows = spark.createDataFrame([("ab", "one two three four"), ("a", "x y z")], "question string, text string")
    encoded = rows.select(hooks.embedder(make_encode, prompt="query: ")(F.col("question")).alias("v")).collect()
    assert [list(r.v) for r in encoded] == [[9.0, 1.0], [8.0, 1.0]]
    scored = rows.select(hooks.scorer(make_score)(F.col("question"), F.col("text")).alias("s")).collect()
    assert [r.s for r in scored] == [-16.0, -4.0]
    answers = reader.read_answers(rows, hooks.reader(make_read)).collect()
    assert [r.ans for r in answers] == ["two three", "y z"]


def test_fitted_embedding_is_kept_and_embeds_inside_the_search(spark):
    texts = [(i, f"topic{i % 5} word{i} the") for i in range(60)] + [(60, None), (61, "")]
    corpus = spark.createDataFrame(texts, "key bigint, text string").repartition(3)
    fitted = hooks.HashedEmbedding.fit(corpus, "text", 64)
    path = fresh_path(spark, "embedding")
    fitted.write(spark, path)
    assert hooks.HashedEmbedding.read(spark, path) == fitted
    chunks = fitted.embed(corpus, "text")
    assert all(abs(sum(x * x for x in r.embedding) - (r.key < 60)) < 1e-5 for r in chunks.collect())
    asked = spark.createDataFrame(
        [(1, "word7 topic2", "VEC"), (2, "word7", "FT"), (3, "word31 the", "x")],
        "question_id bigint, question string, search_type string",
    )
    index = fulltext.build_index(corpus)
    found = hybrid.search_branches(chunks, index, asked, 2, embedding=fitted).collect()
    best = {(r.question_id, r.source): r.key for r in found if r["rank"] == 1}
    assert best == {(1, "vector"): 7, (2, "fulltext"): 7, (3, "vector"): 31, (3, "fulltext"): 31}


def test_hashed_embedding_finds_the_same_text(spark):
    rows = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma") for i in range(20)], "key bigint, text string")
    embedded = hooks.hashed_embedding(rows, "text", dim=512)
    asked = embedded.withColumnRenamed("key", "question_id")
    best = knn.exact(embedded, asked, 1).collect()
    assert all(r.question_id == r.key for r in best)


# ---- whole search --------------------------------------------------------


def test_reranking_one_source_keeps_its_set(spark):
    from fathom.plans import search_queries as sq

    folder = "/root/testdata/sf0.001"
    index, texts = sq.stored_index(spark, folder), sq.texts_of(spark, folder)
    chunks, embedding = sq.embedded(spark, folder)
    for code, source in (("FT", "fulltext"), ("VEC", "vector")):
        asked = sq.mixed_questions(spark, folder).withColumn("search_type", F.lit(code))
        found = [
            hybrid.search(chunks, index, asked, texts, 5, reranking=r, embedding=embedding).collect()
            for r in (True, False)
        ]
        sets = [{(r.question_id, r.key) for r in rows} for rows in found]
        assert sets[0] == sets[1]
        assert {r.source for rows in found for r in rows} == {source}


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_bad_vectors_lose_no_hits(spark, metric):
    """NaN, infinite, null, short and missing vectors, among the landmarks too."""
    rng = np.random.default_rng(3)
    good = [(i, rng.standard_normal(8).tolist()) for i in range(600)]
    bad = [[float("nan")] + [1.0] * 7, [float("inf")] * 8, None, [1.0] * 5, [1.0] * 9, [None] + [1.0] * 7, []]
    rows = good + [(1000 + i, v) for i, v in enumerate(bad * 20)]
    schema = "key bigint, embedding array<float>"
    asked = spark.createDataFrame(good[:40] + [(5000, bad[0]), (5001, None)], "question_id bigint, embedding array<float>")
    clean = knn.exact(spark.createDataFrame(good, schema), asked, 5, metric)
    dirty_rows = spark.createDataFrame(rows, schema)
    dirty = knn.exact(dirty_rows, asked, 5, metric)
    assert sorted(map(tuple, dirty.collect())) == sorted(map(tuple, clean.collect()))
    assert dirty.count() == 200
    assert sorted(r.key for r in knn.rejects(dirty_rows).collect()) == [k for k, _ in rows[600:]]
    cells = knn.train_ivf(dirty_rows, 4, metric)
    found = knn.ivf(dirty_rows, asked, cells, 4, 5)
    assert {r.key for r in found.collect()} <= set(range(600)) and found.count() == 200


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_half_precision_search_is_brute_force(spark, metric):
    held, asked = sample(1, 300), sample(2, 30)
    path = fresh_path(spark, "half")
    knn.write_half(vector_frame(spark, held * 1000, "key"), path, metric, n_cells=5)
    found = knn.search_half(spark, path, vector_frame(spark, asked, "question_id"), 7)
    got = {(r.question_id, r.key, r["rank"]) for r in found.collect()}
    assert got == brute_nearest(asked.astype(np.float32), (held * 1000).astype(np.float32), metric, 7)
    none = vector_frame(spark, asked, "question_id").limit(0)
    assert knn.search_half(spark, path, none, 7).count() == 0


def test_half_blocks_take_half_the_bytes(spark):
    rows = np.random.default_rng(5).standard_normal((3000, 64)).astype(np.float32)
    path = fresh_path(spark, "half")
    knn.write_half(vector_frame(spark, rows, "key"), path, n_cells=2)
    size = lambda name: sum(f.stat().st_size for f in Path(path, name).rglob("*.parquet"))
    assert size("half") < 0.62 * size("vectors")
    # Of the vectors themselves a search reads the rows it may return.
    stored = spark.read.parquet(f"{path}/half").count()
    assert stored < 100
