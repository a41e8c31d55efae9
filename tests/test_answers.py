"""Spans, evaluation, collections, dumps and streams."""

import bz2
import json
import math
import re
import tempfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions import spans
from fathom.hooks import HashedEmbedding
from fathom.operators import corpus, evaluate, knn, reader
from fathom.plans import ingest, methods
from fathom.plans.ask import presented
from fathom.plans.store import Store, texts_by_bucket
from fathom.session import fresh_path
from fathom.sources import dump, pages, records
from fathom.sources.collection import Collection, DuplicateKey, latest_per_key
from fathom.streaming.questions import answer_stream
from fathom.streaming.upserts import upsert_stream


# ---- spans ---------------------------------------------------------------


def decode(spark, rows):
    frame = spark.createDataFrame(rows, "start array<double>, end array<double>, mask array<int>")
    span = spans.best_span(F.col("start"), F.col("end"), F.col("mask"))
    found = frame.withColumn("span", span).select("*", "span.*")
    score = spans.span_score(F.col("start"), F.col("end"), F.col("span_start"), F.col("span_end"))
    return [(r.span_start, r.span_end, r.score) for r in found.withColumn("score", score).collect()]


def test_span_examples(spark):
    start, end = [1.0, 3.0, 2.0], [0.0, 1.0, 4.0]
    got = decode(spark, [(start, end, [1, 1, 1]), (start, end, [1, 1, 0]), (start, end, [1, 0, 1]), (start, end, [0, 1, 1])])
    assert [g[:2] for g in got] == [(1, 2), (1, 1), (0, 0), (0, 0)]
    assert round(got[0][2], 6) == 0.622825


def test_span_is_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for n in rng.integers(1, 25, 200):
        mask = [1] * int(n)
        if n % 3 == 0:
            mask[int(n) // 2] = 0
        rows.append(([float(x) for x in rng.integers(-3, 4, n)], [float(x) for x in rng.integers(-3, 4, n)], mask))
    for (s, e, m), (i, j, score) in zip(rows, decode(spark, rows)):
        n = m.index(0) if 0 in m else len(m)
        best = max([s[a] + e[b] for b in range(n) for a in range(b + 1)] or [s[0] + e[0]])
        j_true = next((b for b in range(n) if max(s[: b + 1]) + e[b] == best), 0)
        i_true = s.index(max(s[: j_true + 1]))
        assert (i, j) == (i_true, j_true)
        soft = math.exp(s[i]) / sum(map(math.exp, s)) * math.exp(e[j]) / sum(map(math.exp, e))
        assert abs(score - soft) < 1e-12


def test_context_start(spark):
    rows = spark.createDataFrame([([9.0, 1.0, 2.0], [9.0, 1.0, 1.0])], "start array<double>, end array<double>")
    got = rows.select(spans.best_span(F.col("start"), F.col("end"), None, F.lit(1)).alias("s")).first().s
    assert (got.span_start, got.span_end) == (2, 2)


def test_pages_strict_and_lenient(spark):
    answers = spark.createDataFrame([(1, 5), (2, 6)], "question_id bigint, id bigint")
    info = spark.createDataFrame([(5, "T", "/h")], "id bigint, title string, href string")
    assert sorted((r.id, r.title) for r in reader.attach_pages(answers, info).collect()) == [(5, "T"), (6, None)]
    known = answers.where("id = 5")
    assert [r.title for r in reader.attach_pages(known, info, strict=True).collect()] == ["T"]
    with pytest.raises(Exception, match="unknown page: 6"):
        reader.attach_pages(answers, info, strict=True).collect()


# ---- evaluation ----------------------------------------------------------


def test_metrics(spark):
    predictions = spark.createDataFrame(
        [(1, 1, "the city of Liverpool"), (1, 2, "The Liverpool!"), (2, 1, ""), (2, 2, "x")],
        "qid bigint, rank int, answer string",
    )
    gold = spark.createDataFrame([(1, ["Liverpool", "nowhere"]), (2, ["y z"])], "qid bigint, answers array<string>")
    scores = evaluate.score_answers(predictions, gold)
    got = {(r.qid, r["rank"]): (r.em, round(r.f1, 6)) for r in scores.collect()}
    assert got == {(1, 1): (0, 0.5), (1, 2): (1, 1.0), (2, 1): (0, 0.0), (2, 2): (0, 0.0)}
    best = {r.qid: (r.em, r.f1) for r in evaluate.best_within(scores, 5).collect()}
    assert best == {1: (1, 1.0), 2: (0, 0.0)}
    row = evaluate.report(scores.withColumn("method", F.lit("m"))).first()
    assert (row.em, row.f1, row.em_at_k, row.f1_at_k) == (0.0, 25.0, 50.0, 50.0)
    assert row.em <= row.f1 and row.em_at_k >= row.em and row.f1_at_k >= row.f1


# ---- dumps and pages -----------------------------------------------------

PAGES = [
    (1, "Dog", None, "The '''dog'''.\n\n== See also ==\n[[Cat]]"),
    (2, "Hound", "Dog", "#REDIRECT [[Dog]]"),
    (3, "Help:Dogs", None, "help"),
    (4, "A & B", None, " 1 < 2 \n\nnext"),
]


def page_text(page):
    number, title, redirect, text = page
    turn = f'<redirect title="{redirect}" />' if redirect else ""

    def esc(t):
        return t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    return (
        f"  <page>\n    <title>{esc(title)}</title>\n    <ns>0</ns>\n    <id>{number}</id>\n    {turn}"
        f'<revision><id>9</id><text bytes="3" xml:space="preserve">{esc(text)}</text></revision>\n  </page>\n'
    )


@pytest.fixture()
def folder():
    return Path(tempfile.mkdtemp(prefix="fathom-test-"))


@pytest.mark.parametrize("rooted", [True, False])
def test_dump_of_concatenated_streams(spark, folder, rooted):
    streams = [page_text(p).encode() for p in PAGES]
    if rooted:
        streams = [b"<mediawiki>\n<siteinfo></siteinfo>\n", *streams, b"</mediawiki>\n"]
    path = folder / "dump.xml.bz2"
    path.write_bytes(b"".join(bz2.compress(s) for s in streams))
    rows = dump.read_pages(spark, str(path)).orderBy("id").collect()
    assert [(r.id, r.title, r.redirect and r.redirect._title, r.revision.text._VALUE) for r in rows] == PAGES
    made = ingest.dump_to_paragraphs(spark, str(path)).orderBy("key").collect()
    assert [(r.key, r.text) for r in made] == [("1-0", "The dog."), ("4-0", "1 < 2"), ("4-1", "next")]


def test_dump_to_collection(spark, folder):
    path = folder / "dump.xml"
    path.write_text("".join(map(page_text, PAGES)))
    schema = (
        "key string, id bigint, chunk int, tags string, text string, embedding array<float>, seq bigint"
    )
    target = Collection(
        spark, str(folder / "chunks"), buckets=2, schema=spark.createDataFrame([], schema).schema
    )

    def embed(text):
        return F.array(F.length(text).cast("float"))

    for seq in (1, 2, 1):
        ingest.load_dump(spark, str(path), target, seq, embed)
    got = sorted((r.key, r.embedding, r.seq) for r in target.scan().collect())
    assert got == [("1-0", [8.0], 2), ("4-0", [5.0], 2), ("4-1", [4.0], 2)]


def test_broken_pages_are_reported(spark, folder):
    path = folder / "dump.xml"
    texts = [page_text(p) for p in PAGES]
    texts[1] = texts[1].replace("</title>", "")
    path.write_text("".join(texts))
    good, bad = dump.read_pages_and_rejects(spark, str(path))
    assert sorted(r.id for r in good.collect()) == [p[0] for p in PAGES if p[0] != PAGES[1][0]]
    assert [r.xml.count("<title>") for r in bad.collect()] == [1]
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        dump.read_pages(spark, str(path)).collect()


def test_pages_without_title_stay(spark):
    rows = spark.createDataFrame([(1, None), (2, "Help:x"), (3, "Star: x")], "id bigint, title string")
    assert sorted(r.id for r in corpus.drop_internal(rows).collect()) == [1, 3]


def test_dump_index(spark, folder):
    path = folder / "index.txt.bz2"
    path.write_bytes(bz2.compress("600:10:A: b\n600:11:C\n\n7:12:D\n".encode()))
    index = dump.read_index(spark, str(path))
    assert sorted(map(tuple, index.collect())) == [(7, 12, "D"), (600, 10, "A: b"), (600, 11, "C")]
    offsets = dump.stream_offsets(index)
    assert [r.offset for r in offsets.collect()] == [7, 600]
    dump.write_offsets(offsets, str(folder / "offsets"))
    back = dump.read_offsets(spark, str(folder / "offsets"))
    assert dump.stream_count(back).first().streams == 2


def test_links_and_positions(spark, folder):
    html = (
        '<A class=x HREF="/a-articles-multistream.xml">1</a><!-- <a href="/no"> --><a data-href="/no">2</a>'
        "<script>'<a href=\"/no\">'</script><a href='/b-articles-multistream1.xml?x&amp;y'>3</a><a href=/c>4</a>"
        '<a href="/i-articles-multistream-index.txt">5</a>'
    )
    links = pages.page_links(spark.createDataFrame([(1, html)], "page_id bigint, html string"))
    found = [r.href for r in links.orderBy("pos").collect()]
    assert found[1:3] == ["/b-articles-multistream1.xml?x&y", "/c"] and len(found) == 4
    classes = pages.classify_links(links)
    assert [(r.kind) for r in classes.orderBy("pos").collect()] == ["xml", "xml", "index"]
    rest = pages.skip_first(classes)
    assert [r.href for r in rest.collect()] == ["/b-articles-multistream1.xml?x&y"]
    pages.write_links(rest, str(folder / "links"))
    assert spark.read.text(str(folder / "links")).count() == 1
    (folder / "titles.txt").write_text("Zero\nOne\n\nThree")
    (folder / "hrefs.txt").write_text("/0\n/1\n/2\n/3")
    info = pages.page_info(
        pages.read_positional(spark, str(folder / "titles.txt"), "title"),
        pages.read_positional(spark, str(folder / "hrefs.txt"), "href"),
    )
    assert sorted(map(tuple, info.collect())) == [(0, "Zero", "/0"), (1, "One", "/1"), (2, "", "/2"), (3, "Three", "/3")]


def test_positions_across_splits(spark, folder):
    lines = [f"line {i} " + "x" * (i % 37) for i in range(20000)]
    (folder / "t.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = pages.read_positional(spark, str(folder / "t.txt"), "title")
        assert got.rdd.getNumPartitions() > 1
        assert [r.title for r in got.orderBy("id").collect()] == lines
        assert got.agg(F.max("id")).first()[0] == 19999
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_positions_across_files(spark, folder):
    (folder / "t").mkdir()
    parts = {"b": ["2", "3"], "a": ["0", "1"], "c": ["4"]}
    for name, lines in parts.items():
        (folder / "t" / f"{name}.txt").write_text("\n".join(lines))
    got = pages.read_positional(spark, str(folder / "t"), "title")
    assert sorted((r.id, r.title) for r in got.collect()) == [(i, str(i)) for i in range(5)]


def test_records(spark, folder):
    rows = [{"id": 7, "chunk": 2, "text": "t", "embedding": [0.5, 1], "extra": 3}, {"id": 8, "chunk": 0, "embedding": []}]
    (folder / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = {r.key: r for r in records.read_records(spark, str(folder / "r.jsonl")).collect()}
    assert got["7-2"].embedding == [0.5, 1.0]
    assert got["7-2"].fields == {"id": "7", "chunk": "2", "text": "t", "extra": "3"}
    assert set(got) == {"7-2", "8-0"}


# ---- collections and streams ---------------------------------------------


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "key bigint, text string, seq bigint")


def content(collection):
    return sorted(map(tuple, collection.scan().select("key", "text", "seq").collect()))


def test_upsert_twice_is_once(spark):
    target = Collection(spark, fresh_path(spark, "test-collection"), buckets=4)
    target.create(rows_of(spark, [(i, "old", 1) for i in range(20)] + [(3, "older", 0)]))
    batch = rows_of(spark, [(3, "new", 2), (3, "mid", 1), (4, "stale", 0), (99, "added", 1)])
    target.upsert(batch)
    once = content(target)
    target.upsert(batch)
    assert content(target) == once
    assert (3, "new", 2) in once and (4, "old", 1) in once and (99, "added", 1) in once and len(once) == 21


def files(target):
    return {p: p.stat().st_mtime_ns for p in Path(target.path).glob("batches/**/*.parquet")}


def test_small_upsert_writes_few_files(spark):
    target = Collection(spark, fresh_path(spark, "test-collection"), buckets=8)
    target.create(rows_of(spark, [(i, "old", 1) for i in range(500)]))
    before = files(target)
    target.upsert(rows_of(spark, [(i, "new", 2) for i in range(0, 500, 50)]))
    after = files(target)
    assert all(after.get(p) == t for p, t in before.items())
    assert len(after) - len(before) <= 2


def test_reopened_by_path(spark):
    path = fresh_path(spark, "test-collection")
    Collection(spark, path, buckets=8).create(rows_of(spark, [(i, "old", 1) for i in range(100)]))
    again = Collection(spark, path)
    assert again.buckets == 8
    again.upsert(rows_of(spark, [(i, "new", 2) for i in range(100)]))
    assert content(Collection(spark, path)) == [(i, "new", 2) for i in range(100)]
    with pytest.raises(ValueError, match="buckets"):
        Collection(spark, path, buckets=4)
    with pytest.raises(ValueError, match="there is a collection"):
        again.create(rows_of(spark, []))


def test_failed_write_changes_nothing(spark):
    target = Collection(spark, fresh_path(spark, "test-collection"))
    target.create(rows_of(spark, [(1, "a", 1), (2, "b", 1)]))
    before = content(target)
    bad = rows_of(spark, [(1, "c", 2)]).withColumn("text", F.raise_error(F.lit("broken row")).cast("string"))
    with pytest.raises(Exception, match="broken row"):
        target.upsert(bad)
    assert content(target) == before
    # A batch that was written and not logged is not read either.
    rows_of(spark, [(1, "d", 3)]).write.parquet(f"{target.path}/batches/left-behind")
    assert content(target) == before


def test_compaction_and_ties(spark):
    target = Collection(spark, fresh_path(spark, "test-collection"), compact_after=2)
    target.create(rows_of(spark, [(1, "a", 1)]))
    for text in ("x", "y", "x", "y"):
        target.upsert(rows_of(spark, [(1, text, 5), (2, text, 0)]))
    first = content(target)
    assert len(first) == 2
    other = Collection(spark, fresh_path(spark, "test-collection"))
    other.create(rows_of(spark, [(1, "y", 5), (1, "x", 5), (1, "a", 1), (2, "y", 0), (2, "x", 0)]))
    assert content(other) == first


def test_newer_dump_replaces_whole_articles(spark):
    target = Collection(spark, fresh_path(spark, "test-collection"), replaces="page")
    schema = "key string, page bigint, text string, seq bigint"
    target.create(spark.createDataFrame([("1-0", 1, "a", 1), ("1-1", 1, "b", 1), ("2-0", 2, "c", 1)], schema))
    target.upsert(spark.createDataFrame([("1-0", 1, "new", 2)], schema))
    want = [("1-0", "new"), ("2-0", "c")]
    assert sorted(map(tuple, target.scan().select("key", "text").collect())) == want
    target.compact()
    assert sorted(map(tuple, Collection(spark, target.path).scan().select("key", "text").collect())) == want


def test_rows_without_a_page_stay(spark):
    target = Collection(spark, fresh_path(spark, "test-collection"), replaces="page", compact_after=3)
    schema = "key string, page bigint, text string, seq bigint"
    target.create(spark.createDataFrame([("x", None, "a", 1), ("y", None, "b", 1), ("1-0", 1, "c", 1), ("3-0", 3, "n", None)], schema))
    seen = lambda: sorted(map(tuple, target.scan().select("key", "text").collect()))
    target.upsert(spark.createDataFrame([("x", None, "new", 2), ("1-1", 1, "d", 2)], schema))
    assert seen() == [("1-1", "d"), ("3-0", "n"), ("x", "new"), ("y", "b")]
    target.upsert(spark.createDataFrame([("z", None, "e", 3)], schema))
    target.compact()
    assert seen() == [("1-1", "d"), ("3-0", "n"), ("x", "new"), ("y", "b"), ("z", "e")]


def test_small_upsert_leaves_other_buckets_alone(spark):
    target = Collection(spark, fresh_path(spark, "test-collection"), buckets=16)
    target.create(rows_of(spark, [(i, "old", 1) for i in range(800)]))
    target.upsert(rows_of(spark, [(3, "new", 2), (900, "added", 1), (4, "stale", 0)]))
    touched = target.state().touched
    assert 1 <= len(touched) <= 3
    quiet, changed = target.parts()
    # Untouched buckets are read as they lie; of touched ones the rows that no
    # pending key meets pass without an exchange.
    for part in (quiet, changed[0]):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    number = lambda df: {int(re.search(r"_bucket=(\d+)", f)[1]) for f in df.inputFiles() if "_bucket=" in f}
    assert number(quiet).isdisjoint(touched) and number(quiet)
    want = sorted([(i, "old", 1) for i in range(800) if i != 3] + [(3, "new", 2), (900, "added", 1)])
    assert content(target) == want
    before = files(target)
    target.compact()
    after = files(target)
    # Only touched buckets are written again.
    written = {int(re.search(r"_bucket=(\d+)", str(p))[1]) for p in set(after) - set(before)}
    assert written == touched and content(target) == want
    assert content(Collection(spark, target.path)) == want


def test_old_batches_are_removed(spark):
    target = Collection(spark, fresh_path(spark, "test-collection"), buckets=4)
    target.create(rows_of(spark, [(i, "old", 1) for i in range(40)]))
    reader = None
    for n in range(4):
        target.upsert(rows_of(spark, [(i, f"new{n}", 2 + n) for i in range(40)]))
        held = target.scan()
        target.compact()
        # What was opened before the compaction can still be read.
        assert held.count() == 40
        reader = held
    assert reader.count() == 40
    folders = {p.name for p in Path(target.path).glob("batches/*")}
    log = target._log()
    assert len(folders) == len(log) == 3
    assert content(Collection(spark, target.path)) == [(i, "new3", 5) for i in range(40)]


@pytest.mark.parametrize("pending", [10**6, 0])
def test_collection_is_brute_force(spark, pending):
    """Random writes, pages and compactions, with pending keys sent or exchanged."""
    rng = np.random.default_rng(4)
    schema = "key bigint, page bigint, text string, seq bigint"
    for replaces in (None, "page"):
        path = fresh_path(spark, "test-collection")
        target = Collection(spark, path, buckets=5, replaces=replaces, pending_rows=pending)
        latest: dict = {}
        for seq in range(1, 5):
            keys = rng.choice(60, rng.integers(1, 25), replace=False).tolist()
            rows = [(k, None if k % 11 == 0 else k // 6, f"{k} {seq}", seq - (k % 13 == 0)) for k in keys]
            frame = spark.createDataFrame(rows, schema)
            target.create(frame) if seq == 1 else target.upsert(frame)
            for k, page, text, s in rows:
                if k not in latest or latest[k][2] < s:
                    latest[k] = (page, text, s)
            if replaces:
                newest: dict = {}
                for page, _, s in latest.values():
                    newest[page] = max(newest.get(page, s), s)
                shown = {k: v for k, v in latest.items() if v[0] is None or v[2] == newest[v[0]]}
            else:
                shown = latest
            if seq == 3:
                target.compact()
                latest = dict(shown)
            got = {r.key: (r.page, r.text, r.seq) for r in target.scan().collect()}
            assert got == shown
    empty = Collection(spark, fresh_path(spark, "test-collection"), buckets=2)
    empty.create(spark.createDataFrame([], schema))
    assert empty.scan().count() == 0
    empty.upsert(spark.createDataFrame([(1, 1, "a", 1)], schema))
    assert empty.scan().count() == 1


def test_strict_insert(spark):
    target = Collection(spark, fresh_path(spark, "test-collection"), buckets=2)
    target.create(rows_of(spark, [(1, "a", 1)]))
    target.insert(rows_of(spark, [(2, "b", 1)]))
    for bad in ([(1, "c", 1)], [(5, "d", 1), (5, "e", 2)]):
        with pytest.raises(DuplicateKey):
            target.insert(rows_of(spark, bad))
    assert content(target) == [(1, "a", 1), (2, "b", 1)]


def test_hot_key_keeps_one_row(spark):
    hot = spark.range(5000).select(F.lit(1).cast("bigint").alias("key"), F.col("id").cast("string").alias("text"), F.col("id").alias("seq"))
    assert [tuple(r) for r in latest_per_key(hot).collect()] == [(1, "4999", 4999)]


def test_upsert_stream_restarts_without_repeats(spark, folder):
    source, state = folder / "in", str(folder / "state")
    schema = rows_of(spark, []).schema
    target = Collection(spark, str(folder / "out"), buckets=2, schema=schema)

    def feed(rows):
        rows_of(spark, rows).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        upsert_stream(stream, target, state).awaitTermination()

    feed([(1, "a", 1), (2, "b", 1)])
    feed([(2, "c", 2)])
    feed([(1, "late", 0), (3, "d", 1)])
    assert content(target) == [(1, "a", 1), (2, "c", 2), (3, "d", 1)]


def prepared(spark, n=400):
    docs = [(i, f"Topic{i % 9}, the (word{i}) stands\nhere {i % 5}.") for i in range(n)] + [(n, None), (n + 1, "")]
    return Store.write(spark.createDataFrame(docs, "doc_id bigint, text string"), fresh_path(spark, "store"), "doc_id", dim=1024)


def test_texts_of_a_store_are_not_exchanged(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "key bigint, text string").repartition(3).localCheckpoint()
    found = texts_by_bucket(rows)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    path = fresh_path(spark, "texts")
    found.write.partitionBy("bucket").parquet(path)
    assert sorted(map(tuple, spark.read.parquet(path).select("key", "text").collect())) == sorted(map(tuple, rows.collect()))


def test_store_reads_what_a_batch_needs(spark):
    store = prepared(spark)
    asked = spark.createDataFrame(
        [(1, "word17 topic8", "VEC"), (2, "word33", "FT"), (3, "word5 here", "x")],
        "question_id bigint, question string, search_type string",
    )
    hits = store.hits(asked, 2)
    best = {(r.question_id, r.source): r.key for r in hits.collect() if r["rank"] == 1}
    assert best == {(1, "vector"): 17, (2, "fulltext"): 33, (3, "vector"): 5, (3, "fulltext"): 5}
    # Texts come from the folders of the hits' buckets only.
    wanted = {r[0] for r in hits.select(knn.key_bucket("key")).distinct().collect()}
    plan = store.texts(hits)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(", "")
    assert {r[0] for r in store.texts(hits).select(knn.key_bucket("key")).collect()} == wanted and len(wanted) <= 7
    pages_ = spark.createDataFrame([(i, f"t{i}", f"/{i}") for i in range(400)], "id bigint, title string, href string")
    answers = presented(store.ask(asked, pages_, 2)).collect()
    assert {r.question_id for r in answers} == {1, 2, 3}
    for r in answers:
        # An answer is a piece of its text, and stands where its snippet says.
        assert r.ans and r.text[r.ans_start : r.ans_end] == r.ans
        assert r.snippet_after == r.text[r.ans_end : r.ans_end + 50] + "..."
    again = Store.read(spark, store.path)
    assert again.embedding == store.embedding and again.index.size == (402, again.index.size[1])
    none = asked.limit(0)
    assert store.ask(none, pages_).count() == 0


def test_store_embeds_the_corpus_once(spark, monkeypatch):
    """Vectors are worked out from the words of the index, and are those of the texts."""
    seen, write = [], knn.write_half
    monkeypatch.setattr(knn, "write_half", lambda chunks, *x: seen.append(chunks) or write(chunks, *x))
    docs = [(i, f"word{i % 7} the the word{i % 3} " + "again " * (i % 4)) for i in range(40)] + [(7, "twice"), (40, None)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    store = Store.write(docs, fresh_path(spark, "store"), "doc_id", dim=64)
    assert store.embedding == HashedEmbedding.fit(docs, "text", 64)
    want = store.embedding.embed(docs, "text").select("doc_id", "embedding")
    assert sorted(seen[0].collect()) == sorted(want.collect())
    # Read from a file in every pass.
    assert seen[0].inputFiles()


def test_methods_share_one_retrieval(spark):
    """Reranking one source changes the order of its answers, not which they are; a hit
    counts within five where it counts first; an exact match has all of F1."""
    store = prepared(spark, 120)
    asked = spark.createDataFrame([(q, f"word{q} topic{q % 4} here") for q in range(30)], "question_id bigint, question string")
    found = methods.method_answers(store.vector_hits(asked), store.text_hits(asked), asked, store.texts)
    rows = found.collect()
    sets = {}
    for r in rows:
        sets.setdefault((r.method, r.question_id), set()).add(r.key)
    for q in range(30):
        assert sets["bm25", q] == sets["bm25_rerank", q] and sets["vector", q] == sets["vector_rerank", q]
    truth = found.where("method = 'bm25' and rank = 2").select(F.col("question_id").alias("qid"), F.array("ans").alias("answers"))
    report = {r.method: r for r in methods.method_report(found, truth).collect()}
    assert set(report) == set(methods.METHODS)
    for r in report.values():
        assert r.em <= r.f1 + 1e-9 and r.em_at_k <= r.f1_at_k + 1e-9 and r.em <= r.em_at_k and r.f1 <= r.f1_at_k
    for name in ("bm25", "vector"):
        assert report[name].em_at_k == report[f"{name}_rerank"].em_at_k
        assert abs(report[name].f1_at_k - report[f"{name}_rerank"].f1_at_k) < 1e-9
    assert report["bm25"].em_at_k == 100


def test_streams_are_read_from_their_offsets(spark, folder):
    xml = "<page><title>t{0}</title><id>{0}</id><revision><text>{1}</text></revision></page>"
    rows = [(s, "".join(xml.format(s * 10 + i, f"é{s} &amp; " + "x" * 3000) for i in range(5))) for s in range(20)]
    streams = spark.createDataFrame(rows, "stream long, xml string").repartition(2)
    index = dump.write_streams(streams, str(folder / "dump")).collect()
    assert sorted(r.stream for r in index) == list(range(20))
    index = spark.createDataFrame(index)
    for chosen in ([3, 17], range(20)):
        found = dump.read_streams(index.where(F.col("stream").isin(list(chosen))), 3)
        got = sorted((r.id, r.title, r.revision.text._VALUE[:5]) for r in found.collect())
        assert got == sorted((s * 10 + i, f"t{s * 10 + i}", f"é{s} & "[:5]) for s in chosen for i in range(5))
    # A page's worth of bytes is read, not the file.
    broken = index.where("stream = 3").withColumn("offset", F.col("offset") + 1)
    with pytest.raises(Exception):
        dump.read_streams(broken, 1).count()


def test_answer_stream_restarts_without_repeats(spark, folder):
    source, state, out = folder / "in", str(folder / "state"), str(folder / "out")

    def answer(batch):
        return batch.select("question_id", F.upper("question").alias("ans"))

    def feed(rows):
        frame = spark.createDataFrame(rows, "question_id bigint, question string")
        frame.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(frame.schema).parquet(str(source))
        answer_stream(stream, answer, out, state).awaitTermination()

    feed([(1, "a")])
    feed([(2, "b")])
    got = spark.read.parquet(out).select("question_id", "ans")
    assert sorted(map(tuple, got.collect())) == [(1, "A"), (2, "B")]
