import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as op
from fathom.llm import arrow, decontaminate, mixing, secrets
from fathom.plans.catalog import table
from test_minhash import brute as classes
from test_secrets import added, base

FOLDER = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in op.STAGES:
        docs = stage(spark, docs, FOLDER)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = docs
        assert docs.columns == columns or name == "mixing"
    ids = {name: {r.doc_id for r in rows.collect()} for name, rows in seen.items()}
    texts = {r.doc_id: r.text for r in seen["toxicity"].collect()}
    found = classes(sorted(texts.items()), 5, 80)
    assert ids["near_duplicates"] == {k for k, (_, c) in found.items() if k == c}
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    automaton = decontaminate.automaton_of([(str(i), t.encode()) for i, t in items])
    clean = {k for k in ids["near_duplicates"] if not decontaminate.scan(automaton, texts[k].encode())[1]}
    assert ids["decontamination"] == ids["secrets"] == clean
    for row in seen["secrets"].collect():
        text = texts[row.doc_id]
        assert (row.text == text) == (not base(text) and not added(text))
        assert row.n_chars == len(row.text) and (secrets.REDACTED in row.text) == (row.text != text)
    assert ids["mixing"] <= clean and all(r.copies in range(1, mixing.EPOCHS + 1) for r in seen["mixing"].collect())
    assert {r.doc_id: r.copies for r in op.run(spark, FOLDER).collect()} == {r.doc_id: r.copies for r in seen["mixing"].collect()}


def test_functions_of_a_stage_get_bounded_batches(spark):
    """A function that is handed slices holds the batch they lie in, which is bounded too."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "64m")
    try:
        rows = spark.range(24).coalesce(1).select(F.repeat(F.lit("x"), 1 << 20).alias("body"))

        def size(part):
            return pa.RecordBatch.from_arrays([pa.array([part.column(0).buffers()[2].size])], ["size"])

        sizes = [row["size"] for row in arrow.mapped(rows, "body", size, "size long").collect()]
    finally:
        spark.conf.set(name, before)
    assert sizes and max(sizes) <= 8 << 20
