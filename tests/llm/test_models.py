"""Fitted operators: held-out quality, and the cases every table may hold."""

import random
import zlib

import pytest

from fathom.llm import languages, queries, toxicity  # noqa: F401
from fathom.plans.catalog import QUERIES
from helpers import by, clashing, docs

FOLDER = "/root/testdata/sf0.1"


def test_toxicity_on_held_out_rows(spark):
    found = by(QUERIES["op3_toxicity"](spark, FOLDER), "doc_id", "held_out", "score", "predicted")
    labels = by(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id", "toxic")
    rows = [(labels[k], s, p) for k, (held, s, p) in found.items() if held and k in labels]
    assert all((zlib.crc32(str(k).encode()) % 3 == 1) == held for k, (held, _, _) in list(found.items())[:500])
    caught = sum(p for y, _, p in rows if y) / sum(1 for y, _, _ in rows if y)
    wrong = sum(p for y, _, p in rows if not y) / sum(1 for y, _, _ in rows if not y)
    assert caught > 0.85 and wrong < 0.01


def test_toxicity_learns_pairs(spark):
    """Neither term decides alone: only both together are toxic."""
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        filler = " ".join(rng.choice(["tree", "house", "water", "stone"]) for _ in range(6))
        rows.append((i, f"{'insult ' * a}{filler}{' people' * b} n{i}"))
        labels.append((i, int(a and b)))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), labels.where("doc_id < 1000"))
    test = [(1, "insult tree people"), (2, "insult tree water"), (3, "stone people"), (4, "house"), (5, None), (6, "")]
    got = by(toxicity.scores(clashing(docs(spark, test)), model), "doc_id", "score")
    assert got[1] > 0.9 and max(got[k] for k in (2, 3, 4, 5, 6)) < 0.3
    table = clashing(docs(spark, test + [(1, "insult people"), (None, "house")]))
    kept = toxicity.clean(table, model)
    assert kept.columns == table.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2, 3, 4, 5, 6, None], key=str)


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1), (1, None)], [(None, 1)]])
def test_toxicity_without_both_classes(spark, labels):
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, [(1, "a b"), (2, None)]), labels)
    got = by(toxicity.scores(docs(spark, [(1, "a"), (2, None)]), model), "doc_id", "score")
    assert all(0 <= v <= 1 for v in got.values()) and len(got) == 2
    assert toxicity.scores(docs(spark, []), model).count() == 0


def test_languages_on_held_out_rows(spark):
    found = by(QUERIES["op8_languages"](spark, FOLDER), "doc_id", "held_out", "lang_pred", "score")
    truth = by(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id", "lang")
    held = [(truth[k], p) for k, (h, p, _) in found.items() if h]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= s <= 1 for _, _, s in found.values())


def test_language_cases(spark):
    rows = [(i, "the house and the water are there", "en") for i in range(20)]
    rows += [(50 + i, "das Haus und der Wald sind nicht da", "de") for i in range(20)] + [(90, None, "en"), (91, "le", None)]
    model = languages.fit(docs(spark, rows))
    assert model.languages == ["de", "en"]
    test = [(1, "The house, the water!"), (2, "Der Wald und das Haus"), (3, None), (4, ""), (5, "123 -- 45"), (1, "the water"), (6, "\U0001d400"), (None, "the")]
    test.append((7, "the house and " * 50_000))
    got = by(languages.predict(clashing(docs(spark, test)), model), "doc_id", "lang_pred")
    assert got == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: got[6], 7: "en", None: "en"}
    none = languages.fit(docs(spark, []))
    assert by(languages.predict(docs(spark, [(1, "a")]), none), "doc_id", "lang_pred") == {1: "und"}
    assert languages.predict(docs(spark, []), model).count() == 0


def test_masks_have_no_false_negatives():
    import numpy as np

    rng = np.random.default_rng(0)
    grams = {name: rng.integers(0, 2**64, 500, np.uint64) for name in (f"l{i:02}" for i in range(70))}
    built = languages.Filter.of(sorted(grams), grams)
    for bit, name in enumerate(built.languages):
        masks = built.masks(grams[name])
        assert (masks[:, bit // 8] >> (bit % 8) & 1).all()
    strange = built.masks(rng.integers(0, 2**64, 20_000, np.uint64))
    seen = np.array([(strange[:, b // 8] >> (b % 8) & 1).mean() for b in range(70)])
    assert np.abs(seen - built.chance()).max() < 0.002
