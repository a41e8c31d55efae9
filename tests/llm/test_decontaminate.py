import random
import re
import string

import pytest

from fathom.llm import decontaminate as op
from helpers import clashing, docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items):
    found = []
    for key, text in rows:
        have, hit, ids = words(text), set(), set()
        for item, other in items:
            w = words(other)
            n = min(len(w), 10)
            for k in range(len(w) - n + 1 if n else 0):
                for i in range(len(have) - n + 1):
                    if have[i : i + n] == w[k : k + n]:
                        hit.update(range(i, i + n))
                        ids.add("null" if item is None else str(item))
        found.append((key, len(have), len(hit), tuple(sorted(ids))))
    return sorted(found, key=str)


def tables(spark):
    rng = random.Random(3)
    pool = ["ab", "Ñandú", "c1", "D", "e", "été", "x9", "q"]
    line = lambda n: rng.choice([" ", "-", "  "]).join(rng.choice(pool) for _ in range(n))
    items = [(1, line(30)), (2, line(10)), (10, "Short ITEM"), (None, line(12)), (5, None), (6, ""), (1, line(11)), (7, "...")]
    rows = [(i, f"{line(8)} {rng.choice(items)[1]}! {line(9)}") for i in range(40)]
    rows += [(100, None), (101, ""), (102, "short, item"), (102, "short, item"), (None, items[0][1]), (103, "shorts item")]
    # One id, one number of words, with and without a window; ids that are null too.
    rows += [(105, items[1][1]), (105, "no " * 10), (None, items[1][1]), (None, "no " * 10)]
    rows.append((104, (line(9) + " zz ") * 3000 + items[1][1].upper()))
    return rows, items


@pytest.mark.parametrize("block", [op.BLOCK_BYTES, 40])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK_BYTES", block)
    rows, items = tables(spark)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = op.contamination(clashing(docs(spark, rows)), clashing(bench)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=str) == brute(rows, items)


def test_spans_are_in_the_original(spark):
    items = [(1, "one two three four five six seven eight nine ten")]
    text = "é — Ah! ONE, two three\nfour five six seven eight nine-ten. End"
    bench = spark.createDataFrame(items, "item_id long, text string")
    (row,) = op.contamination(docs(spark, [(1, text)]), bench).collect()
    assert [text[s.start : s.end] for s in row.spans] == ["ONE, two three\nfour five six seven eight nine-ten"]


def test_clean_keeps_whole_rows(spark):
    rows, items = tables(spark)
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = clashing(docs(spark, rows))
    kept = op.clean(table, bench)
    assert kept.columns == table.columns
    want = [k for k, _, hit, _ in brute(rows, items) if not hit]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.contamination(docs(spark, []), none).count() == 0
    assert op.contamination(docs(spark, [(1, "a b")]), none).collect()[0].n_hit == 0
    assert op.clean(docs(spark, [(1, "a b")]), none).count() == 1
