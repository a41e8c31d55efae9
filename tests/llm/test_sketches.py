import hashlib
import random
import zlib

from pyspark.sql import functions as F

from fathom.llm import ordered, sketches as op
from helpers import by, clashing, docs

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(text):
    h = [zlib.crc32(w.encode()) for w in split(text)]
    low = lambda x: (x >> op.SHIFT) & 0xFFFFFFFF
    if len(h) >= op.SHINGLE:
        found = {low(sum(x * w for x, w in zip(h[i:], op.WEIGHTS))) for i in range(len(h) - op.SHINGLE + 1)}
    else:
        found = {low(len(h) + sum(x * w for x, w in zip(h, op.WEIGHTS)))} if h else set()
    return sorted(found)


def alike(a, b, size):
    union = sorted({*a[:size], *b[:size]})[:size]
    return len([x for x in union if x in a[:size] and x in b[:size]]) / len(union) if union else 1.0


def expected(rows):
    """By a plain sort: ids descending, null last, then the text's digest."""
    rows = [(k, t or "") for k, t in rows]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for n, (k, t) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        half = len(t) // 2
        out.append((k, len(t), t[: len(t) - half] + after[:half], t, after))
    return out


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("ab é\n  ") for _ in range(rng.choice([0, 1, 2, 9, 40, 200])))
    rows = [(k, text()) for k in range(150)] + [(-7, "x y"), (2**62, "long id"), (-(2**62), None), (None, "q"), (None, None)]
    # One id with several texts, and equal rows.
    rows += [(3, text()) for _ in range(30)] + [(5, "same row here")] * 4 + [(900, "word " * 30_000)]
    table = clashing(docs(spark, rows))
    size = 16
    for chars in (1 << 24, 300):
        monkeypatch.setattr(op, "RANGE_CHARS", chars)
        got = op.neighbours(table, size=size).collect()
        found = sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited, r.sketch, r.edited_sketch, r.next_sketch) for r in got)
        want = sorted(
            (k is None, k or 0, n, edited, brute(t)[:size], brute(edited)[:size], brute(after)[:size])
            for k, n, edited, t, after in expected(rows)
        )
        assert found == want


def test_single_row_and_empty_table(spark):
    row = op.neighbours(docs(spark, [(1, "abcdef")])).collect()
    assert [(r.doc_id, r.edited, r.sketch) for r in row] == [(1, "abcabc", brute("abcdef"))]
    assert op.neighbours(docs(spark, [])).count() == 0
    assert op.sketches(docs(spark, []), "source", "text").count() == 0


def test_estimates(spark):
    rng = random.Random(9)
    words = [f"w{n}" for n in range(5000)]
    texts = {}
    base = [rng.choice(words) for _ in range(3000)]
    for k, share in enumerate((0.0, 0.1, 0.5, 1.0)):
        other = [rng.choice(words) for _ in range(3000)]
        cut = int(3000 * share)
        texts[k] = " ".join(base[:cut] + other[cut:])
    rows = docs(spark, [(k, t) for k, t in texts.items()]).withColumn("base", F.lit(" ".join(base)))
    a, b = op.sketch(F.col("text"), 256), op.sketch(F.col("base"), 256)
    whole = op.sketch(F.concat_ws(" ", "text", "base"), 256)
    got = rows.select(
        "doc_id",
        op.resemblance(a, b, 256).alias("r"),
        op.containment(a, b, 256).alias("c"),
        op.distinct_shingles(a, 256).alias("n"),
        # A sketch of parts lies within one shingle border of that of the whole.
        op.resemblance(op.merged(a, b, 256), whole, 256).alias("m"),
    )
    for k, r, c, n, m in [tuple(row) for row in got.collect()]:
        x, y = set(brute(texts[k])), set(brute(" ".join(base)))
        assert abs(r - len(x & y) / len(x | y)) < 0.13
        assert abs(c - len(x & y) / len(x)) < 0.2
        assert abs(n / len(x) - 1) < 0.25
        assert m > 0.95


def test_small_sets_are_exact(spark):
    row = docs(spark, [(1, "a b c d e f")]).select(
        op.resemblance(op.sketch(F.col("text")), op.sketch(F.lit("b c d e f g"))).alias("r"),
        op.containment(op.sketch(F.lit("a b c d e")), op.sketch(F.col("text"))).alias("c"),
        op.resemblance(op.sketch(F.lit("")), op.sketch(F.lit(" \n"))).alias("e"),
        op.distinct_shingles(op.sketch(F.col("text"))).alias("n"),
    ).first()
    assert tuple(row) == (1 / 3, 1.0, 1.0, 2.0)


def test_group_sketches(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))), None, rng.choice(["s"] * 5 + ["t", None])) for k in range(200)]
    rows.append((777, None, None, "only empty"))
    got = by(op.sketches(clashing(docs(spark, rows)), "source", "text", 64), "source", "sketch")
    want = {}
    for _, t, _, s in rows:
        want.setdefault(s, set()).update(brute(t or ""))
    assert got == {s: sorted(h)[:64] for s, h in want.items()}


def test_positions(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 50)
    rng = random.Random(1)
    rows = [(rng.choice(["a"] * 5 + ["b", None]), rng.choice([None, *range(40)]), n) for n in range(1000)]
    got = ordered.positions(spark.createDataFrame(rows, "g string, k long, n long"), ["g"], ["k", "n"], "t").collect()
    per = {}
    for g, k, n in rows:
        per.setdefault(g, []).append((k is not None, k or 0, n))
    want = {x[2]: i for g in per for i, x in enumerate(sorted(per[g]))}
    assert {r.n: r.idx for r in got} == want
