import random
import zlib

import numpy as np

from fathom.llm import runs as op
from helpers import clashing, docs


def brute(words):
    """All maximal stretches of each period that no divisor or other period explains."""
    n, found = len(words), []
    for q in range(1, n // op.TIMES + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            start, length = i, end + q - i
            piece = words[start : start + length]
            smallest = next(p for p in range(1, length + 1) if piece[p:] == piece[: length - p])
            if smallest == q and length >= max(6, 4 * q):
                found.append((start, length, q))
            i = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rng = random.Random(2)
    out = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b a b a b a", "x " * 500]
    for n in range(400):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        words = [rng.choice(letters) for _ in range(rng.randint(1, 60))]
        if n % 2:
            period = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
            words[rng.randint(0, len(words)) : rng.randint(0, len(words))] = (period * rng.randint(3, 9))[rng.randint(0, 5) :]
        if n % 7 == 0:
            words = (words[: rng.randint(1, 20)] * 9)[: rng.randint(20, 120)] + words
        out.append(rng.choice([" ", "\n", "  "]).join(words))
    # A long text, of which a part repeats with a long period, inside other words.
    long = [f"w{rng.randint(0, 3000)}" for _ in range(20_000)]
    long[5000:14_000] = (long[5000:6900] * 5)[:9000]
    out.append(" ".join(long))
    return out


def test_against_brute_force(spark):
    rows = list(enumerate(texts()))
    got = op.found(clashing(docs(spark, [*rows, rows[-1], (None, "b b b b b b")]))).collect()
    assert len(got) == len(rows) + 2
    by_id = {r.doc_id: r for r in got}
    for k, text in [*rows[:-1], (None, "b b b b b b")]:
        words = (text or "").split()
        want = brute(words)
        row = by_id[k]
        assert [tuple(r) for r in row.runs] == want and row.n_words == len(words)
        assert row.collapsed == collapsed(words, want)
    longest = [tuple(r) for r in by_id[len(rows) - 1].runs]
    assert longest == [(5000, 9000, 1900)]


def test_letters_as_words_of_one_slice():
    """Stretches are looked for over many texts at once."""
    rng = random.Random(6)
    for _ in range(30):
        parts = [[rng.choice("ab") for _ in range(rng.randint(0, 40))] for _ in range(20)]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        flat = np.array([ord(c) for p in parts for c in p], np.int64)
        got = [set() for _ in parts]
        for first, end in op.stretches(flat, starts):
            at = int(np.searchsorted(starts, first, "right")) - 1
            got[at] |= op.runs_of(flat, (first, end), (int(starts[at]), int(starts[at + 1])))
        assert [sorted(g, key=lambda r: (r[0], r[2])) for g in got] == [brute(p) for p in parts]


def test_loops_and_longest(spark):
    from pyspark.sql import functions as F

    rows = [(k, " ".join(f"w{(k * n) % 17}" for n in range(10 + k))) for k in range(60)]
    h = F.crc32(F.col("doc_id").cast("string"))
    pick = F.when(h % 3 == 0, F.struct(F.floor(h / 10).alias("start"), (F.floor(h / 10) % 8 + 3).alias("cycles")))
    table = docs(spark, [*rows, (99, None), (None, "a b")])
    got = {r.doc_id: r for r in op.found(table, source=pick).withColumn("top", op.longest(F.col("runs"))).collect()}
    for k, text in rows:
        words, h = text.split(), zlib.crc32(str(k).encode())
        if h % 3 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        want = brute(words)
        assert [tuple(r) for r in got[k].runs] == want
        top = min(want, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert (got[k].top and (got[k].top.start, got[k].top.length, got[k].top.period)) == top


def test_empty_table(spark):
    assert op.found(docs(spark, [])).count() == 0
