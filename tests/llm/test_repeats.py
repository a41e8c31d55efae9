import hashlib
import random

import numpy as np
import pytest

from fathom.llm import repeats as op
from helpers import clashing, docs


def brute(rows):
    """Removed ranges and what is left, by a table of all strings."""
    first = {}
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    texts = [(t or "").encode() for _, t in rows]
    out = {}
    for i in order:
        key, data = rows[i][0], texts[i]
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - op.WIDTH + 1):
            window = data[p : p + op.WIDTH]
            if first.setdefault(window, (key, p)) < (key, p):
                gone[p : p + op.WIDTH] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[key] = (len(data), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest())
    return out


def texts(rng):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage, edge = line(60), line(25)
    out = [line(rng.randint(1, 150)) for _ in range(30)]
    # Copies, copies with edits, one passage in many texts, strings of just WIDTH.
    out += [out[3], out[3], out[4] + "!", out[5][7:], out[6][:130] + "#" + out[6][131:]]
    out += [f"{line(rng.randint(0, 9))}{passage}{line(rng.randint(0, 9))}" for _ in range(60)]
    out += [f"{line(3)}{edge[:100]}{line(3)}" for _ in range(5)] + [f"{line(3)}{edge[:99]}" for _ in range(5)]
    # Repeats inside one text, with overlaps.
    out += ["a" * 100, "a" * 101, "a" * 350, "ab" * 200, passage + passage, "xyz" * 33, "", None, "é" * 120]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("hot,segment,parts", [(2000, op.SEGMENT, 3), (5, op.SEGMENT, 7), (5, 300, 1), (2000, 300, 2)])
def test_against_brute_force(spark, monkeypatch, hot, segment, parts):
    monkeypatch.setattr(op, "HOT", hot)
    monkeypatch.setattr(op, "SEGMENT", segment)
    rows = [(k - 20, t) for k, t in enumerate(texts(random.Random(hot + segment)))]
    table = clashing(docs(spark, rows)).repartition(parts)
    got = {
        r.doc_id: (r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest())
        for r in op.kept(table).collect()
    }
    assert got == brute(rows)


def test_previous_factors():
    rng = random.Random(2)
    data = np.array([rng.choice([97, 98]) for _ in range(3000)] + [97] * 400, np.uint8)
    starts = np.arange(len(data) - 12)
    position = np.array(rng.sample(range(len(starts)), len(starts)))
    got = op.previous_factors(data, starts, position, width=12)
    order = np.argsort(position)
    seen = [set() for _ in range(13)]
    for i in order:
        want = max(n for n in range(13) if n == 0 or data[i : i + n].tobytes() in seen[n])
        assert got[i] == want
        for n in range(1, 13):
            seen[n].add(data[i : i + n].tobytes())


def test_repeated_rows_and_null_keys(spark):
    long = "the quick brown fox " * 3 + "jumps over the lazy dog and runs into the dark deep forest of pines"
    rows = [(1, long), (1, long), (None, long), (2, long), (3, "short")]
    got = sorted(((r.doc_id, len(r.kept)) for r in op.kept(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (None, len(long)), (2, 0), (3, 5)], key=str)


def test_empty_table(spark):
    assert op.kept(docs(spark, [])).count() == 0
