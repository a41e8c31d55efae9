import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import neighbours as op
from helpers import clashing

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and len(v) == 16 and None not in v]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any()]
    out = []
    for q, x in {i: v for i, v in good if i % 20 == 0}.items():
        near = sorted((-float(np.cumsum(x * v)[-1]), i) for i, v in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((7, 16))
    rows = [(i, (centers[rng.integers(7)] + 0.5 * rng.standard_normal(16)).tolist()) for i in range(n)]
    same = rows[20][1]
    rows[30:90] = [(i, same) for i in range(30, 90)]  # one very common vector
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] + [1.0] * 15), (1060, [float("inf")] * 16)]
    rows += [(1080, [1.0, 2.0]), (1100, [None] + [1.0] * 15), (1120, []), (1140, [1e-30] * 16)]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("block,sample,parts", [(4096, 4096, 2), (5, 50, 4), (4096, 3, 1)])
def test_against_brute_force(spark, monkeypatch, block, sample, parts):
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "SAMPLE", sample)
    rows = vectors(600, 4)
    table = clashing(spark.createDataFrame(rows, SCHEMA)).repartition(parts)
    got = op.search(table, F.col("key") % 20 == 0, 20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 20)


def test_few_rows_and_empty(spark):
    rows = [(0, [1.0] * 16), (1, [2.0] * 16), (2, [-1.0] * 16)]
    got = op.search(spark.createDataFrame(rows, SCHEMA), F.col("key") % 20 == 0, 20).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 32.0), (0, 2, 2, -16.0)]
    assert op.search(spark.createDataFrame([], SCHEMA), F.col("key") % 20 == 0, 20).count() == 0


def test_codes_prune_and_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    bits = op.code_bits(64)
    turned = x @ op.rotation(64).T
    assert turned.shape[1] == bits == op.LEAST_BITS
    assert np.allclose(turned @ turned[:5].T, x @ x[:5].T)
    align = np.abs(turned).sum(axis=1) / np.sqrt(bits)
    estimate = (np.where(turned > 0, 1, -1) @ turned[:50].T) / np.sqrt(bits) / align[:, None]
    slack = np.sqrt((1 - align**2) / align**2 / (bits - 1))
    error = np.abs(estimate - x @ x[:50].T) / slack[:, None]
    assert 0.85 < np.sqrt((error**2).mean()) < 1.1
    assert (error < op.DEVIATIONS).mean() > 0.9999
