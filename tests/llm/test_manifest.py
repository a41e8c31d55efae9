import hashlib
import random

from pyspark.sql import functions as F

from fathom.llm import manifest as op
from helpers import clashing, docs

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def paths(hashes):
    """Of each leaf its siblings, run by run, as (before, after); and the root."""
    up = [[] for _ in hashes]
    at, level = list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for n, i in enumerate(at):
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            up[n].append((run[: i % 3], run[i % 3 + 1 :]))
            at[n] = i // 3
        level = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return up, level[0]


def brute(rows, change):
    """rows of (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: paths([h for _, _, h, _ in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    over, root = paths([built[s][1] for s in names])
    out = []
    for n, s in enumerate(names):
        for up, (_, _, h, row) in zip(built[s][0], sorted(trees[s], key=lambda x: x[:3])):
            now, proof = leaf((*row[:4], change(row))), []
            for before, after in up + over[n]:
                now = sha(*before, now, *after)
                proof += [*before, *after]
            out.append((str(row[0]), h, built[s][1], root, sha(*proof), now, now == root))
    return sorted(out)


def check(spark, rows):
    table = clashing(docs(spark, [(r[0], r[4], r[2], r[1], r[3]) for r in rows]))
    even = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("x"), F.lit(""))).otherwise(F.col("text"))
    got = op.manifest(table, COLUMNS, tamper={"text": even})
    found = sorted(
        (str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect()
    )
    change = lambda r: r[4].replace("x", "") if r[0] is not None and r[0] % 2 == 0 and r[4] is not None else r[4]
    assert found == brute(rows, change)


def rows_of(rng, n, sources):
    text = lambda: rng.choice([None, "", "é|x", "x" * 5000, "plain", "1:2"])
    return [(k, rng.choice(sources), rng.choice([None, "en", ""]), rng.choice([None, 4]), text()) for k in range(n)]


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = rows_of(rng, 260, ["hot"] * 12 + ["a", "é", "", None, "b", "c", "d"])
    # Repeated ids and rows, ids that are null, a tree of one leaf.
    rows += [(7, "hot", None, None, "x")] * 3 + [(7, "hot", "en", None, "y"), (None, "hot", None, None, None)]
    rows += [(-5, "lone", "en", 1, "x")]
    check(spark, rows)
    # Trees higher than their covers, and nodes over several of these.
    monkeypatch.setattr(op, "COVER_LEVELS", 1)
    monkeypatch.setattr(op, "COVER", 3)
    check(spark, rows)


def test_small_trees(spark):
    for n in (2, 4, 10):
        check(spark, rows_of(random.Random(n), n, ["s"]))
    check(spark, [(1, None, None, None, None)])
    check(spark, [(1, "a", None, None, "x"), (2, "b", None, None, "x")])
    assert op.manifest(docs(spark, []), COLUMNS).count() == 0


def test_tampering_is_found(spark):
    rows = [(k, f"{k}", None, "ab"[k % 2], k) for k in range(40)]
    table = docs(spark, rows)
    other = F.when(F.col("doc_id") == 11, F.lit(5)).otherwise(F.col("n_chars"))
    bad = op.manifest(table, COLUMNS, tamper={"n_chars": other}).where("not verified").collect()
    assert [r.doc_id for r in bad] == [11]
    # A row without value and one with an empty one differ.
    empty = F.when(F.col("doc_id") == 3, F.lit("")).otherwise(F.col("lang"))
    bad = op.manifest(table, COLUMNS, tamper={"lang": empty}).where("not verified").collect()
    assert [r.doc_id for r in bad] == [3]


def test_climb_exchanges_no_nodes_of_leaves(spark, monkeypatch):
    """Two thirds of the nodes, which the first step meets only, are not met by the others."""
    seen, climbed = [], op._climbed

    def watched(leaves, nodes, *rest):
        seen.extend(row.node for row in nodes.collect())
        return climbed(leaves, nodes, *rest)

    monkeypatch.setattr(op, "_climbed", watched)
    data = [(i, "a" if i % 3 else "b", f"text {i}") for i in range(60)] + [(99, "c", "alone")]
    table = spark.createDataFrame(data, "doc_id long, source string, text string")
    rows = op.manifest(table, ["doc_id", "source", "text"]).collect()
    assert len(rows) == 61 and all(r.verified for r in rows)
    assert seen and not [n for n in seen if not n.startswith("-1.") and n.split(".")[1] == "0"]
