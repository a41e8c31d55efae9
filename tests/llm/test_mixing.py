import hashlib
import random

from pyspark.sql import functions as F

from fathom.llm import mixing as op
from helpers import clashing, docs


def fill(children, budget):
    """Shares of a budget by weight: full children are closed one at a time."""
    got, left = {}, dict(children)
    while left:
        weight = sum(w for w, _ in left.values())
        over = [n for n, (w, room) in left.items() if room * weight <= w * budget]
        if not over:
            return got | {n: w * budget // weight for n, (w, _) in left.items()}
        name = min(over, key=lambda n: left[n][1] / left[n][0])
        got[name] = left[name][1]
        budget -= left.pop(name)[1]
    return got


def brute(rows, weights, budget, epochs):
    """rows: (key, (level values), tokens)."""
    leaves = {}
    for _, path, n in rows:
        leaves[path] = leaves.get(path, 0) + n
    now = {(): sum(leaves.values()) * budget // 100}
    for depth in range(len(next(iter(leaves)))):
        after = {}
        for parent, have in now.items():
            children = {}
            for path, n in leaves.items():
                if path[:depth] == parent:
                    w = weights[depth].get(path[depth], 1)
                    children[path[: depth + 1]] = (w, children.get(path[: depth + 1], (w, 0))[1] + n * epochs)
            after |= fill(children, have)
        now = after
    out = {}
    for path, total in leaves.items():
        full, rest = divmod(now[path], total) if total else (0, 0)
        sums = {}
        for key, p, n in rows:
            if p == path:
                sums[key] = sums.get(key, 0) + n
        at = 0
        for key in sorted(sums, key=lambda k: hashlib.md5(f"{op.SEED}:{full}:{'' if k is None else k}".encode()).hexdigest()):
            at += sums[key]
            out[key, path] = (sums[key], now[path], full + (at <= rest))
    return out


def test_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for k in range(400):
        source = rng.choice(["a1"] * 6 + ["b1", "c2", "d2", "e3", None])
        rows.append((k, " ".join("w" * rng.randint(1, 30) for _ in range(1)) + " x" * rng.randint(0, 20), rng.choice(["en", "de", None]), source))
    rows += [(400, None, "en", "a1"), (401, "", "de", "z9"), (402, " x \n", "en", "b1"), (402, "x y", "en", "b1"), (None, "a b", "en", "a1")]
    table = clashing(docs(spark, rows))
    levels = {"domain": F.right("source", F.lit(1)), "lang": F.col("lang"), "source": F.col("source")}
    weights = {"lang": {"en": 3}, "domain": {"2": 5, "3": 4}}
    plain = [
        (k, (s[-1] if s else "", lang or "", s or ""), len((t or "").split()))
        for k, t, lang, s in rows
    ]
    for budget, epochs in ((60, 2), (5, 1), (190, 2), (500, 3)):
        got = op.mix(table, levels, weights, budget=budget, epochs=epochs).collect()
        found = {(r.doc_id, (r.domain, r.lang, r.source)): (r.n_tokens, r.target, r.copies) for r in got}
        assert len(found) == len(got)
        assert found == brute(plain, [weights["domain"], weights["lang"], {}], budget, epochs)
    taken = op.taken(table, levels, weights)
    assert taken.columns == [*table.columns, "copies"]
    want = {k: c for k, (_, _, c) in brute(plain, [weights["domain"], weights["lang"], {}], 60, 2).items() if c}
    assert len(taken.collect()) == sum(1 for k, p, _ in plain if (k, p) in want)


def test_shortages_go_to_siblings_first(spark):
    # en holds two sources; the small one is short, and its shortage stays in en.
    rows = [(1, "x " * 10, "en", "s"), *((i, "x " * 10, "en", "t") for i in range(2, 40)), *((i, "x " * 10, "de", "u") for i in range(40, 80))]
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    got = {r.source: r.target for r in op.mix(docs(spark, rows), levels, {}, budget=50, epochs=1).collect()}
    assert got == {"s": 10, "t": 187, "u": 197}


def test_names_of_its_own_columns(spark):
    """Columns named like those of the result, or of the join, in the table."""
    rows = [(k, "x " * 5, "en", "s") for k in range(20)]
    table = docs(spark, rows)
    for name in ("copies", "_key", "_lang", "tokens", "target", "range"):
        table = table.withColumn(name, F.lit("mine"))
    got = op.taken(table, {"lang": F.col("lang")}, {}, budget=50, epochs=1).collect()
    assert len(got) == 10 and all(r["_key"] == r["_lang"] == r["range"] == "mine" and r["copies"] == 1 for r in got)


def test_empty_table(spark):
    levels = {"lang": F.col("lang")}
    assert op.mix(docs(spark, []), levels, {}).count() == 0
    assert op.taken(docs(spark, []), levels, {}).count() == 0
