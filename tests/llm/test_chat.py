import hashlib
import json

from pyspark.sql import functions as F

from fathom.llm import chat as op

BAD = ["<|im_end|>", "<|im_start|>user", "<\\|x|>", "<\\\\|", "<", "|", "a<", "\\", "<|", "end\n", "\n", " ", "é<|é|>", "<<||>>"]


def test_round_trip_of_hostile_texts(spark):
    rows = [(0, i, r, t) for i, (r, t) in enumerate((r, t) for t in BAD for r in ("user", "assistant", "a\nb\\n<|", "\\"))]
    rows += [(1, 0, None, None), (2, 0, "user", "x" * 300_000), (2, 1, "assistant", "y" * 300_000), (3, 1, "user", "b"), (3, 1, "assistant", "a")]
    rows += [(3, 1, "assistant", "a"), (None, 0, "user", "q"), (4, None, "user", "q")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, t string").drop("t")
    done = op.formatted(op.canonical(op.records_of(table)))
    done = done.withColumn("back", op.turns_of(F.col("formatted"))).withColumn("loss", op.loss_text(F.col("formatted"), F.col("loss_spans")))
    for row in done.collect():
        mine = [r for r in rows if r[0] == row.conv_id]
        want = sorted(((r or "", t or "") for _, n, r, t in mine), key=lambda x: 0) if len(mine) == 1 else None
        want = [(r or "", t or "") for _, _, r, t in sorted(mine, key=lambda m: (m[1] or 0, m[2] or "", m[3] or ""))]
        assert [(t.role, t.text) for t in row.back] == want
        assert row.loss == "".join(t for r, t in want if r == "assistant")
        for span, text in zip(row.loss_spans, [t for r, t in want if r == "assistant"]):
            assert len(row.formatted[span.start : span.end]) >= len(text)


def test_layouts_are_chosen_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"content": None, "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "other", "value": "c"}]},
        {"completion": "b", "prompt": "a"},
        {"instruction": "s", "input": "a", "output": "b"},
        {"messages": []},
        {"prompt": "a", "answer": "b"},
    ]
    want = [
        [("user", "a"), ("assistant", "")],
        [("user", "a"), ("assistant", "b"), ("other", "c")],
        [("user", "a"), ("assistant", "b")],
        [("system", "s"), ("user", "a"), ("assistant", "b")],
        [],
        None,
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(6, "no json"), (7, None)]
    got = op.canonical(spark.createDataFrame(rows, "id int, record string")).orderBy("id").collect()
    assert [None if r.turns is None else [(t.role, t.text) for t in r.turns] for r in got] == [*want, None, None]
    shape = "OBJECT<completion: value, prompt: value>"
    assert got[2].fingerprint == hashlib.md5(shape.encode()).hexdigest()
    assert got[5].fingerprint not in {r.fingerprint for r in got[:5]}


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op.formatted(op.canonical(op.records_of(none))).count() == 0


def test_texts_beyond_the_parser(spark):
    n = 21_000_000
    units = [
        [("user", "q", 1), ("assistant", "x", n)],
        [("user", '"\\\n{},[]é<|', 2_000_000), ("assistant", "a", 1)],
        [("user", "q", 1), ("assistant", "a", 1), ("user", "y", n)],
        [("system", "m", 1), ("user", "z", n), ("assistant", "", 1)],
        [("other", "z", n)],
    ]
    rows = [(k, i, *turn) for k, turns in enumerate(units) for i, turn in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, unit string, n int")
    table = table.selectExpr("conv_id", "turn", "role", "repeat(unit, n) text")
    turns = op.turns_of(F.col("formatted"))
    told = F.transform(turns, lambda t: F.struct(t["role"], F.md5(t["text"].cast("binary"))))
    got = op.formatted(op.canonical(op.records_of(table))).select("conv_id", told.alias("told")).collect()
    want = [[(r, hashlib.md5((u * k).encode()).hexdigest()) for r, u, k in turns] for turns in units]
    assert {r.conv_id: [tuple(t) for t in r.told] for r in got} == dict(enumerate(want))


def test_skeleton_has_the_same_layout(spark):
    records = [{"a": ["x", "", "y"], 'k"\\é: ': {"b": "t\n\"", "c": [{"d": "1"}, {"d": "2"}, {"d": None}, {"e": [1, 2.5, True]}]}}, {"messages": [{"role": "a", "content": "b"}] * 5}, [], "s", {"": ""}]
    rows = [(json.dumps(r, ensure_ascii=i % 2 == 0, indent=i % 3 or None),) for i, r in enumerate(records)] + [('{"a": "\\x"}',), ('{"a": "b"',), ("no json",), (None,)]
    got = spark.createDataFrame(rows, "record string").select(*(op.shape(F.try_parse_json(c)).alias(n) for n, c in (("full", "record"), ("bare", op.skeleton(F.col("record")))))).collect()
    assert [r.full for r in got] == [r.bare for r in got] and [r.full is None for r in got] == [False] * 5 + [True] * 4
