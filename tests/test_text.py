"""Cleaner, analyzers, presentation and metrics against worked examples."""

from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fathom import hooks, session
from fathom.functions import metrics, present, text, wikitext
from fathom.functions.columns import round_nearest
from fathom.operators import corpus, fulltext, hybrid


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def apply(spark, step, raw):
    rows = spark.createDataFrame([(raw,)], "t string")
    return rows.select(step(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(
    "raw, want",
    [
        ("[[Cat]]", "Cat"),
        ("[[Cat|cats]]", "cats"),
        ("[[a|b|c]]", "b|c"),
        ("[[File:q|t [[z|y]] w]]", "[[File:q|t y w]]"),
        ("[[a [[b]] c", "a [[b c"),
        ("[[open", "[[open"),
        ("[[l\nm|n\no]]", "n\no"),
    ],
)
def test_links(spark, raw, want):
    assert apply(spark, wikitext.resolve_links, raw) == want


def test_links_of_any_length(spark):
    label = "x" * 1_000_000
    assert apply(spark, wikitext.resolve_links, f"[[a|{label}]][[{label}") == f"{label}[[{label}"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("== History ==\n{{Main|Dog history, Canis}}", "!!tags:  history  dog history canis \n\n"),
        ("a\n== B ==\n=== C's ===\n\nd", "a\n!!tags:  b   cs    \n\nd"),
        ("no heading", "no heading"),
        ("== X {{y|z}} ==\nq", "!!tags:  x z}}  \n\nq"),
    ],
)
def test_section_tags(spark, raw, want):
    assert apply(spark, wikitext.section_tags, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("{{Short description|Domestic animal}}x", "!!tags: Domestic animal \n\nx"),
        ("{{Short description|}}x", "!!tags: \n\nx"),
        ("{{Short description|never closed", "!!tags: \n\n{{Short description|never closed"),
        ("plain", "!!tags: \n\nplain"),
    ],
)
def test_intro_tags(spark, raw, want):
    assert apply(spark, wikitext.intro_tags, raw) == want


def test_markup(spark):
    raw = "a<br>b<ref name=q>x</ref>c<ref name=\"z\" />d<!-- e\nf -->'''g'''<math>h</math>"
    assert apply(spark, wikitext.drop_markup, raw) == "abcdg"
    runaway = 'a<ref name="(x)">b</ref> body <ref name=y /> c'
    assert apply(spark, wikitext.drop_markup, runaway) == "a c"
    strict = apply(spark, lambda t: wikitext.drop_markup(t, strict=True), runaway)
    assert "body" in strict


def clean(spark, raw):
    rows = spark.createDataFrame([(raw,)], "text string")
    return corpus.clean_articles(rows).first().text


def test_list_line_hides_a_bracket(spark):
    raw = "Intro.\n{{Infobox person\n name = A\n{{list\n* item }}\n}}\nMiddle.\n}}\nAfter."

    def last_steps(t):
        return wikitext.finalize(wikitext.drop_nested(wikitext.pad_brackets(t)))

    assert apply(spark, last_steps, raw) == "Intro. \n\nAfter."


def test_whole_cleaner(spark):
    raw = (
        "{{Short description|Domestic animal}}\nThe '''dog''' is a [[Canis|canid]].<ref>x</ref>\n\n"
        "== History ==\nDogs {{cvt|2|m}} ran.\n* item\n== See also ==\n[[Cat]]"
    )
    want = "!!tags: Domestic animal \n\nThe dog is a canid. \n\n!!tags: history \n\nDogs ran."
    assert clean(spark, raw) == want
    assert clean(spark, None) is None


def test_paragraphs_carry_their_section(spark):
    rows = spark.createDataFrame(
        [(7, "!!tags: Domestic animal \n\nOne. \n \nTwo.\n\n!!tags: history \n\nThree."), (8, "")],
        "page_id bigint, text string",
    )
    got = [tuple(r) for r in corpus.paragraphs(rows).orderBy("id", "chunk").collect()]
    assert got == [
        (7, 0, "Domestic animal", "One."),
        (7, 1, "Domestic animal", "Two."),
        (7, 2, "history", "Three."),
    ]


MARKS = st.lists(st.sampled_from(["{{", "}}", "[[", "]]", "<!", "!>", "a", "b", "\n", "\n"]), max_size=40)


def kept_words(words):
    """Word-by-word statement of the block rule, one pass over a list."""
    out, waiting = [], []
    for w in words:
        if w == "\n":
            out.append(w)
        elif waiting:
            kind = waiting[0]
            if w == kind:
                waiting.append(kind)
            elif w == wikitext.PAIRS[kind]:
                waiting.pop()
        elif w in wikitext.PAIRS:
            waiting.append(w)
        else:
            out.append(w)
    return out


@settings(max_examples=300, deadline=None)
@given(MARKS)
def test_blocks_end_where_their_own_brackets_balance(words):
    got = wikitext.outside_blocks(" ".join(words))
    assert got.replace("\n", " \n ").split(" ") and [
        w for w in got.replace("\n", " \n ").split(" ") if w
    ] == kept_words(words)


def test_namespaces(spark):
    rows = spark.createDataFrame([("Help:X",), ("Dog",), ("Star Trek: X",), ("Files",)], "title string")
    got = [r.title for r in corpus.drop_internal(rows).collect()]
    assert got == ["Dog", "Star Trek: X", "Files"]


def test_analyzers(spark):
    raw = "The dog's  Über-cats, 3.5 of Straße"
    assert apply(spark, text.standard, raw) == ["the", "dog", "s", "über", "cats", "3", "5", "of", "straße"]
    assert apply(spark, text.english_unstemmed, raw) == ["dog", "über", "cats", "3", "5", "straße"]
    assert apply(spark, text.english, raw) == ["dog", "über", "cat", "3", "5", "straße"]


# Examples printed in Porter (1980).
PORTER = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss",
    "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "rational": "ration", "digitizer": "digit", "operator": "oper",
    "feudalism": "feudal", "hopefulness": "hope", "formality": "formal", "triplicate": "triplic",
    "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow",
    "inference": "infer", "adjustment": "adjust", "adoption": "adopt", "effective": "effect",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
}


def test_porter_examples():
    assert {w: text.porter_stem(w) for w in PORTER} == PORTER


def test_snippet(spark):
    t, a = F.lit("The Beatles formed in Liverpool in 1960."), F.lit("Liverpool")
    assert value(spark, present.snippet_before(t, a)) == "...The Beatles formed in "
    assert value(spark, present.snippet_after(t, a)) == " in 1960...."
    assert value(spark, present.snippet_before(t, F.lit("The"))) == ""
    assert value(spark, present.snippet_before(t, F.lit("Rome"))) is None
    assert value(spark, present.context_before(t, a)) == "The Beatles formed in "
    assert value(spark, present.context_after(t, a)) == " in 1960."
    assert value(spark, present.source_url(F.lit("/w"), F.lit("a b"))).endswith("/w#:~:text=a b")


@pytest.mark.parametrize("logit, want", [(10, 1.0), (0, 0.5), (-10, 0.0), (8.1234, 0.9062)])
def test_normalize_score(spark, logit, want):
    assert value(spark, hybrid.normalize_score(F.lit(float(logit)))) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-10, 10) | st.integers(-20000, 20000).map(lambda n: n / 20000), min_size=20, max_size=20))
def test_round_nearest_is_python_round(values):
    from pyspark.sql import SparkSession

    rows = SparkSession.getActiveSession().createDataFrame([(v,) for v in values], "x double")
    got = [r.v for r in rows.select(round_nearest(F.col("x"), 4).alias("v")).collect()]
    assert got == [round(v, 4) for v in values]


def test_confidence_midpoints(spark):
    shown = [value(spark, present.confidence(F.lit(x))) for x in (0.00125, 0.00015, 0.9062, 1.0)]
    assert shown == ["0.13", "0.01", "90.62", "100.00"]


@pytest.mark.parametrize(
    "code, want", [("VEC", "vector"), ("FT", "fulltext"), ("VEC_FT", "hybrid"), ("xyz", "hybrid")]
)
def test_search_type(spark, code, want):
    assert value(spark, hybrid.search_type(F.lit(code))) == want


def test_answer_normalising(spark):
    assert value(spark, metrics.normalize_answer(F.lit("The  Quick, (an) fox!"))) == "quick fox"
    golds = F.array(metrics.answer_tokens(F.lit("Liverpool")))
    long, short = (metrics.answer_tokens(F.lit(a)) for a in ("the city of Liverpool", "The Liverpool!"))
    assert value(spark, metrics.exact_match(long, golds)) == 0
    assert value(spark, metrics.exact_match(short, golds)) == 1
    assert value(spark, metrics.token_f1(long, golds)) == 0.5


def test_functions_get_batches_of_a_bounded_size(spark):
    """By bytes, whatever the partition holds; a session that asks for less keeps that."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        docs = spark.range(6000).selectExpr("id AS key", "repeat('word ', 400) AS text").coalesce(1)
        fulltext.count_words(docs, "key", "text")
        sizes = docs.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n long")
        assert max(r.n for r in sizes.collect()) < 2 * session.BATCH_BYTES
        for ask in (lambda: wikitext.drop_blocks(F.col("t")), lambda: hooks.hashed_embedding(docs, "text")):
            spark.conf.set(name, "64m")
            ask()
            assert spark.conf.get(name) == str(session.BATCH_BYTES)
        spark.conf.set(name, "1m")
        fulltext.count_words(docs, "key", "text")
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_bag_overlap(spark):
    """Against counters, over every pair of some token lists; no fold over the tokens."""
    lists = [[], ["a"], ["a", "a"], ["a", "b", "a"], ["b", "a"], ["a", "a", "a", "c"], ["é", "b", "é", "b", "c"]]
    pairs = [(x, y, sum((Counter(x) & Counter(y)).values())) for x in lists for y in lists]
    rows = spark.createDataFrame(pairs, "x array<string>, y array<string>, n int")
    shared = metrics.shared_tokens(F.col("x"), F.col("y"))
    assert rows.where(shared != F.col("n")).count() == 0
    assert rows.where(shared.isNull()).count() == 0
    assert "aggregate" not in str(shared).lower()
    f1 = metrics.token_f1(F.col("x"), F.array("y"))
    want = F.when(F.size("x") + F.size("y") == 0, 1.0).otherwise(2.0 * F.col("n") / (F.size("x") + F.size("y")))
    assert rows.where(f1 != want).count() == 0


def test_word_ranges(spark):
    samples = ["", "a", " a  bc\n", "Dr. İz-mir's 3½ été", "x" * 70_000 + " y", "\U0001d400b c", "..."]
    rows = spark.createDataFrame([(s,) for s in [*samples, None]], "t string")
    found = rows.select("t", text.word_ranges(F.col("t")).alias("r"), text.standard(F.col("t")).alias("w")).collect()
    for row in found[:-1]:
        cut = [row.t[r.start : r.end].lower() for r in row.r]
        assert cut == row.w
    assert found[-1].r is None


def test_stems_of_arrays(spark):
    rows = spark.createDataFrame([(["cats", "running", "cats"],), ([],), (None,)], "w array<string>")
    got = [r.s for r in rows.select(text.stem_all(F.col("w")).alias("s")).collect()]
    assert got == [["cat", "run", "cat"], [], None]
