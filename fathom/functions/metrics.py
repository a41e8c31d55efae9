"""Answer normalisation of the public SQuAD scorer, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from fathom.functions.columns import bind, words_by_space

# ASCII punctuation and English articles. Fixed values.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = r"(?U)(?=[at])\b(?:a|an|the)\b"


def answer_tokens(answer: Column) -> Column:
    """Lower-cased words without punctuation and articles."""
    plain = F.translate(F.lower(answer), PUNCTUATION, "")
    return words_by_space(F.regexp_replace(plain, ARTICLES, " "))


def normalize_answer(answer: Column) -> Column:
    return F.array_join(answer_tokens(answer), " ")


def exact_match(tokens: Column, golds: Column) -> Column:
    """1 when the answer's tokens equal those of any gold answer."""
    return F.array_contains(golds, tokens).cast("int")


def numbered(tokens: Column) -> Column:
    """The tokens with their second and later occurrences numbered, so that no two are
    equal: bags as sets. Numbers follow a space, which no token holds. Null as empty."""
    return F.when(_distinct(tokens), tokens).otherwise(bind(F.sort_array(tokens), _numbered))


def _numbered(tokens: Column) -> Column:
    """The same of sorted tokens that are not all different: runs, then their members."""
    places = F.sequence(F.lit(0), F.size(tokens) - 1)
    first = lambda i: (i == 0) | (F.get(tokens, i) != F.get(tokens, i - 1))

    def member(token: Column, n: Column) -> Column:
        return F.when(n == 1, token).otherwise(F.concat(token, F.lit(" "), n.cast("string")))

    def runs(starts: Column) -> Column:
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(tokens)))
        return F.flatten(
            F.zip_with(
                starts, ends, lambda b, e: F.transform(F.sequence(F.lit(1), e - b), lambda n: member(F.get(tokens, b), n))
            )
        )

    return bind(F.filter(places, first), runs)


def _distinct(tokens: Column) -> Column:
    return F.size(F.array_distinct(tokens)) == F.size(tokens)


def _again(tokens: Column) -> Column:
    """Second and later occurrences, sorted."""
    return bind(F.sort_array(tokens), lambda s: F.filter(s, lambda t, i: (i > 0) & (t == F.get(s, i - 1))))


def shared_tokens(x: Column, y: Column) -> Column:
    """Size of the bag overlap of two token arrays: what they share as sets, and of what
    both hold again. Only that is numbered, if it is no set on either side."""

    def shared(x: Column, y: Column, beyond: Callable[[Column], Column]) -> Column:
        sets = F.size(F.array_intersect(x, y))
        return F.when(x == y, F.size(x)).when(_distinct(y) | _distinct(x), sets).otherwise(beyond(sets))

    def again(p: Column) -> Column:
        bags = F.size(F.array_intersect(numbered(p["x"]), numbered(p["y"])))
        return shared(p["x"], p["y"], lambda _: bags)

    both = F.struct(_again(x).alias("x"), _again(y).alias("y"))
    return shared(x, y, lambda sets: sets + bind(both, again))


def token_f1(tokens: Column, golds: Column) -> Column:
    """Best bag F1 over the gold answers' tokens; 1 when both sides are empty."""

    def against(gold: Column) -> Column:
        size = F.size(tokens) + F.size(gold)
        return F.when(size == 0, 1.0).otherwise(2.0 * shared_tokens(tokens, gold) / size)

    return F.array_max(F.transform(golds, against))
