"""Text analysis: tokens, stop words and stems."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from fathom.functions.columns import bind
from fathom.session import bound_batches

# Everything that is not a letter, mark or digit separates words.
SEPARATOR = r"[^\p{L}\p{M}\p{N}]+"

# English stop words of the public Lucene English analyzer. Fixed values.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will",
    "with",
)

STEMS_REMEMBERED = 1 << 18

Analyzer = Callable[[Column], Column]


def standard(text: Column) -> Column:
    """Lower-cased words in text order."""
    return F.array_remove(F.split(F.lower(text), SEPARATOR), "")


def word_ranges(text: Column) -> Column:
    """Character range (start, end; end exclusive) of each word of `standard`, in
    order: the text's own characters, before they are lower-cased."""

    def of(chars: Column) -> Column:
        last = F.size(chars) - 1
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        gap = lambda i: F.coalesce(F.get(chars, i), F.lit(" ")) == " "
        starts = F.filter(places, lambda i: ~gap(i) & gap(i - 1))
        ends = F.transform(F.filter(places, lambda i: ~gap(i) & gap(i + 1)), lambda i: i + 1)
        return F.arrays_zip(starts.alias("start"), ends.alias("end"))

    blank = F.regexp_replace(text, SEPARATOR.rstrip("+"), " ")
    return F.when(text.isNotNull(), bind(F.array_remove(F.split(blank, ""), ""), of))


def english_unstemmed(text: Column) -> Column:
    """Standard words without possessive endings and stop words."""
    bare = F.regexp_replace(text, r"['’＇][sS](?![\p{L}\p{M}\p{N}])", "")
    return F.filter(standard(bare), lambda w: ~w.isin(*STOP_WORDS))


def english(text: Column) -> Column:
    """Stop words removed and words reduced to their stems."""
    bound_batches()
    return stem_all(english_unstemmed(text))


ANALYZERS: dict[str, Analyzer] = {
    "standard": standard,
    "english_unstemmed": english_unstemmed,
    "english": english,
}


class Stems(dict):
    """Word to stem, remembered for the words met last."""

    def __missing__(self, word: str) -> str:
        if len(self) >= STEMS_REMEMBERED:
            self.clear()
        stem = self[word] = porter_stem(word)
        return stem


def stemmed(words: pa.Array, known: Stems) -> pa.Array:
    """Stems of an array of words; each distinct one is stemmed once."""
    coded = words.dictionary_encode()
    stems = pa.array([known[w] for w in coded.dictionary.to_pylist()], pa.string())
    return stems.take(coded.indices)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Porter stems of each row's words, by the distinct words of a batch."""
    known = Stems()
    for lists in batches:
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        missing = None if lists.null_count == 0 else pc.is_null(lists)
        yield pa.ListArray.from_arrays(ends, stemmed(lists.flatten(), known), mask=missing)


# Porter (1980), "An algorithm for suffix stripping". Each step lists
# suffix -> replacement in the paper's order. Fixed values.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"),
    ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(stem: str) -> str:
    """One letter per character: v for vowel, c for consonant."""
    out: list[str] = []
    for ch in stem:
        vowel = ch in "aeiou" or (ch == "y" and out[-1:] == ["c"])
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _doubled(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _swap(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    hits = [(s, r) for s, r in rules if word.endswith(s)]
    if not hits:
        return word
    suffix, new = max(hits, key=lambda h: len(h[0]))
    stem = word[: -len(suffix)]
    return stem + new if _measure(stem) > 0 else word


def porter_stem(word: str) -> str:
    if len(word) <= 2:
        return word
    # plurals
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # past tense and -ing
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            stem = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(stem):
                word = stem
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _doubled(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP_2), STEP_3)
    hits = [s for s in STEP_4 if word.endswith(s)]
    if hits:
        suffix = max(hits, key=len)
        stem = word[: -len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("l") and _doubled(word) and _measure(word) > 1:
        word = word[:-1]
    return word
