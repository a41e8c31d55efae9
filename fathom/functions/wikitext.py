"""Wikitext to plain text as Column steps, plus one Arrow step for nesting.

The steps run in the order of `steps`. Patterns use UNIX line mode, as
only the newline ends a line in wikitext."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from fathom.functions.columns import WHITESPACE, bind, strip, words_by_space
from fathom.session import bound_batches

# Patterns and markers that decide what is removed. Fixed values.
TAIL_SECTIONS = ("See also", "Notes", "References", "Further reading", "External links")
KEPT_LINKS = ("File", "Image")
SHORT_DESCRIPTION = "{{Short description|"
TAGS = "!!tags:"
LIST_MARKS = "*#:"
FLAT_MARKUP = (
    r"<!--.*?-->",
    r"</?nowiki>",
    r"<ref[^(/>)]*>.*?</ref>",
    r"<ref.*?/>",
    r"</?span[^>]*>",
    r"<br\s*/?>",
    r"</?div[^>]*>",
    r"</?su(?:p|b)>",
    r"</?u>",
    r"'{2,}",
    r"</?blockquote>",
    r"&nbsp;",
    r"</?small>",
    r"<gallery[^>]*>.*?</gallery>",
    r"<imagemap.*?</imagemap>",
    r"<math.*?</math>",
    r"<code.*?</code>",
)
BOUNDED_REF = r"<ref[^>]*/>"
PAIRS = {"{{": "}}", "[[": "]]", "<!": "!>"}
LEFTOVERS = rf"(?=[{{}}|(;{WHITESPACE}])(?:\{{\{{|\}}\}}|\||\([{WHITESPACE}]*\)|\([{WHITESPACE}]*;[{WHITESPACE}]*\)|[{WHITESPACE}]*;[{WHITESPACE}]*)"

LINK = (
    r"(?s)\[\[(?!(?:" + "|".join(KEPT_LINKS) + r"):)"
    r"(?:(?:(?!\]\])[^|])*+\|)?((?:(?!\]\]).)*+)\]\]"
)
HEADINGS = (
    rf"(?d)(?:={{2,}}.*?={{2,}}[{WHITESPACE}]?\n+)+"
    r"(?:\{\{(?:Main|Further)\|.*?\}\})?"
)


def cut_tail(text: Column) -> Column:
    """Text before the first closing section."""
    names = "|".join(TAIL_SECTIONS)
    return F.get(F.split(text, rf"={{2,}}[{WHITESPACE}]?(?:{names})", 2), F.lit(0))


def resolve_links(text: Column) -> Column:
    """[[page]] to page, [[page|shown]] to shown; file links stay."""
    return F.regexp_replace(text, LINK, "$1")


def drop_markup(text: Column, strict: bool = False) -> Column:
    """Remove markup that does not nest. `strict` keeps a self-closing ref
    from running over body text."""
    parts = [BOUNDED_REF if strict and p == r"<ref.*?/>" else p for p in FLAT_MARKUP]
    # Looking at the first character spares the other positions the long list.
    pattern = "(?s)(?=[<'&])(?:" + "|".join(p.replace(r"\s", f"[{WHITESPACE}]") for p in parts) + ")"
    return F.regexp_replace(text, pattern, "")


def intro_tags(text: Column) -> Column:
    """Put a tag line first, filled from a closed short description."""
    size = len(SHORT_DESCRIPTION)
    closing = F.instr(text, "}}")
    described = text.startswith(SHORT_DESCRIPTION) & (closing > 0)
    listed = words_by_space(F.translate(F.substring(text, F.lit(size + 1), closing - size - 1), "|", " "))
    head = F.concat(F.array(F.lit(TAGS)), listed, F.array(F.lit("\n\n")))
    return F.when(
        described,
        F.concat(F.array_join(head, " "), F.substring(text, closing + 2, F.length(text))),
    ).otherwise(F.concat(F.lit(f"{TAGS} \n\n"), text))


def _heading_tags(found: Column) -> Column:
    opened = F.instr(found, "{{")
    after_open = F.instr(F.substring(found, opened, F.length(found)), "|")
    bar = F.when(after_open > 0, opened + after_open - 1).otherwise(F.lit(0))
    merged = F.when(
        opened > 0,
        F.concat(
            F.substring(found, F.lit(1), opened - 1),
            F.substring(found, bar + 1, F.greatest(F.length(found) - 2 - bar, F.lit(0))),
        ),
    ).otherwise(found)
    plain = F.lower(F.translate(merged, "\n=,'", " "))
    return F.concat(F.lit(f"{TAGS} "), plain, F.lit(" \n\n"))


def section_tags(text: Column) -> Column:
    """Turn each run of headings, with a main-article note right after it,
    into one lower-cased tag line."""
    pieces = F.split(text, HEADINGS)
    tags = F.transform(F.regexp_extract_all(text, F.lit(HEADINGS), F.lit(0)), _heading_tags)
    padded = F.concat(tags, F.array(F.lit("")))
    tagged = F.array_join(F.zip_with(pieces, padded, lambda a, b: F.concat(a, b)), "")
    return F.when(text.contains("=="), tagged).otherwise(text)


def pad_brackets(text: Column) -> Column:
    """Name table brackets apart from template brackets; space all of them."""
    text = F.replace(text, F.lit("|}}"), F.lit("| }}"))
    text = F.replace(text, F.lit("{|"), F.lit("<!"))
    text = F.replace(text, F.lit("|}"), F.lit("!>"))
    return F.regexp_replace(text, r"(?=[{}\[\]<!])(\{\{|\}\}|\[\[|\]\]|<!|!>)", " $1 ")


def _is_listed(line: Column) -> Column:
    return F.substring(line, 1, 1).isin(*LIST_MARKS)


def drop_list_lines(text: Column) -> Column:
    """Lines that start with a list mark go whole."""
    lines = F.split(text, "\n")
    return F.array_join(F.filter(lines, lambda x: ~_is_listed(x)), "\n")


# A bracket standing alone between whitespace, as pad_brackets leaves it.
LONE_BRACKET = re.compile(
    r"(?<!\S)(?:" + "|".join(re.escape(b) for pair in PAIRS.items() for b in pair) + r")(?!\S)"
)


@F.pandas_udf(T.StringType())
def _outside_blocks(text: pd.Series) -> pd.Series:
    return text.map(outside_blocks, na_action="ignore")


def outside_blocks(text: str) -> str:
    """Text outside bracketed blocks, with the newlines of the blocks kept.

    A block ends where brackets of the kind that opened it balance, possibly
    lines later; other kinds inside it do not count. An unclosed block runs to
    the end."""
    kept: list[str] = []
    resume, depth, kind = 0, 0, ("", "")
    for bracket in LONE_BRACKET.finditer(text):
        mark = bracket.group()
        if depth:
            depth += {kind[0]: 1, kind[1]: -1}.get(mark, 0)
            if not depth:
                kept.append("\n" * text.count("\n", resume, bracket.end()))
                resume = bracket.end()
        elif mark in PAIRS:
            kept.append(text[resume : bracket.start()])
            resume, depth, kind = bracket.start(), 1, (mark, PAIRS[mark])
    rest = text[resume:]
    kept.append("\n" * rest.count("\n") if depth else rest)
    return "".join(kept)


def drop_blocks(text: Column) -> Column:
    """Remove nested blocks and rebuild the whitespace: one space between
    words, a space before the newline of a non-empty line.

    Only texts that hold a bracket visit Python."""
    bound_batches()
    bracketed = text.rlike(r"\{\{|\[\[|<!")
    outside = F.when(bracketed, _outside_blocks(F.when(bracketed, text))).otherwise(text)
    squeezed = F.regexp_replace(outside, f"[{WHITESPACE}&&[^\n]]+", " ")
    lines = F.trim(F.regexp_replace(squeezed, " ?\n ?", "\n"))
    return F.regexp_replace(F.concat(lines, F.lit("\n")), r"(?<=[^\n])\n", " \n")


def drop_nested(text: Column) -> Column:
    """Remove list lines, then nested blocks. A text of list lines only leaves
    nothing."""
    every_line_listed = F.forall(F.split(text, "\n"), _is_listed)
    return F.when(every_line_listed, F.lit("")).otherwise(drop_blocks(drop_list_lines(text)))


def finalize(text: Column) -> Column:
    """Replace leftovers by one space, squeeze spaces and newlines, strip."""
    text = F.regexp_replace(text, LEFTOVERS, " ")
    text = F.regexp_replace(text, " +", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(text)


def steps(strict: bool = False):
    return (
        cut_tail,
        resolve_links,
        lambda t: drop_markup(t, strict),
        intro_tags,
        section_tags,
        pad_brackets,
        drop_list_lines,
        drop_blocks,
        finalize,
    )
