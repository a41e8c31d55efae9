"""How an answer is shown: snippet, full context, link and confidence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fathom.functions.columns import round_nearest

# Fixed values.
SNIPPET_CHARS = 50
SITE = "https://www.wikipedia.org"
FRAGMENT = "#:~:text="
GAP = "..."


def answer_position(text: Column, answer: Column) -> Column:
    """0-based position of the answer, null when it does not occur."""
    at = F.instr(text, answer)
    return F.when(at > 0, at - 1)


def context_before(text: Column, answer: Column) -> Column:
    at = answer_position(text, answer)
    return F.when(at.isNotNull(), F.substring(text, F.lit(1), at))


def context_after(text: Column, answer: Column) -> Column:
    at = answer_position(text, answer)
    return F.when(
        at.isNotNull(), F.substring(text, at + F.length(answer) + 1, F.length(text))
    )


def snippet_before(
    text: Column, answer: Column, width: int = SNIPPET_CHARS, start: Column | None = None
) -> Column:
    """Text before the answer: before `start` where it is given and not null, else
    before the answer's first occurrence."""
    at = answer_position(text, answer)
    at = at if start is None else F.coalesce(start, at)
    lead = F.greatest(at - width, F.lit(0))
    return F.when(at == 0, F.lit("")).when(
        at > 0, F.concat(F.lit(GAP), F.substring(text, lead + 1, at - lead))
    )


def snippet_after(
    text: Column, answer: Column, width: int = SNIPPET_CHARS, start: Column | None = None
) -> Column:
    at = answer_position(text, answer)
    at = at if start is None else F.coalesce(start, at)
    return F.when(
        at.isNotNull(),
        F.concat(F.substring(text, at + F.length(answer) + 1, F.lit(width)), F.lit(GAP)),
    )


def source_url(href: Column, answer: Column, site: str = SITE, encode: bool = False) -> Column:
    shown = F.url_encode(answer) if encode else answer
    return F.concat(F.lit(site), href, F.lit(FRAGMENT), shown)


def confidence(score: Column) -> Column:
    """Percentage with two decimals, as text."""
    return F.format_string("%.2f", round_nearest(100 * score, 2, ties_up=True))
