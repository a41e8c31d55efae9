"""Small Column helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Characters that count as whitespace in Python text processing: Unicode
# separators and the control characters that separate. Java's \\s is ASCII only
# and its Unicode mode leaves out four of the controls. Fixed values.
WHITESPACE = r"\p{Z}\t-\r\x1c-\x1f\x85"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row, even when body uses it
    inside a lambda (where it would otherwise run once per element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Drop leading and trailing whitespace."""
    return F.regexp_replace(text, f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def words_by_space(text: Column) -> Column:
    """Non-empty pieces between runs of whitespace."""
    return F.array_remove(F.split(text, f"[{WHITESPACE}]+"), "")


def total(values: Column) -> Column:
    """Sum of an array of numbers as double."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def round_nearest(x: Column, digits: int, ties_up: bool = False) -> Column:
    """Nearest multiple of 10**-digits to the binary value of a double.

    Spark rounds the shortest decimal form, which turns 0.00015 (binary value
    just below) up; languages that round the value itself turn it down. The
    value is split in two so that its distance from the midpoint is exact.
    True midpoints go to the even neighbour, or up when `ties_up`."""
    scale = 2 * 10**digits

    def settle(v: Column) -> Column:
        high = v * 134217729.0 - (v * 134217729.0 - v)
        return bind(
            F.struct(v.alias("v"), high.alias("high"), F.rint(v * scale).alias("halves")),
            lambda p: _settled(p["v"], p["high"], p["halves"], scale, ties_up),
        )

    return bind(x.cast("double"), settle)


def _settled(v: Column, high: Column, halves: Column, scale: int, ties_up: bool) -> Column:
    past = (high * scale - halves) + (v - high) * scale
    below, above = F.floor(halves / 2), F.ceil(halves / 2)
    tie = above if ties_up else F.when(below % 2 == 0, below).otherwise(above)
    units = F.when(past < 0, below).when(past > 0, above).otherwise(tie)
    units = F.when(below == above, below).otherwise(units)
    return units.cast("double") / (scale // 2)
