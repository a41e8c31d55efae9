"""Answer spans from start and end logits, decoded inside the row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fathom.functions.columns import bind, total


def visible_length(mask: Column) -> Column:
    """Positions before the first padding position."""
    first_zero = F.array_position(mask, 0)
    return F.when(first_zero > 0, first_zero.cast("int") - 1).otherwise(F.size(mask))


def best_span(
    start: Column, end: Column, mask: Column | None = None, first: Column | None = None
) -> Column:
    """struct<span_start,span_end,logit_sum> maximising start[i] + end[j], i <= j.

    One pass that carries the best start seen so far: no pair of positions is
    enumerated and no row leaves its task. The earliest end and, for it, the
    earliest start win ties. `first` moves the search to start at a position,
    e.g. where the context begins."""
    origin = F.lit(0) if first is None else first.cast("int")
    count = F.size(start) if mask is None else visible_length(mask)
    cells = F.zip_with(
        F.transform(start, lambda s, i: F.struct(i.alias("pos"), s.cast("double").alias("s"))),
        end,
        lambda a, e: F.struct(a["pos"].alias("pos"), a["s"].alias("s"), e.cast("double").alias("e")),
    )

    def scan(all_cells: Column) -> Column:
        seen = F.slice(all_cells, origin + 1, F.greatest(count - origin, F.lit(0)))
        head = F.get(all_cells, origin)
        begin = F.struct(
            head["pos"].alias("top"),
            head["s"].alias("top_s"),
            head["pos"].alias("span_start"),
            head["pos"].alias("span_end"),
            (head["s"] + head["e"]).alias("logit_sum"),
        )

        def step(acc: Column, x: Column) -> Column:
            higher = x["s"] > acc["top_s"]
            top = F.when(higher, x["pos"]).otherwise(acc["top"])
            top_s = F.when(higher, x["s"]).otherwise(acc["top_s"])
            better = top_s + x["e"] > acc["logit_sum"]
            return F.struct(
                top.alias("top"),
                top_s.alias("top_s"),
                F.when(better, top).otherwise(acc["span_start"]).alias("span_start"),
                F.when(better, x["pos"]).otherwise(acc["span_end"]).alias("span_end"),
                F.when(better, top_s + x["e"]).otherwise(acc["logit_sum"]).alias("logit_sum"),
            )

        return F.aggregate(seen, begin, step)

    return bind(cells, scan)


def softmax_at(logits: Column, position: Column) -> Column:
    """Probability of one position; padding positions stay in the denominator."""

    def prob(top: Column) -> Column:
        mass = total(F.transform(logits, lambda x: F.exp(x.cast("double") - top)))
        return F.exp(F.get(logits, position).cast("double") - top) / mass

    return bind(F.array_max(logits).cast("double"), prob)


def span_score(start: Column, end: Column, span_start: Column, span_end: Column) -> Column:
    """Start probability times end probability."""
    return softmax_at(start, span_start) * softmax_at(end, span_end)


def span_text(tokens: Column, span_start: Column, span_end: Column) -> Column:
    return F.array_join(F.slice(tokens, span_start + 1, span_end - span_start + 1), " ")
