"""Secrets in texts: known forms, and strings of high entropy.

Known forms are found by pattern: assignments, access keys, long hex strings.
Further candidates are long runs of key-like characters. Over each candidate a
window slides; the sum of c * log2(c) over the counts c of its characters changes
only by the counts of the character that leaves and the one that enters, and the
window's Shannon entropy follows from that sum. A run of windows whose entropy
reaches the threshold of the candidate's character class is a span, unless the
candidate holds a word of the allow list or the span lies in a known form.
Entropy sums are whole millionths, so results do not depend on summation order.

A class is that of the whole candidate. Windows of few symbols cannot reach the
threshold of a wider class, so runs of a narrow alphabet inside candidates (hex in
any case, hex with dashes, base32 in one case) are judged on their own as well, by
thresholds that random strings reach; there a word of the allow list hides only the
windows that overlap it. Spans of both kinds that overlap or touch are one.

Column expressions only. Spans are code points, end exclusive.

Defined cases: a null or empty text has no spans; repeated rows are judged each;
an empty table gives no rows; long candidates are cut into overlapping pieces,
so no array grows with the square of a text; other columns are ignored.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from fathom.functions.columns import bind

# Names of things that are assigned.
_NAMES = ("password", "passwd", "secret", "token")
_KEY = ("api", "key")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in word)


ASSIGN = (
    "("
    + "|".join([*map(_either_case, _NAMES), "_?".join(map(_either_case, _KEY))])
    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{24,}"
ASSIGN_LEAST = 6
# In the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 24
# Class, whole-candidate pattern, least entropy of a window in thousandths of a bit.
CLASSES = (
    ("hex", "^[0-9A-Fa-f]+$", 3000),
    ("letters", "^[A-Za-z]+$", 4150),
    ("word", "^[0-9A-Za-z]+$", 3900),
    ("symbols", "", 4050),
)
# Candidates with one of these, in either case, are no secrets. Fixed values.
ALLOW = ("example", "sample", "dummy", "placeholder", "changeme", "0123456789", "abcdefghijklmnop")
# Narrow alphabets: runs, what a run has to hold, least entropy of a window in
# thousandths of a bit. Random windows of 16 and of 32 symbols are above it in
# more than 99 of 100 cases.
NARROW = (
    ("[0-9A-Fa-f]{24,}", "", 3000),
    ("[0-9A-Fa-f-]{24,}", "[0-9]-?[A-Fa-f]|[A-Fa-f]-?[0-9]", 3000),
    ("[A-Z2-7]{24,}", "[0-9]", 3500),
    ("[a-z2-7]{24,}", "[0-9]", 3500),
)
# Window starts in one piece of a candidate.
PIECE = 512

# c * log2(c) in millionths, for c from 0.
TERMS = [round(1e6 * c * log2(c)) if c else 0 for c in range(WINDOW + 1)]


def most_sum(least_entropy: int) -> int:
    """Largest sum of terms at which a window has that entropy."""
    return int(WINDOW * (1e6 * log2(WINDOW) - 1000 * least_entropy))


REDACTED = "[REDACTED]"
_SPANS = "array<struct<start:int,end:int>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def matches(text: Column, pattern: str, group: int = 0, least: int = 1) -> Column:
    """Spans of the leftmost matches whose group has `least` characters. Match
    positions follow from the lengths of the pieces between matches."""
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("piece"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["found"]), F.lit(0))
        kept = F.when(
            F.length(x["part"]) >= least, F.concat(acc["spans"], F.array(_span(start, end)))
        ).otherwise(acc["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), _none().alias("spans"))
    found = F.aggregate(zipped, begin, step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), found).otherwise(_none())


def _count(window: Column, char: Column) -> Column:
    return F.length(window) - F.length(F.replace(window, char, F.lit("")))


def _term(count: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TERMS)), (count + 1).cast("int"))


def _first_sum(window: Column) -> Column:
    chars = F.array_distinct(F.split(window, "", -1))
    return F.aggregate(chars, F.lit(0), lambda acc, c: acc + F.when(c == "", 0).otherwise(_term(_count(window, c))))


def _grown(acc: Column, start: Column, end: Column) -> Column:
    """One more span, in order of start, to the last run or as a new one."""
    joins = start <= acc["end"]
    closed = F.when(acc["end"] < 0, acc["runs"]).otherwise(
        F.concat(acc["runs"], F.array(_span(acc["start"], acc["end"])))
    )
    return F.struct(
        F.when(joins, acc["start"]).otherwise(start).cast("int").alias("start"),
        F.when(joins, F.greatest(acc["end"], end)).otherwise(end).cast("int").alias("end"),
        F.when(joins, acc["runs"]).otherwise(closed).alias("runs"),
    )


def _open() -> Column:
    return F.struct(F.lit(0).alias("start"), F.lit(-1).alias("end"), _none().alias("runs"))


def _closed(acc: Column) -> Column:
    last = F.array(_span(acc["start"], acc["end"]))
    return F.when(acc["end"] < 0, acc["runs"]).otherwise(F.concat(acc["runs"], last))


def merged(spans: Column) -> Column:
    """Spans, sorted by start, with those that overlap or touch made one."""
    return F.aggregate(spans, _open(), lambda acc, s: _grown(acc, s["start"], s["end"]), _closed)


def _hot_runs(piece: Column, offset: Column, limit: Column) -> Column:
    """Runs of windows of a piece whose sum is at most the limit."""

    def step(acc: Column, i: Column) -> Column:
        before = F.substring(piece, i, F.lit(WINDOW))
        leaves, enters = F.substring(piece, i, F.lit(1)), F.substring(piece, i + WINDOW, F.lit(1))
        out = _count(before, leaves)
        # The count of what enters is taken after the other has left.
        into = _count(before, enters) - F.when(leaves == enters, 1).otherwise(0)
        sum_ = acc["sum"] + _term(out - 1) - _term(out) + _term(into + 1) - _term(into)
        return _tested(acc["run"], sum_, offset + i)

    def _tested(run: Column, sum_: Column, start: Column) -> Column:
        hot = F.when(sum_ <= limit, _grown(run, start, start + WINDOW)).otherwise(run)
        return F.struct(sum_.cast("int").alias("sum"), hot.alias("run"))

    steps = F.when(F.length(piece) > WINDOW, F.sequence(F.lit(1), F.length(piece) - WINDOW)).otherwise(
        F.array().cast("array<int>")
    )
    return bind(
        _tested(_open(), _first_sum(F.substring(piece, 1, WINDOW)), offset),
        lambda begin: F.aggregate(steps, begin, step, lambda acc: _closed(acc["run"])),
    )


def _limit(value: Column) -> Column:
    limit = F.lit(most_sum(CLASSES[-1][2]))
    for _, pattern, least in reversed(CLASSES[:-1]):
        limit = F.when(value.rlike(pattern), most_sum(least)).otherwise(limit)
    return limit


def _value(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def _runs(value: Column, start: Column, limit: Column) -> Column:
    """Runs of hot windows of a value that begins at `start`, piece by piece."""
    starts = F.sequence(F.lit(0), F.length(value) - WINDOW, F.lit(PIECE))
    runs = F.transform(
        starts, lambda at: _hot_runs(F.substring(value, at + 1, F.lit(PIECE + WINDOW - 1)), start + at, limit)
    )
    return merged(F.flatten(runs))


def _candidate_runs(text: Column, span: Column) -> Column:
    def of(value: Column) -> Column:
        allowed = F.lower(value).rlike("|".join(ALLOW))
        return F.when(allowed, _none()).otherwise(_runs(value, span["start"], _limit(value)))

    return bind(_value(text, span), of)


def high_entropy(text: Column) -> Column:
    """Spans of high entropy in the candidates of a text."""
    return bind(
        matches(text, CANDIDATE), lambda spans: F.flatten(F.transform(spans, lambda s: _candidate_runs(text, s)))
    )


def narrow(text: Column) -> Column:
    """Spans of high entropy in runs of a narrow alphabet, by start."""
    hidden = text
    for word in ALLOW:
        hidden = F.regexp_replace(hidden, f"(?i){word}", " " * len(word))
    hidden = F.when(text.rlike(f"(?i){'|'.join(ALLOW)}"), hidden).otherwise(text)

    def of(body: Column) -> Column:
        def runs(pattern: str, holds: str, least: int) -> Column:
            def one(span: Column) -> Column:
                found = lambda v: F.when(
                    v.rlike(holds), _runs(v, span["start"], F.lit(most_sum(least)))
                ).otherwise(_none())
                return bind(_value(body, span), found)

            return bind(matches(body, pattern), lambda spans: F.flatten(F.transform(spans, one)))

        return merged(F.array_sort(F.concat(*(runs(*kind) for kind in NARROW))))

    return F.when(text.rlike(CANDIDATE), bind(hidden, of)).otherwise(_none())


def _labelled(spans: Column, kind: str) -> Column:
    rank = F.lit(KINDS.index(kind))
    return F.transform(
        spans, lambda s: F.struct(s["start"], rank.alias("rank"), s["end"], F.lit(kind).alias("kind"))
    )


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with arrays `base` (known forms) and `added` (high entropy) of
    (start, rank, end, kind), by start, then kind."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = F.array_sort(
        F.concat(
            _labelled(matches(body, ASSIGN, 2, ASSIGN_LEAST), "assign"),
            _labelled(matches(body, ACCESS), "access"),
            _labelled(matches(body, HEX), "hex"),
        )
    )
    inside = lambda e: F.exists("base", lambda b: (b["start"] <= e["start"]) & (b["end"] >= e["end"]))
    hot = merged(F.array_sort(F.concat(high_entropy(body), narrow(body))))
    return docs.withColumn("base", base).withColumn(
        "added", F.filter(_labelled(hot, "entropy"), lambda e: ~inside(e))
    )


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, each secret replaced by a mark."""
    found = find(docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns))), f"_{docs.columns.index(text)}")
    body = F.col(f"_{docs.columns.index(text)}")
    plain = lambda spans: F.transform(spans, lambda s: _span(s["start"], s["end"]))
    spans = merged(F.array_sort(F.concat(plain("base"), plain("added"))))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(body, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], before, F.lit(REDACTED)).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body)))
    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)
    value = F.when(F.size("base") + F.size("added") > 0, done).otherwise(body)
    return found.select(*((value if c == text else F.col(f"_{i}")).alias(c) for i, c in enumerate(docs.columns)))
