"""Document fingerprints: bottom-k sketches of shingle hashes.

A word's hash is its CRC-32; a shingle is SHINGLE consecutive words, its hash 32
middle bits of a weighted sum of its words' hashes. The sketch of a text holds the
SIZE least distinct hashes of its shingles, in order. Sketches of parts merge to
the sketch of the whole: the least hashes of a union are among the least of its
members. So a document's shingles are hashed once, and of its edited text only
those of what was put in: the rest of that sketch comes from the document's own
first shingles.

From two sketches follow resemblance (the share of the least hashes of both
together that are in either), containment, and from one the number of distinct
shingles; all are exact while a union has at most SIZE hashes. The standard error
of a resemblance r is sqrt(r (1 - r) / SIZE).

The next document, in descending order of ids, is found without one global sort:
rows go once, by range, to where their neighbours are, and the first row of each
range goes to the end of the range before as well.

Column expressions only.

Defined cases: a null text is empty; a text with fewer words than a shingle is one
shingle; a text without words has the empty sketch, and two empty sketches are
alike (1.0); ids that are null come last; rows with one id are in order of their
texts' MD5 digest, and rows that are equal follow each other; a single row is its
own next document; an empty table gives no rows; other columns are ignored. Ids
are whole numbers. Equal rows meet in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathom.functions.columns import bind
from fathom.llm.ordered import range_of, range_starts
from fathom.session import settled

SHINGLE = 5
SIZE = 128
WORD = r"[^\x20\x09-\x0D]++"
# Weights of the words of a shingle, by place; below 2 ** 28, so that sums fit. Fixed values.
WEIGHTS = (181783497, 234561023, 98765433, 155370019, 266338057)
SHIFT = 24
BITS = 32
# Characters of text in one range.
RANGE_CHARS = 16 << 20
_LONGS = "array<bigint>"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def shingle_hashes(text_words: Column) -> Column:
    """Hash of each shingle of an array of words, in order of place."""
    hashes = F.transform(text_words, lambda w: F.crc32(w.cast("binary")))

    def of(h: Column) -> Column:
        def at(i: Column) -> Column:
            total = F.get(h, i) * WEIGHTS[0]
            for j in range(1, SHINGLE):
                total = total + F.get(h, i + j) * WEIGHTS[j]
            return F.shiftright(total, SHIFT).bitwiseAND(F.lit((1 << BITS) - 1))

        def short() -> Column:
            total = F.size(h).cast("long")
            for j in range(SHINGLE - 1):
                total = total + F.coalesce(F.get(h, F.lit(j)), F.lit(0)) * WEIGHTS[j]
            return F.array(F.shiftright(total, SHIFT).bitwiseAND(F.lit((1 << BITS) - 1)))

        full = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), at)
        return F.when(F.size(h) >= SHINGLE, full).when(F.size(h) > 0, short()).otherwise(F.array().cast(_LONGS))

    return bind(hashes, of)


def least(hashes: Column, size: int = SIZE) -> Column:
    """The sketch of some hashes."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def sketch(text: Column, size: int = SIZE) -> Column:
    return least(shingle_hashes(words(F.coalesce(text, F.lit("")))), size)


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    """Sketch of the union of what two sketches were made of."""
    return least(F.concat(a, b), size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated size of the intersection over that of the union."""

    def of(union: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(union, a), b)).cast("double")
        return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))

    return bind(merged(a, b, size), of)


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact below `size`."""
    full = (size - 1) * float(1 << BITS) / (F.element_at(a, size) + 1)
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise(full)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of a's shingles that are in b; 1 if a has none."""
    n = distinct_shingles(a, size)
    common = resemblance(a, b, size) * distinct_shingles(merged(a, b, size), size)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / n))


def fingerprint(a: Column) -> Column:
    """A sketch as text: eight hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def sketches(rows: DataFrame, group: str, text: str, size: int = SIZE) -> DataFrame:
    """(group, sketch) of all texts of each group together. A group may be of any
    size: hashes are made distinct where they lie, and tasks hand on their least
    ones only."""
    hashes = rows.select(
        F.col(group).alias("group"),
        F.explode(F.coalesce(sketch(F.col(text), size), F.array().cast(_LONGS))).alias("hash"),
    ).distinct()
    order = Window.partitionBy("group").orderBy("hash")
    best = hashes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    found = best.groupBy("group").agg(F.sort_array(F.collect_list("hash")).alias("sketch"))
    groups = rows.select(F.col(group).alias("group")).distinct()
    joined = groups.join(found.withColumnRenamed("group", "_group"), F.col("group").eqNullSafe(F.col("_group")), "left")
    return joined.select(F.col("group").alias(group), F.coalesce("sketch", F.array().cast(_LONGS)).alias("sketch"))


def _descending(key: Column, body: Column) -> Column:
    """Text that sorts by descending key, null last, then by the text's digest."""
    flipped = F.lpad(F.hex(key.cast("long").bitwiseXOR(F.lit((1 << 63) - 1))), 16, "0")
    return F.concat(F.coalesce(flipped, F.lit("G")), F.md5(body.cast("binary")))


def _with_next(rows: DataFrame, columns: list[str], carried: dict[str, Column], led: list[str]) -> DataFrame:
    """Rows (key, body) with the carried columns, and those named in `led` of the
    next document in descending order of keys; after the last comes the first."""
    rows = rows.withColumn("place", _descending(F.col("key"), F.col("body")))
    chars = rows.agg(F.sum(F.length("body"))).first()[0] or 0
    # Keys are written once, as they are read twice for the ranges' limits.
    starts = range_starts(settled(rows.select("place"), "places"), "place", -(-chars // RANGE_CHARS)) or [""]
    part = range_of(F.col("place"), starts)
    is_start = F.get(F.split(F.lit(",".join(starts)), ","), F.col("part")) == F.col("place")
    before = F.pmod(F.col("part") - 1, F.lit(len(starts)))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("guest"))
    there = F.struct(before.alias("part"), F.lit(1).alias("guest"))
    sent = rows.withColumn("part", part)
    sent = sent.withColumn("to", F.explode(F.when(is_start, F.array(own, there)).otherwise(F.array(own))))
    sent = sent.select(*columns, "place", "to.part", "to.guest").repartition("part")
    for name, column in carried.items():
        sent = sent.withColumn(name, column)
    kept = [*columns, *carried]
    sent = sent.select(*[c for c in kept if not c.startswith("_")], "place", "part", "guest")
    order = Window.partitionBy("part").orderBy("guest", "place")
    return sent.withColumns({f"next_{c}": F.lead(c).over(order) for c in led}).where("guest = 0")


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(key, n_chars, edited, sketch, edited_sketch, next_sketch) of every document,
    where edited is its text with the last half replaced by as much of the next.

    The edited text's shingles are those of the words that stay, but for the last
    of them, which may go on, and those from SHINGLE - 1 words before it on."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    half = F.floor(F.length("body") / 2).cast("int")
    head = F.substring("body", F.lit(1), F.length("body") - half)
    stay = F.greatest(F.size("_head") - 1, F.lit(0))
    before = F.greatest(stay - (SHINGLE - 1), F.lit(0))
    gap = F.when(head.rlike(r"[\x20\x09-\x0D]$"), " ").otherwise("")
    carried = {
        "_hashes": shingle_hashes(words(F.col("body"))),
        "sketch": least(F.col("_hashes"), size),
        "_head": words(head),
        # Of a text of fewer words the one hash is that of all of them.
        "known": least(F.when(stay >= SHINGLE, F.slice("_hashes", F.lit(1), before)).otherwise(F.array().cast(_LONGS)), size),
        "bridge": F.concat(F.array_join(F.slice("_head", before + 1, F.size("_head") + 1), " "), gap),
    }
    rows = _with_next(rows, ["key", "body"], carried, ["body", "sketch"])
    put_in = F.substring("next_body", F.lit(1), half)
    new = least(F.concat("known", shingle_hashes(words(F.concat("bridge", put_in)))), size)
    return rows.select(
        F.col("key").alias(key),
        F.length("body").cast("long").alias("n_chars"),
        F.concat(head, put_in).alias("edited"),
        "sketch",
        # A text that stays as it is keeps its sketch.
        F.when(half == 0, F.col("sketch")).otherwise(new).alias("edited_sketch"),
        "next_sketch",
    )
