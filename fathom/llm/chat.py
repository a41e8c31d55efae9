"""Chat formatting: any known layout of a conversation to one template.

A record is a JSON text. Its fingerprint is the hash of its nested field paths,
whatever the values; it selects the declarative mapping that lists the record's
turns. Turns are written in one template, whose control strings are escaped
inside roles and texts, so that reading back gives the very turns. The loss mask
is a list of code point spans, one for each assistant text.

Escaping: a backslash is put between "<" and "|", after those that are there, so
no text holds "<|"; in roles, backslashes and line breaks are escaped as well.

The paths and turns are read from Spark's parsed JSON where that has room for the
record. It has none for a string of some 20 million characters or a record of
128 MiB; then the paths come from the record with its strings emptied and equal
neighbours in lists made one, and the turns from the text by the mapping's own
schema. What is too large even so fails; no valid record becomes an unknown one.
A conversation stays one value, which ends at Spark's 2 GB for a value.

Column expressions only.

Defined cases: a null text or role is empty; turns with one number are ordered by
role and text; a record of unknown layout, or that is no JSON, has null turns and
keeps its fingerprint; an empty list of turns is an empty text; a null
conversation id is one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
_TURNS = "array<struct<role:string,text:string>>"

# A JSON string's inside; possessive, so no text is too long for the matcher.
_INSIDE = r"""(?:[^"\\\x00-\x1F]++|\\["\\/bfnrt]|\\u[0-9A-Fa-f]{4})*+"""
# Records up to this length that do not parse are no JSON.
SURE = 1 << 24


def _read(record: Column, schema: str) -> Column:
    """A record's fields without a bound on the length of strings."""
    return F.from_json(record, schema, {"mode": "FAILFAST", "maxStringLen": str((1 << 31) - 1)})


@dataclass(frozen=True)
class Fields:
    """A layout with one field for each turn, in order: (role, field)."""

    turns: tuple[tuple[str, str], ...]

    @property
    def shapes(self) -> list[str]:
        fields = ", ".join(f"{name}: value" for name in sorted(name for _, name in self.turns))
        return [f"OBJECT<{fields}>"]

    def read(self, record: Column) -> Column:
        value = lambda name: F.coalesce(F.variant_get(record, f"$.{name}", "string"), F.lit(""))
        return self._turns(value)

    def read_text(self, record: Column) -> Column:
        fields = _read(record, ", ".join(f"`{f}` string" for _, f in self.turns))
        return self._turns(lambda name: F.coalesce(fields[name], F.lit("")))

    def _turns(self, value: Callable[[str], Column]) -> Column:
        return F.array(*(F.struct(F.lit(r).alias("role"), value(f).alias("text")) for r, f in self.turns))


@dataclass(frozen=True)
class Messages:
    """A layout with a list of messages; `names` gives the roles their usual names."""

    list_field: str
    role: str
    text: str
    names: dict[str, str] = field(default_factory=dict)

    @property
    def shapes(self) -> list[str]:
        fields = ", ".join(f"{name}: value" for name in sorted([self.role, self.text]))
        return [f"OBJECT<{self.list_field}: ARRAY<{x}>>" for x in (f"OBJECT<{fields}>", "value")]

    @property
    def _kind(self) -> str:
        return f"array<struct<`{self.role}`:string,`{self.text}`:string>>"

    def read(self, record: Column) -> Column:
        return self._turns(F.variant_get(record, f"$.{self.list_field}", self._kind))

    def read_text(self, record: Column) -> Column:
        return self._turns(_read(record, f"`{self.list_field}` {self._kind}")[self.list_field])

    def _turns(self, messages: Column) -> Column:
        def turn(m: Column) -> Column:
            role = F.coalesce(m[self.role], F.lit(""))
            named = role
            for name, usual in self.names.items():
                named = F.when(role == name, usual).otherwise(named)
            return F.struct(named.alias("role"), F.coalesce(m[self.text], F.lit("")).alias("text"))

        return F.transform(messages, turn)


# Layouts that are known. Add one here, or hand a longer list to `canonical`.
LAYOUTS = (
    Messages("messages", "role", "content"),
    Messages("conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    Fields((("user", "prompt"), ("assistant", "completion"))),
    Fields((("system", "instruction"), ("user", "input"), ("assistant", "output"))),
)


def shape(record: Column) -> Column:
    """The nested field paths of a record, as a nested list of names in order."""
    return F.regexp_replace(F.schema_of_variant(record), r"\b[A-Z]+(\(\d+, ?\d+\))?(?=[,>]|$)", "value")


def fingerprint(record: Column) -> Column:
    return F.md5(shape(record).cast("binary"))


def skeleton(record: Column) -> Column:
    """The record with all strings but the names emptied, and of equal neighbours in
    its innermost lists one."""
    emptied = F.regexp_replace(record, rf'("{_INSIDE}"\s*+:)|("){_INSIDE}(")', "$1$2$3")
    once = F.regexp_replace(emptied, r"(\{[^{}\[\]]*+\})(?:\s*+,\s*+\1)++", "$1")
    return F.regexp_replace(once, r'([\[,]\s*+"")(?:\s*+,\s*+""(?=\s*+[,\]]))++', "$1")


def canonical(records: DataFrame, record: str = "record", layouts=LAYOUTS) -> DataFrame:
    """The rows with `fingerprint` and `turns`, an array of (role, text)."""
    rows = records.withColumn("_value", F.try_parse_json(record))
    small = F.col("_value").isNotNull()
    bare = skeleton(F.col(record))
    large = F.try_parse_json(bare)
    refused = F.raise_error(F.lit("a record is too large to tell its layout")).cast("string")
    bare_print = F.when(large.isNull() & (F.length(bare) > SURE), refused).otherwise(fingerprint(large))
    rows = rows.withColumn("fingerprint", F.when(small, fingerprint(F.col("_value"))).otherwise(bare_print))
    turns = F.lit(None).cast(_TURNS)
    for layout in layouts:
        prints = [hashlib.md5(s.encode()).hexdigest() for s in layout.shapes]
        read = F.when(small, layout.read(F.col("_value"))).otherwise(layout.read_text(F.col(record)))
        turns = F.when(F.col("fingerprint").isin(prints), read).otherwise(turns)
    return rows.withColumn("turns", turns.cast(_TURNS)).drop("_value")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escaped_role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _plain_role(role: Column) -> Column:
    """Undoes `_escaped_role`: line breaks first, where their backslash is single."""
    broken = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescaped(F.replace(broken, F.lit("\\\\"), F.lit("\\")))


def formatted(rows: DataFrame, turns: str = "turns") -> DataFrame:
    """The rows with `formatted` and `loss_spans`."""
    head = lambda t: F.concat(F.lit(START), _escaped_role(t["role"]), F.lit("\n"))
    parts = F.transform(
        F.col(turns),
        lambda t: F.struct(
            head(t).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")
        ),
    )
    rows = rows.withColumn("_parts", parts)
    tail = f"{END}\n"

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
        spans = F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((end + len(tail)).cast("int").alias("at"), spans.alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    text = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    spans = F.aggregate("_parts", begin, step, lambda acc: acc["spans"])
    return rows.withColumn("formatted", text).withColumn("loss_spans", spans).drop("_parts")


def turns_of(text: Column) -> Column:
    """The turns of a formatted text."""
    # Nothing stands before the first start.
    pieces = F.slice(F.split(text, r"<\|im_start\|>", -1), 2, 1 << 30)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(END) - 1)
        return F.struct(_plain_role(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(pieces, turn)


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    part = lambda s: unescaped(F.substring(text, s["start"] + 1, s["end"] - s["start"]))
    return F.array_join(F.transform(spans, part), "")


def records_of(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows of turns (role, text) as one JSON record per conversation, in the layout
    that its roles call for."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    one = F.struct(F.col(turn).alias("turn"), text("role").alias("role"), text("text").alias("text"))
    grouped = rows.groupBy(conversation).agg(F.array_sort(F.collect_list(one)).alias("t"))
    roles = F.transform("t", lambda m: m["role"])
    texts = [F.col("t")[i]["text"] for i in range(3)]
    pair = F.struct(texts[0].alias("prompt"), texts[1].alias("completion"))
    task = F.struct(texts[0].alias("instruction"), texts[1].alias("input"), texts[2].alias("output"))
    usual = {"user": "human", "assistant": "gpt", "system": "system"}
    name = F.create_map(*(F.lit(x) for pair_ in usual.items() for x in pair_))
    shared = F.transform("t", lambda m: F.struct(name[m["role"]].alias("from"), m["text"].alias("value")))
    listed = F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    is_ = lambda *names: roles == F.array(*map(F.lit, names))
    known = F.forall(roles, lambda r: r.isin(*usual)) & (roles[0] == "user")
    record = (
        F.when(is_("user", "assistant"), F.to_json(pair))
        .when(is_("system", "user", "assistant"), F.to_json(task))
        .when(known, F.to_json(F.struct(shared.alias("conversations"))))
        .otherwise(F.to_json(F.struct(listed.alias("messages"))))
    )
    return grouped.select(conversation, record.alias("record"))
