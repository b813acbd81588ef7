"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame expressions only.

A template names the strings that mark turns, the roles that carry loss and the role changes that are allowed. Formatting
emits text segments, each with a loss flag; a conversation's text is the concatenation of its segments. Strings of the
template that stand inside roles or texts are escaped: a backslash goes after their first character and backslashes of
the text are doubled, so that a marker can only come from the template and every text is read back as it was.

Turns are taken by (turn, role, text), nulls first. A null role or text is empty, a null conv_id is a conversation like
any other, repeated rows are turns of their own, an empty table gives an empty one; other columns, whatever their names,
are left out of the result. Texts may be as long as a Spark string.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """``opening`` role ``body`` text ``closing`` for each turn; ``moves``: the roles that may follow a role, ``""``
    standing for the start; a conversation may end after the roles in ``final``."""

    opening: str = "<|turn|>"
    body: str = "<|text|>"
    closing: str = "<|end|>"
    loss: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if any(len(c) < 2 or ESCAPE in c for c in self.controls):
            raise ValueError("a marker needs two characters and no backslash")
        if any(a.endswith(b[:k]) for a, b in product(self.controls, repeat=2) for k in range(1, min(len(a), len(b)))):
            raise ValueError("a marker may not begin as another one ends, else a text could run into it")

    @property
    def controls(self) -> tuple[str, str, str]:
        return self.opening, self.body, self.closing

    def escaped(self, text: Column) -> Column:
        text = F.replace(F.coalesce(text, F.lit("")), F.lit(ESCAPE), F.lit(ESCAPE * 2))
        for c in self.controls:
            text = F.replace(text, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
        return text

    @staticmethod
    def unescaped(text: Column) -> Column:
        """A pair of backslashes is one, a single backslash is none."""
        return F.regexp_replace(text, r"\\(\\?)", "$1")

    def segments(self, role: Column, text: Column) -> Column:
        """The turn as an array of (text, loss)."""
        piece = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(self.opening), self.escaped(role), F.lit(self.body))
        return F.array(
            piece(head, F.lit(False)),
            piece(self.escaped(text), F.coalesce(role.isin(*self.loss), F.lit(False))),
            piece(F.lit(self.closing), F.lit(False)),
        )

    def allowed(self, before: Column, role: Column) -> Column:
        """Whether the machine, in the state ``before`` (the last role, ``""`` at the start), may read ``role``."""
        table = F.map_from_arrays(
            F.array(*map(F.lit, self.moves)), F.array(*[F.array(*map(F.lit, to)) for to in self.moves.values()]))
        return F.coalesce(F.array_contains(F.element_at(table, before), role), F.lit(False))

    def turns(self, formatted: Column) -> Column:
        """The (role, text) pairs that a formatted conversation holds."""
        part = lambda t, mark, n: F.element_at(F.split(t, re.escape(mark), -1), n)
        pieces = F.split(formatted, re.escape(self.opening), -1)
        pieces = F.slice(pieces, F.lit(2), F.size(pieces) - 1)  # nothing stands before the first mark
        return F.transform(pieces, lambda t: F.struct(
            self.unescaped(part(t, self.body, 1)).alias("role"),
            self.unescaped(part(part(t, self.body, 2), self.closing, 1)).alias("text"),
        ))


def segments(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, turn, role, allowed, part, text, loss): the segments of every turn, in no gathered form. ``allowed``
    says whether the machine may read the turn after the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.lag("role", 1, "").over(order)
    return (
        rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "text")
        .select("conv_id", "turn", "role", template.allowed(before, F.col("role")).alias("allowed"),
                F.posexplode(template.segments(F.col("role"), F.col("text"))).alias("part", "s"))
        .select("conv_id", "turn", "role", "allowed", "part", "s.text", "s.loss")
    )


def formatted(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, formatted, mask, faults, complete), one row a conversation, as a training sample is one text. ``mask``
    holds (start, bytes) of the segments with loss in the text's UTF-8 bytes, in order; ``faults`` counts turns that the
    machine does not allow where they stand; ``complete`` says that it may end there."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    pieces = F.col("pieces.text")
    return (
        rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "text")
        .select("conv_id", "turn", "role", "text", template.segments(F.col("role"), F.col("text")).alias("pieces"),
                F.lag("role", 1, "").over(order).alias("before"))
        .select("conv_id", "turn", "role", "text", F.array_join(pieces, "").alias("marked"), "before",
                F.octet_length(pieces[0]).alias("head"), F.octet_length(pieces[1]).alias("bytes"), F.col("pieces")[1]["loss"].alias("loss"))
        .select("conv_id", "role", "marked", "bytes", "loss", template.allowed(F.col("before"), F.col("role")).alias("allowed"),
                F.sum(F.octet_length("marked").cast("long")).over(upto).alias("end"), "head")
        .select("conv_id", "allowed", F.struct(
            "end", "marked", "loss", "role", "bytes", (F.col("end") - F.octet_length("marked") + F.col("head")).alias("start")).alias("t"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"), F.count_if(~F.col("allowed")).alias("faults"))
        .select(
            "conv_id", F.array_join(F.col("turns.marked"), "").alias("formatted"),
            F.transform(F.filter("turns", lambda t: t.loss), lambda t: F.struct(t.start.alias("start"), t.bytes.alias("bytes"))).alias("mask"),
            "faults", F.element_at("turns", -1)["role"].isin(*template.final).alias("complete"),
        )
    )


def under_loss(text: str = "formatted", mask: str = "mask") -> Column:
    """The pieces of a formatted text that its loss mask covers."""
    data = F.encode(F.col(text), "UTF-8")
    return F.transform(mask, lambda m: F.decode(F.substring(data, (m.start + 1).cast("int"), m.bytes), "UTF-8"))


CHECK_ID, CHECK_TEXT = -7, "</s>[INST] ok [/INST]"


def with_check_conversation(rows: DataFrame) -> DataFrame:
    """The rows and one conversation more, whose texts are control strings of common templates."""
    added = rows.sparkSession.range(2).select(
        F.lit(CHECK_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CHECK_TEXT).alias("text"),
    )
    return rows.select("conv_id", "turn", "role", "text").union(added)


def report(rows: DataFrame, template: Template = Template("<s>[INST]", "[/INST]", "</s>")) -> DataFrame:
    """Digests of what is read back from the formatted conversations: turns from the text by its markers, loss text from
    the text by its mask."""
    one = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    learned = template.unescaped
    return (
        formatted(with_check_conversation(rows), template)
        .select("*", template.turns(F.col("formatted")).alias("turns"), F.array_join(F.transform(under_loss(), learned), "").alias("learned"))
        .select(
            "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(one, ""), 256).alias("turns_sha256"),
            F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"), "faults", "complete",
        )
    )


def sql(template: Template = Template("<s>[INST]", "[/INST]", "</s>")) -> str:
    """The same figures without formatting anything: sizes are added up, faults come from neighbouring roles."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    found = lambda t: " + ".join(f"(length({t}) - length(replace({t}, {quoted(c)}, ''))) // {len(c)}" for c in (ESCAPE, *template.controls))
    marks = sum(map(len, template.controls))
    legal = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, to in template.moves.items() for b in to)
    among = lambda roles: ", ".join(map(quoted, roles))
    return f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES ({CHECK_ID}, 0, 'user', {quoted(CHECK_TEXT)}), ({CHECK_ID}, 1, 'assistant', {quoted(CHECK_TEXT)}))
), placed AS (
  SELECT *, row_number() OVER w AS n, lag(role, 1, '') OVER w AS before_ FROM rows_
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role IN ({among(template.loss)})), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role IN ({among(template.loss)})), '')) AS loss_sha256,
  sum({marks} + length(role) + length(text) + {found('role')} + {found('text')})::BIGINT AS formatted_chars,
  count(*) FILTER (WHERE (before_, role) NOT IN ({legal})) AS faults,
  last(role ORDER BY n) IN ({among(template.final)}) AS complete
FROM placed GROUP BY conv_id"""
