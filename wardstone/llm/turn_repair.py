"""Conversation structure repair by a generalised LR parser of the role grammar.

The grammar says which role sequences are whole conversations. Rows are read left to right; every live stack of the LR
automaton may keep the row, give it another role, delete it or take an inserted turn before it, each at its cost. Stacks
share their lower parts (a node is a state and the node below it), and equal stack tops are merged: of the ways that lead
to one, the least by (cost, audit) stays, where audit is the string of the edits' initials. Two ways of equal cost over
the same rows differ first inside both audits, so what follows cannot change their order and merging loses nothing.

Spark finds repeated rows by a grouping that is combined before its shuffle, deals conversations out by key and sorts
their turns; a task then streams them. Edits that all live stacks agree on are final and leave at once, so a task holds
the rows between the first disagreement and now, not a conversation. A text's digest is a chain over its rows, which is
why one conversation stays with one task.

Turns are taken by (turn, role, text), nulls first. A null role or text is one space and so a null id or turn in the
damage key; a null conv_id is a conversation of its own. Other columns, whatever their names, are left out. Repeated
input rows are rows (and then duplicates of each other); an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import os
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Left sides and right sides; a nonterminal is an upper-case letter, the first one is the start.
ROLES = (("T", ""), ("T", "B"), ("T", "sB"), ("B", "P"), ("B", "BP"), ("P", "ua"))
NAMES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
# Whatever follows a top of this grammar can follow any other top too, after two turns inserted at most (a pair after a
# system turn) and with the one system turn deleted. So a top that costs more than that above another never wins.
MAKES_UP = 2 * INSERT + DELETE
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SPACE = r"\x20\x09-\x0D"


@cache
def automaton(rules=ROLES):
    """(moves, reductions): states are numbered LR(0) item sets from 0; ``moves[state][symbol]`` is the next state,
    ``reductions[state]`` its complete items."""

    def closed(items):
        new = list(items)
        items = set(new)
        while new:
            r, dot = new.pop()
            for k, (left, _) in enumerate(rules):
                if rules[r][1][dot : dot + 1] == left and (k, 0) not in items:
                    items.add((k, 0))
                    new.append((k, 0))
        return frozenset(items)

    first = closed((k, 0) for k, (left, _) in enumerate(rules) if left == rules[0][0])
    numbers, moves, queue = {first: 0}, {}, [first]
    for state in queue:
        ahead = {}
        for r, dot in state:
            if dot < len(rules[r][1]):
                ahead.setdefault(rules[r][1][dot], []).append((r, dot + 1))
        for symbol in sorted(ahead):
            to = closed(ahead[symbol])
            if to not in numbers:
                numbers[to] = len(numbers)
                queue.append(to)
            moves.setdefault(numbers[state], {})[symbol] = numbers[to]
    done = {n: [rules[r] for r, dot in state if dot == len(rules[r][1])] for state, n in numbers.items()}
    return moves, done


class Stacks:
    """Live stack tops with the least (cost, audit) that leads to each; the part of the audits that all of them share
    is given out by ``settled``."""

    def __init__(self, rules=ROLES):
        self.moves, self.done = automaton(rules)
        self.start = rules[0][0]
        self.nodes = {}
        self.tops = self.filled({self.node(0, None): (0, "")})

    def node(self, state, below):
        return self.nodes.setdefault((state, below), (state, below))

    def shifted(self, top, symbol):
        """The tops after reading a symbol; where nothing else can follow, complete rules are reduced."""
        to = self.moves.get(top[0], {}).get(symbol)
        if to is None:
            return []
        tops, out = [self.node(to, top)], []
        while tops:
            top = tops.pop()
            if self.moves.get(top[0]) or not self.done[top[0]]:
                out.append(top)
            if not self.moves.get(top[0]):
                tops += [t for rule in self.done[top[0]] for t in self.reduced(top, rule)]
        return out

    def reduced(self, top, rule):
        for _ in rule[1]:
            top = top[1]
        to = self.moves.get(top[0], {}).get(rule[0])
        return [] if to is None else [self.node(to, top)]

    @staticmethod
    def put(tops, top, way):
        if top not in tops or way < tops[top]:
            tops[top] = way
            return True

    def filled(self, tops):
        """Insertions after the tops, until none is better."""
        new = list(tops)
        while new:
            top = new.pop()
            cost, audit = tops[top]
            for symbol in NAMES:
                new += [t for t in self.shifted(top, symbol) if self.put(tops, t, (cost + INSERT, audit + "I"))]
        return tops

    def read(self, initial, fault):
        out, more = {}, UNFINISHED * (fault == TRUNCATED)
        for top, (cost, audit) in self.tops.items():
            self.put(out, top, (cost + DELETE, audit + "D"))
            if fault in (BLANK, DUPLICATE):
                continue
            for t in self.shifted(top, initial):
                self.put(out, t, (cost + KEEP + more, audit + "K"))
            for symbol in NAMES:
                for t in self.shifted(top, symbol):
                    self.put(out, t, (cost + REROLE + more, audit + "R"))
        out = self.filled(out)
        most = min(out.values())[0] + MAKES_UP
        self.tops = {t: way for t, way in out.items() if way[0] <= most}

    def accepts(self, top):
        """Whether reductions at the end lead to the start symbol on the bottom."""
        seen, new = set(), [top]
        while new:
            top = new.pop()
            for rule in self.done[top[0]]:
                if rule[0] == self.start:
                    base = top
                    for _ in rule[1]:
                        base = base[1]
                    if base == (0, None):
                        return True
                    continue
                new += [t for t in self.reduced(top, rule) if t not in seen]
                seen.update(new)
        return False

    def settled(self):
        n = len(os.path.commonprefix([audit for _, audit in self.tops.values()]))
        head = next(iter(self.tops.values()))[1][:n]
        self.tops = {t: (c, a[n:]) for t, (c, a) in self.tops.items()}
        return head

    def best(self):
        return min(way for top, way in self.tops.items() if self.accepts(top))


class Conversation:
    """Reads the rows of one conversation in order; ``edits`` come out as soon as they are settled."""

    def __init__(self):
        self.stacks, self.audit, self.cost, self.waiting = Stacks(), [], 0, []
        self.position, self.lines, self.counts = 0, hashlib.sha256(), [0, 0, 0, 0]
        self.low = self.high = self.last_turn = self.before = None
        self.turns, self.any, self.row, self.given = 0, False, None, 0

    def read(self, turn, role, text, fault):
        initial = role[:1]
        if fault != BLANK and (turn, role, text) == self.row:
            fault = DUPLICATE
        self.row = turn, role, text
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.last_turn
            self.high = self.last_turn = turn
        if fault:
            self.counts[fault - 1] += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.counts[3] += 1
        self.before = initial
        self.waiting.append((role, text))
        self.stacks.read(initial, fault)
        return self.edits(self.stacks.settled())

    def end(self):
        self.cost, rest = self.stacks.best()
        return self.edits(rest)

    def edits(self, audit):
        """(edit, role, text) of the settled edits; a deleted row has its own role."""
        self.audit.append(audit)
        out, used = [], 0
        for edit in audit:
            role, text = (None, "") if edit == "I" else self.waiting[used]
            used += edit != "I"
            if edit != "D":
                if edit != "K":
                    role = NAMES["ua"[self.position % 2]]
                elif self.position == 0 and role[:1] == "s":
                    self.position -= 1  # a system turn stands before the pairs
                self.position += 1
                self.lines.update((("\n" if self.any else "") + f"{role}:{text}").encode())
                self.any = True
            out.append((edit, role, text))
        del self.waiting[:used]
        return out


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that a checksum of ``conv_id:turn`` picks for a row."""
    put = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(put("conv_id"), F.lit(":"), put("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        rows.select("conv_id", "turn", put("role").alias("role"), put("text").alias("text"), kind.alias("kind"))
        .where("kind <> 0")
        .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("col")
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds the fault of each row: 1 blank, 2 duplicate of one of an earlier turn, 3 truncated, else 0. Where a
    (conversation, role, text) occurs again, its least turn is combined before the shuffle, and only these are joined
    back. Equal rows of one turn stand side by side in the sorted turns, where the reader sees them."""
    key = F.sha2(F.concat_ws("\x00", F.col("conv_id").cast("string"), F.col("conv_id").isNull().cast("string"), "role", "text"), 256)
    last = F.regexp_extract("text", rf"([^{SPACE}])[{SPACE}]*\z", 1)
    rows = rows.withColumns({"key": key, "place": F.struct("turn"), "last": last})
    again = rows.where("last <> ''").groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    fault = (
        F.when(F.col("last") == "", BLANK).when(F.col("place") > F.col("first"), DUPLICATE)
        .when(~F.col("last").isin(".", "!", "?"), TRUNCATED).otherwise(0)
    )
    return rows.join(again, "key", "left").select("conv_id", "turn", "role", "text", fault.alias("fault"))


def streamed(rows: DataFrame, each_row, at_end, schema: str) -> DataFrame:
    """Deals conversations out and runs one ``Conversation`` after the other over their sorted rows. ``each_row`` and
    ``at_end`` turn (conv_id, conversation, edits) into rows of ``schema``."""
    kinds = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kinds)

    def run(batches):
        now, key, out = None, None, []
        for batch in batches:
            for conv, turn, role, text, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault"))):
                if now is None or conv != key:
                    if now is not None:
                        out += at_end(key, now, now.end())
                    now, key = Conversation(), conv
                out += each_row(key, now, now.read(turn, role, text, fault))
            yield table(out)
            out = []
        if now is not None:
            yield table(at_end(key, now, now.end()))

    def table(out):
        return pa.RecordBatch.from_pydict({f: [r[i] for r in out] for i, f in enumerate(kinds.names)}, schema=arrow)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "turn", "role", "text", "fault").mapInArrow(run, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit): the turns of the repaired conversations in order, from 0, with the edit
    (K kept, R another role, I inserted) that made them."""
    schema = "conv_id long, position long, role string, text string, edit string"

    def lines(key, now, edits):
        out = []
        for edit, role, text in edits:
            if edit != "D":
                out.append((key, now.given, role, text, edit))
                now.given += 1
        return out

    return streamed(with_faults(plain(rows)), lines, lines, schema)


def plain(rows: DataFrame) -> DataFrame:
    """Rows as they are, in the form of ``damaged``."""
    put = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", "turn", put("role"), put("text"))


def report(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows``: what the damage left wrong, the cheapest repair and its digest."""
    schema = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
              "repaired_sha256 string")

    def whole(key, now, edits):
        gaps = 0 if now.low is None else now.high - now.low + 1 - now.turns
        return [(key, gaps, *now.counts, now.cost, "".join(now.audit), now.lines.hexdigest())]

    found = streamed(with_faults(damaged(rows)), lambda *a: [], whole, schema)
    ids = rows.select("conv_id").distinct()
    zero = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    zero |= {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return ids.alias("i").join(found.alias("f"), F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left").select(
        "i.conv_id", *[F.coalesce(f"f.{c}", v).alias(c) for c, v in zero.items()])
