"""Chat formatting and conversation repair against plain Python, and their results for odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from wardstone.llm import chat_format, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, key string, fault int, before string, turns int, n int"
MARKED = ["</s>", "a\\</s>\\", "[INST]", "\\", "\\\\/s>", "<s>[INST] [/INST]", "<\\/s>", "é\n\x00€"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, equal turns, roles out of order or unknown, clashing names."""
    rows = [(None, 0, "user", "who? "), (None, 1, "assistant", None), (1, None, "system", "be kind."), (1, 0, "user", "a."),
            (1, 0, "user", "a."), (1, 0, "assistant", "b"), (1, 5, None, "c!"), (2, 1, "tool", ""), (3, 2, "user", "x" * 300_000 + "."),
            (3, 3, "assistant", "y. " * 100_000)]
    rows += [(4, k, "user" if k % 2 == 0 else "assistant", t + ".") for k, t in enumerate(MARKED)]
    return spark.createDataFrame([(*r, "k", 1, "b", 2, 3) for r in rows], SCHEMA)


MOVES = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows, whole=True):
    """(cost, audit) by the states of a deterministic machine instead of stacks; ``rows``: (initial, fault)."""
    def put(ways, state, way):
        if state not in ways or way < ways[state]:
            ways[state] = way
            return True

    def insert(ways):
        while any([put(ways, r, (c + 3, a + "I")) for s, (c, a) in list(ways.items()) for r in MOVES[s] if r != "s"]):
            pass
        return ways

    ways = insert({"": (0, "")})
    for initial, fault in rows:
        new = {}
        for state, (cost, audit) in ways.items():
            put(new, state, (cost + 4, audit + "D"))
            for r in MOVES[state] if fault not in (1, 2) else "":
                if r == initial:
                    put(new, r, (cost + 3 * (fault == 3), audit + "K"))
                elif r != "s":
                    put(new, r, (cost + 3 + 3 * (fault == 3), audit + "R"))
        ways = insert(new)
    return min(ways[s] for s in ("", "a") if s in ways)


def every_way(rows, state="", cost=0, audit="", inserts=0):
    """All repairs, with at most three insertions in a row, one by one."""
    if not rows and state in ("", "a"):
        yield cost, audit
    if inserts < 3:
        for r in MOVES[state].replace("s", ""):
            yield from every_way(rows, r, cost + 3, audit + "I", inserts + 1)
    if rows:
        (initial, fault), rest = rows[0], rows[1:]
        yield from every_way(rest, state, cost + 4, audit + "D")
        for r in MOVES[state] if fault not in (1, 2) else "":
            if r == initial:
                yield from every_way(rest, r, cost + 3 * (fault == 3), audit + "K")
            if r != "s":
                yield from every_way(rest, r, cost + 3 + 3 * (fault == 3), audit + "R")


def parsed(rows):
    stacks, audit = turn_repair.Stacks(), ""
    for r in rows:
        stacks.read(*r)
        audit += stacks.settled()
    cost, rest = stacks.best()
    return cost, audit + rest


def test_stacks_find_the_least_of_all_repairs():
    rng = random.Random(1)
    for n in [0, 1, 2, 3] * 30:
        rows = [(rng.choice("suax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
        assert parsed(rows) == min(every_way(rows)) == cheapest(rows)
    for _ in range(200):
        rows = [(rng.choice("suuaax"), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(4, 60))]
        assert parsed(rows) == cheapest(rows)


def damaged(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv] += []
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return by


def repair(rows):
    rows, seen, faults = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())), set(), []
    for _, role, text in rows:
        kept = text.strip(" \t\n\x0b\x0c\r")
        faults.append((role[:1], 1 if not kept else 2 if (role, text) in seen else 3 if kept[-1] not in ".!?" else 0))
        seen.add((role, text))
    cost, audit = cheapest(faults)
    left, lines, expected = list(rows), [], 0
    for edit in audit:
        _, role, text = (0, "", "") if edit == "I" else left.pop(0)
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            lines.append((role, text))
            continue
        lines.append((role if edit == "K" else ("user", "assistant")[expected % 2], text))
        expected += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return (gaps, *[sum(f == k for _, f in faults) for k in (1, 2, 3)], pairs, cost, audit, digest), lines


def test_repair_matches_plain_python(spark, base, odd):
    for table in (spark.read.parquet(f"{base}/conversations.parquet"), odd):
        rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
        got = {r[0]: tuple(r)[1:] for r in turn_repair.report(table).collect()}
        assert got == {conv: repair(own)[0] for conv, own in damaged(rows).items()}


def test_repaired_turns_are_whole_conversations(odd):
    turns = defaultdict(list)
    for r in turn_repair.repaired(odd).orderBy("position").collect():
        turns[r.conv_id].append((r.role, r.text))
    rows = defaultdict(list)
    for r in odd.collect():
        rows[r.conv_id].append((r.turn, " " if r.role is None else r.role, " " if r.text is None else r.text))
    assert dict(turns) == {c: lines for c, own in rows.items() if (lines := repair(own)[1])}


def test_long_conversation_settles_its_edits_early():
    now, most = turn_repair.Conversation(), 0
    for k in range(20_000):
        now.read(k, "user" if k % 3 else "assistant", "x.", 0)
        most = max(most, len(now.waiting))
    now.end()
    assert most < 100 and len("".join(now.audit).replace("I", "")) == 20_000


def test_empty_tables(spark, odd):
    assert turn_repair.report(odd.limit(0)).count() == turn_repair.repaired(odd.limit(0)).count() == 0
    assert [r.conv_id for r in chat_format.report(odd.limit(0)).collect()] == [chat_format.CHECK_ID]
    assert chat_format.segments(odd.limit(0)).count() == 0


def test_formatted_conversations_are_read_back(spark, odd):
    by = defaultdict(list)
    for r in odd.collect():
        by[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    by[chat_format.CHECK_ID] = [(True, 0, "user", chat_format.CHECK_TEXT), (True, 1, "assistant", chat_format.CHECK_TEXT)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.conv_id: r for r in chat_format.report(odd).collect()}
    assert set(got) == set(by)
    for conv, rows in by.items():
        rows.sort()
        turns, loss = "".join(f"{r}\n{t}\n" for *_, r, t in rows), "".join(t for *_, r, t in rows if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(rows), sha(turns), len(loss), sha(loss))
    assert (got[1].faults, got[1].complete, got[4].faults, got[4].complete) == (3, False, 0, True)


def test_segments_add_up_to_the_formatted_text(spark, odd):
    whole = {r.conv_id: r.formatted for r in chat_format.formatted(odd).collect()}
    parts = defaultdict(list)
    for r in chat_format.segments(odd).collect():
        parts[r.conv_id].append(((r.turn is not None, r.turn or 0), r.role, r.part, r.text))
    assert {c: sorted(whole[c]) for c in whole} == {c: sorted("".join(t for *_, t in p)) for c, p in parts.items()}
    assert whole[4].count("<|turn|>") == whole[4].count("<|end|>") == len(MARKED)


@pytest.mark.parametrize("marks", [("<a>", "a", "<b>"), ("<a>", "<b\\>", "<c>"), ("<a", "a>", "<c>")])
def test_templates_that_could_be_forged_are_refused(marks):
    with pytest.raises(ValueError):
        chat_format.Template(*marks)
