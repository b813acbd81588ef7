"""Substring dedup of whole texts as bytes: what is covered by a string of ``WIDTH`` bytes that starts anywhere else goes.

The sorted order and the common prefixes are built column by column over many strings at once: from the last column to
the first, every round inserts one symbol in front of each string, sorts stably by it, and updates the common prefix of
neighbours. After a round, a string's window at that column is repeated if its common prefix with a neighbour reaches the
width. For whole texts there would be as many rounds as the longest text has bytes, each over all of the corpus's
suffixes, so the strings are cut first, by a rule that loses no match:

- Every window of ``WIDTH`` bytes is assigned its anchor, the ``GRAM`` bytes with the smallest hash inside (the leftmost).
  Equal windows have equal anchors at equal places, so only windows of one anchor, at one offset, need comparing: strings
  of at most ``2 * WIDTH`` bytes, aligned at the anchor, one column an offset.
- Anchors that occur once are done. Anchors whose whole surroundings occur twice are repeated as they are; of equal
  surroundings one string goes on.
- A string is cut into blocks of offsets; windows of one block have a common core, whose hash is the key strings are dealt
  by. So strings meet only if they agree in most of a window, and a frequent anchor is spread over many keys.

Shuffles carry hashes and places, 30 bytes for about 150 bytes of text, and the bytes of strings with a partner. Texts
are read again where needed, through a bitmap of fixed size, and never shuffled in full. Rows of a round that the method
keeps in sequential files are arrays of one chunk of keys here; what is between steps lies in the shared folder.

Texts are told apart by their SHA-256, so null, repeated or shared doc_ids do no harm; equal texts are each other's
repeats. Null counts as empty; texts shorter than the width lose nothing. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone.llm import bytesops as B
from wardstone.llm.graph import bits_of, maybe
from wardstone.session import cut_lineage

WIDTH, GRAM = 400, 100
SLIDE = WIDTH - GRAM  # an anchor starts at most so far behind its window's start
BLOCKS = 4
PIECE = 1 << 21
STRINGS = 4096
ANCHORS = "array<struct<anchor:long,around:long,at:long,before:int,more:int>>"


def sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """Minimum or maximum of every w consecutive entries."""
    n = len(x) - w + 1
    pad = -len(x) % w
    edge = np.full(pad, x[-1], x.dtype)
    blocks = np.concatenate([x, edge]).reshape(-1, w)
    left = op.accumulate(blocks, axis=1).ravel()
    right = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[:n], left[w - 1 : w - 1 + n])


def nearest(places: np.ndarray, values: np.ndarray, step: int, tie: bool, reach: int) -> np.ndarray:
    """Place of the nearest entry to one side with a smaller (or equal, if ``tie``) value, within ``reach``; else -1."""
    out = np.full(len(places), -1, np.int64)
    open_ = np.arange(len(places))
    for d in range(1, reach + 1):
        to = open_ + step * d
        inside = (to >= 0) & (to < len(places))
        open_, to = open_[inside], to[inside]
        near = np.abs(places[to] - places[open_]) <= reach
        open_, to = open_[near], to[near]
        if not len(open_):
            break
        hit = values[to] <= values[open_] if tie else values[to] < values[open_]
        out[open_[hit]] = places[to[hit]]
        open_ = open_[~hit]
    return out


def anchors_of(data: np.ndarray):
    """anchor hash, hash of the surroundings, place, bytes before it, and number of windows less one: every window of the
    text belongs to exactly one row."""
    n_windows = len(data) - WIDTH + 1
    parts = []
    for first in range(0, max(n_windows, 0), PIECE):
        piece = data[first : first + PIECE + WIDTH - 1]
        n = len(piece) - WIDTH + 1
        hashes = B.byte_window_hashes(piece, GRAM)[: n + SLIDE]
        least = sliding(hashes, SLIDE + 1, np.minimum)
        # a gram is some window's anchor if it is as small as the largest of the minima of its windows
        padded = np.concatenate([np.zeros(SLIDE, B.U), least, np.zeros(SLIDE, B.U)])
        at = np.flatnonzero(sliding(padded, SLIDE + 1, np.maximum) == hashes)
        h = hashes[at]
        before, after = nearest(at, h, -1, True, SLIDE), nearest(at, h, 1, False, SLIDE)
        lo = np.maximum(np.maximum(at - SLIDE, 0), before + 1)
        hi = np.minimum(np.minimum(at, n - 1), np.where(after < 0, len(piece), after - SLIDE - 1))
        own = lo <= hi
        at, h, lo, hi = at[own], h[own], lo[own], hi[own]
        sums = np.zeros(len(piece) + 1, B.U)
        np.cumsum(B._BYTES[piece] * B.powers(B.BASE, len(piece)), out=sums[1:])
        around = B.mix((sums[hi + WIDTH] - sums[lo]) * B.powers(B.BACK, len(piece))[lo])
        around = B.mix(around + (hi - lo).astype(B.U) * B.U(1 << 32) + (at - lo).astype(B.U))
        parts.append((h, around, at + first, at - lo, hi - lo))
    if not parts:
        return [np.zeros(0, B.U)] * 2 + [np.zeros(0, np.int64)] * 3
    return [np.concatenate(x) for x in zip(*parts)]


def _text_key(sha: bytes) -> tuple[int, int]:
    return int.from_bytes(sha[:8], "little", signed=True), int.from_bytes(sha[8:16], "little", signed=True)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, sha, t1, t2 (the text's key) and its anchors."""

    def read(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                texts = [(t or "").encode() for t in b.column("text").slice(i, 64).to_pylist()]
                shas = [hashlib.sha256(t).digest() for t in texts]
                found = [anchors_of(np.frombuffer(t, np.uint8)) for t in texts]
                flat = [np.concatenate(x) for x in zip(*found)]
                rows = pa.StructArray.from_arrays(
                    [pa.array(flat[0].view(np.int64)), pa.array(flat[1].view(np.int64)), pa.array(flat[2].astype(np.int64)),
                     pa.array(flat[3].astype(np.int32)), pa.array(flat[4].astype(np.int32))],
                    ["anchor", "around", "at", "before", "more"])
                edges = np.concatenate([[0], np.cumsum([len(x[0]) for x in found])]).astype(np.int32)
                keys = [_text_key(s) for s in shas]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id").slice(i, 64).cast(pa.int64()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                    "sha": pa.array([s.hex() for s in shas]), "t1": pa.array([k[0] for k in keys], pa.int64()),
                    "t2": pa.array([k[1] for k in keys], pa.int64()), "anchors": pa.ListArray.from_arrays(pa.array(edges), rows)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        read, f"doc_id long, n_bytes long, sha string, t1 long, t2 long, anchors {ANCHORS}")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """t1, t2, bytes of the texts ``wanted`` (t1, t2), and a few others that the bitmap lets through; a task sends a text
    once."""
    sent = docs.sparkSession.sparkContext.broadcast(bits_of(wanted.select("t1")))

    def read(batches):
        seen = set()
        for b in batches:
            for t in b.column("text").to_pylist():
                t = (t or "").encode()
                key = _text_key(hashlib.sha256(t).digest())
                if key not in seen and maybe(sent.value, pa.array([key[0]], pa.int64()))[0].as_py():
                    seen.add(key)
                    yield pa.RecordBatch.from_pydict({"t1": pa.array([key[0]]), "t2": pa.array([key[1]]), "bytes": pa.array([t], pa.binary())})

    return docs.select("text").mapInArrow(read, "t1 long, t2 long, bytes binary")


def column_rounds(strings: list[bytes], starts: np.ndarray, first: int, last: int, width: int = WIDTH) -> np.ndarray:
    """strings x columns: whether the window of ``width`` bytes at a column is also another string's there. ``starts``:
    the column of a string's first byte. Columns run from ``first`` to ``last`` + width - 1."""
    m, columns = len(strings), last - first + width
    symbols = np.zeros((columns, m), np.uint16)  # 0: outside the string
    for i, s in enumerate(strings):
        at = starts[i] - first
        symbols[at : at + len(s), i] = np.frombuffer(s, np.uint8).astype(np.uint16) + 1
    order, common = np.arange(m), np.zeros(m, np.int32)  # common[k]: of places k - 1 and k of the order
    out = np.zeros((m, last - first + 1), bool)
    for col in range(columns - 1, -1, -1):
        new = symbols[col, order]
        at = np.argsort(new, kind="stable")
        symbol = new[at]
        fresh = np.zeros(m, np.int32)
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] > 0)) + 1
        fresh[same] = 1 + least_between(common, at[same - 1] + 1, at[same])
        order, common = order[at], fresh
        if col <= last - first:
            long = common >= width
            out[order[long], col] = True
            out[order[np.flatnonzero(long) - 1], col] = True
    return out


def least_between(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of x[lo..hi], both included, for every pair."""
    if not len(lo):
        return np.zeros(0, x.dtype)
    span = hi - lo + 1
    out = np.empty(len(lo), x.dtype)
    table, size = x, 1
    level = np.frexp(span)[1] - 1
    for j in range(int(level.max()) + 1):
        now = np.flatnonzero(level == j)
        out[now] = np.minimum(table[lo[now]], table[hi[now] - size + 1])
        table = np.minimum(table[:-size], table[size:]) if len(table) > size else table
        size *= 2
    return out


def block_strings(reads: DataFrame, texts: DataFrame) -> DataFrame:
    """key, anchor, around, block, start, bytes: the strings, cut into blocks of offsets."""
    per = -(-(SLIDE + 1) // BLOCKS)
    asked = reads.groupBy("t1", "t2").agg(F.collect_list(F.struct("anchor", "around", "at", "before", "more")).alias("reads"))

    def cut(batches):
        for b in batches:
            rows = []
            for text, reads in zip(b.column("bytes").to_pylist(), b.column("reads").to_pylist()):
                for r in reads:
                    lo, hi = -r["before"], -r["before"] + r["more"]
                    for k in range(BLOCKS):
                        a, z = -SLIDE + k * per, min(-SLIDE + (k + 1) * per - 1, 0)
                        if max(lo, a) > min(hi, z):
                            continue
                        start, stop = max(lo, a), min(hi, z) + WIDTH
                        core = text[r["at"] + z : r["at"] + a + WIDTH]  # in every window of the block
                        key = hashlib.blake2b(core, digest_size=8, key=k.to_bytes(1, "little")).digest()
                        rows.append((int.from_bytes(key, "little", signed=True), r["anchor"], r["around"], k, start, text[r["at"] + start : r["at"] + stop]))
            for i in range(0, len(rows), 2048):
                cols = list(zip(*rows[i : i + 2048]))
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(cols[0], pa.int64()), "anchor": pa.array(cols[1], pa.int64()), "around": pa.array(cols[2], pa.int64()),
                    "block": pa.array(cols[3], pa.int32()), "start": pa.array(cols[4], pa.int32()), "bytes": pa.array(cols[5], pa.binary())})

    return asked.join(texts, ["t1", "t2"]).select("bytes", "reads").mapInArrow(
        cut, "key long, anchor long, around long, block int, start int, bytes binary")


def repeated_offsets(strings: DataFrame) -> DataFrame:
    """anchor, around, lo, hi: runs of window offsets that another string shares."""

    def rounds(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            key = t.column("key").to_numpy()
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            if t.num_rows < STRINGS or not len(cut):
                rest = t
                continue
            yield from solve(t.slice(0, cut[-1]))
            rest = t.slice(cut[-1])
        if rest is not None and rest.num_rows:
            yield from solve(rest)

    def solve(t):
        key = t.column("key").to_numpy()
        edges = np.concatenate([[True], key[1:] != key[:-1]])
        size = np.bincount(np.cumsum(edges) - 1)[np.cumsum(edges) - 1]
        t = t.filter(pa.array(size > 1))  # alone with its core: not repeated
        if not t.num_rows:
            return
        anchor, around, block, start = (t.column(c).to_numpy() for c in ("anchor", "around", "block", "start"))
        strings = t.column("bytes").to_pylist()
        per = -(-(SLIDE + 1) // BLOCKS)
        for k in np.unique(block):
            of = np.flatnonzero(block == k)
            first, last = -SLIDE + int(k) * per, min(-SLIDE + (int(k) + 1) * per - 1, 0)
            hit = column_rounds([strings[i] for i in of], start[of], first, last)
            edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            i, lo = np.nonzero(edge == 1)
            _, hi = np.nonzero(edge == -1)
            yield pa.RecordBatch.from_pydict({
                "anchor": pa.array(anchor[of][i]), "around": pa.array(around[of][i]),
                "lo": pa.array((lo + first).astype(np.int32)), "hi": pa.array((hi - 1 + first).astype(np.int32))})

    return strings.repartition("key").sortWithinPartitions("key").mapInArrow(rounds, "anchor long, around long, lo int, hi int")


def removed_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scanned documents, and t1, t2, starts, stops of the bytes that go for texts that lose any."""
    scanned = cut_lineage(scan(docs))
    placed = scanned.select("t1", "t2", F.explode("anchors").alias("a")).select("t1", "t2", "a.*")
    more = placed.groupBy("anchor").agg(
        F.count("*").alias("n"), (F.min("around") != F.max("around")).alias("mixed")).where("n > 1").drop("n")
    hits = cut_lineage(placed.join(more, "anchor"))
    kinds = hits.groupBy("anchor", "around").agg(
        F.count("*").alias("n"), F.first("mixed").alias("mixed"), F.min(F.struct("t1", "t2", "at", "before", "more")).alias("one"))
    kinds = cut_lineage(kinds.select("anchor", "around", "n", "mixed", "one.*"))
    reads = kinds.where("mixed")
    strings = block_strings(reads, texts_of(docs, reads.select("t1").distinct()))
    whole = kinds.where("n > 1").select("anchor", "around", (-F.col("before")).alias("lo"), (F.col("more") - F.col("before")).alias("hi"))
    runs = whole.union(repeated_offsets(strings).join(kinds.where("n > 1"), ["anchor", "around"], "left_anti"))
    gone = hits.join(runs, ["anchor", "around"]).select(
        "t1", "t2", (F.col("at") + F.col("lo")).alias("start"), (F.col("at") + F.col("hi") + WIDTH).alias("stop")).distinct()
    spans = gone.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    return scanned, cut_lineage(spans)


def merge(spans) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans."""
    out: list[list[int]] = []
    for a, z in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(x) for x in out]


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """t1, t2, kept (bytes), n_removed, n_spans of the texts in ``spans``."""

    def strip(batches):
        for b in batches:
            for t1, t2, text, spans in zip(*(b.column(c).to_pylist() for c in ("t1", "t2", "bytes", "spans"))):
                runs, last, kept = merge((s["start"], s["stop"]) for s in spans), 0, []
                for a, z in runs:
                    kept.append(text[last:a])
                    last = z
                kept = b"".join(kept) + text[last:]
                yield pa.RecordBatch.from_pydict({
                    "t1": pa.array([t1]), "t2": pa.array([t2]), "kept": pa.array([kept], pa.binary()),
                    "n_removed": pa.array([len(text) - len(kept)]), "n_spans": pa.array([len(runs)])})

    texts = texts_of(docs, spans.select("t1").distinct())
    return texts.join(spans, ["t1", "t2"]).dropDuplicates(["t1", "t2"]).select("t1", "t2", "bytes", "spans").mapInArrow(
        strip, "t1 long, t2 long, kept binary, n_removed long, n_spans long")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: bytes, removed bytes, removed runs and the digest of the rest."""
    scanned, spans = removed_spans(docs.select("doc_id", "text"))
    less = without_spans(docs, spans).select("t1", "t2", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha"))
    return scanned.select("doc_id", "n_bytes", "sha", "t1", "t2").join(less, ["t1", "t2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))
