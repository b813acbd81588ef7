"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary.

The merges are folded with Spark's higher-order functions over arrays of byte pieces of distinct words: the ranks are one
row of a table, an array of maps in which a piece is found by its hash (Spark looks keys up one after another, so one map
of 50,000 entries would be walked through for every pair). The row is joined to groups of words; as a literal it would be
copied into every plan, task and description of a plan on the driver. This encodes the ``COMMON`` words that are most
frequent in the whole corpus. Joining the ids of all distinct words back to all places of a corpus would shuffle every token; instead the
common words' ids are sent to the tasks (their number is a parameter, so the size is bounded) and rarer words are folded
by the same rule in the task that meets them. Both give the same ids for a word, so which words are common only matters
for speed. Decoding concatenates the pieces of the ids.

Null and empty texts give no ids. A text is encoded match by match, so its length does not matter; rows are encoded one
by one, repeated rows alike. Only doc_id and text are read, so further columns don't matter; in ``with_ids`` they are kept.
"""

from __future__ import annotations

import base64
import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstone.session import cut_lineage, forget

COMMON = 50_000
BUCKETS = 8192
GROUPS = 64
# At most so many rare words are remembered in a task.
REMEMBERED = 400_000


@lru_cache(4)
def read_ranks(path: str) -> tuple[tuple[bytes, int], ...]:
    """Pieces and ranks of a rank file: lines of base64 piece and rank."""
    with open(path, "rb") as f:
        return tuple((base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip()))


def rank_table(spark, ranks) -> DataFrame:
    """_ranks, array<map<hex piece, rank>>: one row in the shared folder; the bucket of a piece is its crc32."""
    import zlib

    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks:
        hexed = piece.hex().upper()
        buckets[zlib.crc32(hexed.encode()) % BUCKETS][hexed] = rank
    row = pa.array([[list(b.items()) for b in buckets]], pa.list_(pa.map_(pa.string(), pa.int32())))
    return cut_lineage(spark.createDataFrame(pa.table({"_ranks": row})))


def rank_of(table: Column, hexed: Column) -> Column:
    return F.get(table, F.pmod(F.crc32(hexed.cast("binary")), F.lit(BUCKETS)).cast("int"))[hexed]


def fold_merges(word: Column, table: Column) -> Column:
    """ids of a word: starting from single bytes, the adjacent pair of lowest rank is merged, leftmost first, until no
    pair has a rank. The accumulator is the array of pieces (hex) and is done when nothing changes any more."""
    hexed = F.hex(F.encode(word, "UTF-8"))
    n_bytes = (F.length(hexed) / 2).cast("int")
    start = F.transform(F.sequence(F.lit(0), n_bytes - 1), lambda i: F.substring(hexed, i * 2 + 1, F.lit(2)))

    def pair(pieces, i):
        return F.concat(F.get(pieces, i), F.get(pieces, i + 1))

    def merge(pieces, _):
        best = F.array_min(F.filter(
            F.transform(pieces, lambda p, i: F.struct(rank_of(table, pair(pieces, i)).alias("rank"), i.alias("i"))),
            lambda x: x["rank"].isNotNull()))
        # the struct is bound once, as a lambda variable, and used for every piece
        return F.when(F.size(pieces) < 2, pieces).otherwise(F.get(F.transform(F.array(best), lambda b: F.when(
            b.isNull(), pieces).otherwise(F.concat(
                F.slice(pieces, 1, b["i"]), F.array(pair(pieces, b["i"])),
                F.slice(pieces, b["i"] + 3, F.size(pieces))))), 0))

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(n_bytes - 1, F.lit(1))), start, merge)
    return F.transform(folded, lambda p: rank_of(table, p))


def common_words(docs: DataFrame, pattern: str, most: int, text: str = "text") -> DataFrame:
    """The most frequent matches of the pattern in all texts, at most ``most``: those above a count. The counts are
    written once; a histogram over sixteenths of powers of two, a few hundred rows, says where the cut lies, so that no
    task sends more than the words that are kept."""
    found = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit("(?U)" + pattern), F.lit(0))).alias("word"))
    counted = found.groupBy("word").count().where((F.col("word") != "") & (F.col("count") > 1))
    counted = cut_lineage(counted.withColumn("height", F.floor(16 * F.log2("count")).cast("int")))
    lowest, above = 2**31 - 1, 0
    for height, words in sorted(counted.groupBy("height").agg(F.count("*")).collect(), reverse=True):
        above += words
        if above > most:
            break
        lowest = height
    return counted.where(F.col("height") >= lowest).select("word")


def encode_words(words: DataFrame, table: DataFrame) -> DataFrame:
    """word, ids: the fold on every word, in ``GROUPS`` groups, so that the ranks are copied to a group and not to a word."""
    part = F.pmod(F.xxhash64("word"), F.lit(GROUPS)).alias("part")
    groups = words.groupBy(part).agg(F.collect_list("word").alias("words"))
    one = groups.crossJoin(F.broadcast(table))  # one row, of the vocabulary's size
    folded = F.transform("words", lambda w: F.struct(w.alias("word"), fold_merges(w, F.col("_ranks")).alias("ids")))
    return one.select(F.inline(folded))


class Words(dict):
    """Ids of words in a task: given ones, remembered ones, else the same fold."""

    def __init__(self, ranks: dict[bytes, int], known: dict[str, bytes]):
        super().__init__(known)
        self.ranks, self.known = ranks, known

    def __missing__(self, word: str) -> bytes:
        got = np.asarray(merged(word.encode(), self.ranks), "<u4").tobytes()
        if len(self) >= REMEMBERED + len(self.known):
            self.clear()
            self.update(self.known)
        if len(word) <= 64:
            self[word] = got
        return got


class Encoder:
    """Encodes and decodes the texts of a task."""

    def __init__(self, ranks, known: dict[str, bytes], pattern: str):
        import regex

        self.find, self.words = regex.compile(pattern).findall, Words(dict(ranks), known)
        self.pieces = {rank: piece for piece, rank in ranks}

    def text(self, text: str) -> np.ndarray:
        # looked up by the join itself: one Python call a rare word, none a common one
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.find(text))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The fold of one word. Pairs wait in a heap, so that a match of many thousand bytes costs n log n."""
    from heapq import heapify, heappop, heappush

    if word in ranks:
        return [ranks[word]]
    n = len(word)
    pieces: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[word[i : i + 2]], i, 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapify(heap)
    while heap:
        _, i, length = heappop(heap)
        j = after[i]
        if pieces[i] is None or j >= n or len(pieces[i]) + len(pieces[j]) != length:
            continue
        pieces[i] += pieces[j]
        pieces[j] = None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            pair = pieces[i] + pieces[after[i]]
            if pair in ranks:
                heappush(heap, (ranks[pair], i, len(pair)))
        if before[i] >= 0:
            pair = pieces[before[i]] + pieces[i]
            if pair in ranks:
                heappush(heap, (ranks[pair], before[i], len(pair)))
    return [ranks[p] for p in pieces if p is not None]


def known_words(docs: DataFrame, ranks, pattern: str, common: int = COMMON) -> dict[str, bytes]:
    """Ids of the common words, at most ``common`` of them."""
    table = rank_table(docs.sparkSession, ranks)
    rows = encode_words(common_words(docs, pattern, common), table).toArrow()
    forget(table)
    return {w: np.asarray(ids, "<u4").tobytes() for w, ids in zip(rows["word"].to_pylist(), rows["ids"].to_pylist())}


def with_ids(docs: DataFrame, rank_file: str, pattern: str, common: int = COMMON) -> DataFrame:
    """doc_id, ids (array of int) and the decoded bytes of every text."""
    return _coded(docs, rank_file, pattern, common, "ids array<int>, decoded binary", lambda ids, decoded: {
        "ids": pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.binary())})


def report(docs: DataFrame, rank_file: str, pattern: str, common: int = COMMON) -> DataFrame:
    """One row per document: number of ids and digests of the ids and of the decoded bytes."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _coded(docs, rank_file, pattern, common, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, decoded: {
        "n_tokens": pa.array([len(i) for i in ids], pa.int64()), "ids_sha256": pa.array([sha(i.tobytes()) for i in ids], pa.string()),
        "decoded_sha256": pa.array([sha(d) for d in decoded], pa.string())})


def _coded(docs, rank_file, pattern, common, columns, out) -> DataFrame:
    spark = docs.sparkSession
    ranks = read_ranks(rank_file)
    sent = spark.sparkContext.broadcast((ranks, known_words(docs, ranks, pattern, common), pattern))

    def code(batches):
        encoder = Encoder(*sent.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            for i in range(0, len(texts), 64):
                ids = [encoder.text(t or "") for t in texts[i : i + 64]]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": b.column("doc_id").slice(i, 64).cast(pa.int64())} | out(ids, list(map(encoder.decode, ids))))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(code, f"doc_id long, {columns}")
