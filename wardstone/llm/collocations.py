"""Phrase collocations: level-wise candidates, double-array tries and state vectors over all text positions.

Words of a language that are frequent get numbers, and the corpus is stored once as arrays of these numbers, with -1 at
rare words and ends of pieces (no frequent phrase holds a rare word). For 2, 3 and 4 words in turn:

1. windows whose two shorter windows are frequent phrases (Apriori) are counted by a hash into buckets, several to an
   expected window, so that a bucket's count is never below that of a phrase in it;
2. distinct windows in buckets of enough rows are the candidates;
3. candidates are dealt by a hash to shards of at most ``TRIE``; a task makes each shard a double-array trie over the bytes
   of word numbers, which is broadcast. A position's window belongs to one shard. A task advances the states of all
   positions of a stored array that belong to a shard at once, one level after the other, drops those that fell out and
   counts accepting states with ``bincount``; Spark sums the counts.

Every broadcast holds at most ``SHARD`` entries however large the corpus is: there are more of them, and a position looks
into one. Phrases, their cuts and the phrases inside longer ones are then matched by joins.

A null text is empty, a null lang is ``und``; texts may be as long as a Spark string. Other columns, whatever their names,
play no part. Repeated rows count as often as they occur; an empty table has no phrases. Words are looked up by a 64-bit
hash of their language and bytes; everything counted is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wardstone.llm.bytesops import BASE, LOWER, U, buffer_of, mix, word_bounds, word_hashes
from wardstone.session import cut_lineage, forget

SHARD = 1 << 18
TRIE = 1 << 15
BLOCK = 1 << 13
LONGEST = 4
STOPS = np.zeros(256, bool)
STOPS[list(b".,;:!?\n\x0b\x0c\r")] = True
WORD = ~STOPS
WORD[[9, 32]] = False


def slices(batches, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows with about ``most`` bytes of text, a longer text alone: whole texts, small arrays."""
    for batch in batches:
        _, at = buffer_of(batch.column("text"))
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def read_words(batch: pa.RecordBatch):
    """Words of a batch of (lang, text): hash with language, language number, start, end, whether a piece ends after
    it; and the bytes and languages."""
    data, at = buffer_of(batch.column("text"))
    data = LOWER[data]
    starts, stops, docs = word_bounds(data, at, WORD)
    langs = batch.column("lang").dictionary_encode()
    lang = langs.indices.to_numpy(zero_copy_only=False)[docs]
    names, from_ = buffer_of(langs.dictionary)
    salts = word_hashes(names, from_[:-1], from_[1:]) if len(names) else np.zeros(len(langs.dictionary), U)
    hashes = mix(word_hashes(data, starts, stops) ^ (salts[lang] * BASE))
    stopped = np.cumsum(STOPS[data], dtype=np.int32) if len(data) else np.zeros(0, int)
    last = np.ones(len(starts), bool)
    last[:-1] = (docs[1:] != docs[:-1]) | (stopped[starts[1:]] != stopped[stops[:-1] - 1])
    return hashes, lang, starts, stops, last, data, langs.dictionary


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, hash, n) of all words."""

    def count(batches):
        for batch in slices(batches):
            hashes, lang, starts, stops, _, data, langs = read_words(batch)
            found, first, n = np.unique(hashes, return_index=True, return_counts=True)
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist())]
            yield pa.RecordBatch.from_pydict({
                "lang": langs.take(pa.array(lang[first])), "word": pa.array(words, pa.binary()).cast(pa.string()),
                "hash": found.view(np.int64), "n": n,
            })

    return docs.mapInArrow(count, "lang string, word string, hash long, n long").groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))


def in_shards(df: DataFrame, rows: int, by: str) -> Iterator[pa.Table]:
    """The rows in parts of about ``SHARD`` at most, by a column of hashes; ``dealt`` says which part has a hash."""
    parts = -(-2 * rows // SHARD)
    for i in range(parts):
        yield df.where(f"pmod({by}, {parts}) = {i}").toArrow()


def dealt(hashes: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The numbers of the parts that have some of the hashes (int64), with their places."""
    if parts == 1:
        yield 0, np.arange(len(hashes))
    elif parts:
        part = (hashes % parts).astype(np.uint16 if parts <= 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        for i in np.flatnonzero(np.diff(edges)).tolist():
            yield i, order[edges[i] : edges[i + 1]]


def number_words(spark: SparkSession, words: DataFrame) -> DataFrame:
    """Adds ``id``, from 0 without gaps, to the frequent words: places in a shard follow the hash, shards each other."""
    shards = -(-2 * words.count() // SHARD)
    shard = F.pmod(F.xxhash64("hash"), F.lit(max(shards, 1))).cast("int")
    inside = words.withColumn("shard", shard).withColumn("at", F.row_number().over(Window.partitionBy("shard").orderBy("hash", "lang", "word")) - 1)
    sizes = {r.shard: r["count"] for r in inside.groupBy("shard").count().collect()}
    before = np.cumsum([0] + [sizes.get(i, 0) for i in range(max(shards, 1))]).tolist()
    return cut_lineage(inside.select("lang", "word", "hash", "n", (F.col("at") + F.element_at(F.array(*map(F.lit, before)), F.col("shard") + 1)).cast("int").alias("id")))


def stored(spark: SparkSession, docs: DataFrame, words: DataFrame) -> DataFrame:
    """(ids binary): numbers of the words of runs of texts as int32, -1 for rare words and ends of pieces."""
    tables = []
    for part in in_shards(words.select("hash", "id"), words.count(), "hash"):
        order = np.argsort(keys := part["hash"].to_numpy().view(U))
        tables.append(spark.sparkContext.broadcast((keys[order], part["id"].to_numpy()[order])))

    def number(batches):
        for batch in slices(batches):
            hashes, _, _, _, last, _, _ = read_words(batch)
            ids = np.full(len(hashes), -1, np.int32)
            for i, places in dealt(hashes.view(np.int64), len(tables)):
                keys, numbers = tables[i].value
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, hashes[places]), len(keys) - 1)
                    ids[places] = np.where(keys[at] == hashes[places], numbers[at], -1)
            out = np.full(2 * len(ids), -1, np.int32)
            out[::2] = ids
            wanted = np.ones(len(out), bool)
            wanted[1::2] = last
            out = out[wanted]
            gap = out < 0
            out = out[~(gap & np.append(gap[1:], True))]  # one -1 is as good as many
            yield pa.RecordBatch.from_pydict({"ids": pa.array([out.tobytes()], pa.large_binary())})

    return cut_lineage(docs.mapInArrow(number, "ids binary"))


def double_array(phrases: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and the accepting state of each phrase: row ``i`` of ``phrases`` (distinct rows of word numbers) is
    the path of its numbers' bytes, high bytes first. State ``s`` goes to ``base[s] + byte`` if ``check`` is ``s``
    there; 0 is the root."""
    m, k = phrases.shape
    symbols = (phrases[:, :, None] >> (8 * np.arange(digits - 1, -1, -1))) & 255
    symbols = symbols.reshape(m, k * digits)
    order = np.lexsort(symbols.T[::-1])
    symbols = symbols[order]
    size = symbols.size + 16_384

    def longer(base, check):
        return np.append(base, np.zeros(len(base), np.int32)), np.append(check, np.full(len(check), -1, np.int32))

    base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
    check[0] = 0
    at = np.zeros(m, np.int32)
    fresh = np.arange(m) == 0
    low = 1  # what is free below is left alone
    for d in range(k * digits):
        child = fresh.copy()
        child[1:] |= symbols[1:, d] != symbols[:-1, d]
        rows = np.flatnonzero(child)
        parents, labels = at[rows], symbols[rows, d]
        first = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        counts = np.diff(np.append(first, len(parents)))
        for i in first[counts > 1][np.argsort(-counts[counts > 1], kind="stable")].tolist():
            end = i + int(counts[np.searchsorted(first, i)])
            own, start = labels[i:end], low
            while True:
                if start + 8192 > len(check):
                    base, check = longer(base, check)
                free = start + np.flatnonzero(check[start : start + 4096] < 0)
                free = free[free >= own[0]]
                good = (check[(free - own[0])[:, None] + own] < 0).all(1)
                if good.any():
                    break
                start += 4096
            b = int(free[good.argmax()] - own[0])
            base[parents[i]] = b
            check[b + own] = parents[i]
            if start > low + 65_536:
                low = start - 65_536
        single = first[counts == 1]
        while (check < 0).sum() < len(single):
            base, check = longer(base, check)
        free = np.flatnonzero(check < 0)[: len(single)]
        base[parents[single]] = free - labels[single]
        check[free] = parents[single]
        at = (base[parents] + labels).astype(np.int32)[np.cumsum(child) - 1]
        fresh = child
    used = int(np.flatnonzero(check >= 0)[-1]) + 1
    accepting = np.empty(m, np.int32)
    accepting[order] = at
    return base[:used], check[:used], accepting


def whole_windows(ids: np.ndarray, k: int) -> np.ndarray:
    """Places where k frequent words follow each other."""
    if len(ids) < k:
        return np.zeros(0, np.int64)
    good = ids >= 0
    return np.flatnonzero(np.logical_and.reduce([good[j : len(ids) - k + 1 + j] for j in range(k)]))


def advanced(base, check, ids: np.ndarray, k: int, digits: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions, of all or of those given, whose k numbers are a path of the trie, and the states they end in."""
    at = whole_windows(ids, k) if at is None else at
    state = np.zeros(len(at), np.int32)
    for word in range(k):
        number = ids[at + word]
        for d in range(digits - 1, -1, -1):
            to = base[state] + ((number >> (8 * d)) & 255)
            live = (to >= 0) & (to < len(check))
            live[live] = check[to[live]] == state[live]
            at, state, number = at[live], to[live], number[live]
    return at, state


class Level:
    """Broadcast tries of the candidates of k words, one for each shard; ``keep`` marks those that are phrases."""

    def __init__(self, spark: SparkSession, found: DataFrame, k: int, digits: int):
        self.k, self.digits, self.tries, self.rows, self.good = k, digits, [], [], []
        parts = -(-2 * found.count() // TRIE)

        def mark(batches):
            for batch in batches:
                flat = batch.column("ids").flatten().to_numpy()
                hashes = buckets_of(flat, np.arange(0, len(flat), k), k, 63)
                yield pa.RecordBatch.from_arrays([pa.array(hashes % parts), batch.column("ids")], ["shard", "ids"])

        def trie(shard, rows):
            base, check, accepting = double_array(rows, digits)
            order = np.argsort(accepting)
            made = [x.astype(np.int32).tobytes() for x in (base, check, accepting[order], rows[order])]
            return pa.RecordBatch.from_pydict({"shard": [shard]} | {n: pa.array([x], pa.binary()) for n, x in zip(names, made)})

        def build(batches):
            now, rows = None, []
            for batch in batches:
                shards = batch.column("shard").to_numpy()
                of = batch.column("ids").flatten().to_numpy().reshape(-1, k)
                edges = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]])
                for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    if i < j and shards[i] != now:
                        if rows:
                            yield trie(now, np.concatenate(rows))
                        now, rows = int(shards[i]), []
                    rows.append(of[i:j])
            if now is not None:
                yield trie(now, np.concatenate(rows))

        names = ["base", "check", "accepting", "rows"]
        if parts:
            marked = found.mapInArrow(mark, "shard long, ids array<int>").repartition(parts, "shard").sortWithinPartitions("shard")
            built = cut_lineage(marked.mapInArrow(build, "shard long, base binary, check binary, accepting binary, rows binary"))
            for i in range(parts):  # one at a time: the driver holds a single trie
                one = built.where(F.col("shard") == i).toArrow()
                base, check, accepting, rows = (
                    np.frombuffer(one[n][0].as_py(), np.int32) if one.num_rows else np.full(n == "check", -1, np.int32) for n in names)
                if not one.num_rows:
                    base = np.zeros(1, np.int32)
                self.tries.append(spark.sparkContext.broadcast((base, check, accepting)))
                self.rows.append(spark.sparkContext.broadcast(rows.reshape(-1, k)))
            forget(built)

    def accepted(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Trie, positions whose windows it holds, and their places among its candidates."""
        at = whole_windows(ids, self.k)
        for i, own in dealt(buckets_of(ids, at, self.k, 63), len(self.tries)):
            base, check, accepting = self.tries[i].value
            if len(accepting):
                here, states = advanced(base, check, ids, self.k, self.digits, at[own])
                place = np.minimum(np.searchsorted(accepting, states), len(accepting) - 1)
                held = accepting[place] == states
                yield i, here[held], place[held]

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """Whether a phrase of the level begins at each place."""
        out = np.zeros(len(ids), bool)
        for i, at, place in self.accepted(ids):
            out[at[self.good[i].value[place]]] = True
        return out

    def counted(self, texts: DataFrame) -> DataFrame:
        """(shard, place, ids, n) of the candidates. A task gives its counts as arrays of ``BLOCK`` places, which are
        summed as they stream by, sorted by block."""
        level = self

        def count(batches):
            sums = [np.zeros(len(t.value[2]), np.int64) for t in level.tries]
            for batch in batches:
                for ids in arrays(batch):
                    for i, _, place in level.accepted(ids):
                        sums[i] += np.bincount(place, minlength=len(sums[i]))
            for i, n in enumerate(sums):
                for b in np.flatnonzero(np.logical_or.reduceat(n > 0, np.arange(0, len(n), BLOCK))).tolist() if len(n) else ():
                    b *= BLOCK
                    yield pa.RecordBatch.from_pydict({"shard": [i], "block": [b], "n": pa.array([n[b : b + BLOCK].tobytes()], pa.binary())})

        def add(batches):
            key, sums = None, None
            for batch in batches:
                for shard, block, n in zip(*(c.to_pylist() for c in batch.columns)):
                    n = np.frombuffer(n, np.int64)
                    if (shard, block) == key:
                        sums = sums + n
                        continue
                    if key:
                        yield whole(*key, sums)
                    key, sums = (shard, block), n
            if key:
                yield whole(*key, sums)

        def whole(shard, block, sums):
            rows = level.rows[shard].value[block : block + len(sums)]
            lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * level.k, pa.array(rows.ravel(), pa.int32()))
            place = np.arange(block, block + len(sums))
            return pa.RecordBatch.from_pydict({"shard": np.full(len(sums), shard), "place": place, "ids": lists, "n": sums})

        parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return (
            texts.mapInArrow(count, "shard long, block long, n binary")
            .repartition(parts, "shard", "block").sortWithinPartitions("shard", "block")
            .mapInArrow(add, "shard long, place long, ids array<int>, n long")
        )

    def keep(self, phrases: DataFrame):
        """Only the phrases of the table (shard, place) count from now on."""
        for i, rows in enumerate(self.rows):
            good = np.zeros(len(rows.value) + 1, bool)
            good[phrases.where(F.col("shard") == i).select("place").toArrow()["place"].to_numpy()] = True
            self.good.append(phrases.sparkSession.sparkContext.broadcast(good))
            rows.destroy()
        self.rows = []

    def close(self):
        for t in [*self.tries, *self.good]:
            t.destroy()


def arrays(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for x in batch.column("ids"):
        yield np.frombuffer(x.as_buffer(), np.int32)


def safe(ids: np.ndarray, k: int, level: Level | None) -> np.ndarray:
    """Places whose windows of k - 1 words, here and one word on, are both frequent."""
    if level is None:
        good = ids >= 0
    else:
        good = level.windows(ids)
    return np.flatnonzero(good[:-1] & good[1:]) if len(ids) >= k else np.zeros(0, np.int64)


def buckets_of(ids: np.ndarray, at: np.ndarray, k: int, bits: int) -> np.ndarray:
    out = np.zeros(len(at), U)
    for j in range(k):
        out = mix(out * BASE + ids[at + j].astype(U))
    return (out >> U(64 - bits)).view(np.int64)


def candidates(spark: SparkSession, texts: DataFrame, k: int, least: int, level: Level | None) -> DataFrame:
    """(ids array<int>): distinct windows of k words that pass the Apriori and the bucket test."""

    def places(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(ids) for ids in arrays(batch))])})

    total = texts.mapInArrow(places, "n long").agg(F.sum("n")).first()[0] or 1
    bits = min(63, int(total).bit_length() + 2)

    def count(batches):
        for batch in batches:
            for ids in arrays(batch):
                found, n = np.unique(buckets_of(ids, safe(ids, k, level), k, bits), return_counts=True)
                yield pa.RecordBatch.from_pydict({"bucket": found, "n": n})

    full = cut_lineage(texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("bucket"))
    wanted = [spark.sparkContext.broadcast(np.sort(p["bucket"].to_numpy())) for p in in_shards(full, full.count(), "bucket")]

    def collect(batches):
        for batch in batches:
            for ids in arrays(batch):
                at = safe(ids, k, level)
                bucket = buckets_of(ids, at, k, bits)
                live = np.zeros(len(at), bool)
                for i, own in dealt(bucket, len(wanted)):
                    full_ones = wanted[i].value
                    if len(full_ones):
                        place = np.minimum(np.searchsorted(full_ones, bucket[own]), len(full_ones) - 1)
                        live[own] = full_ones[place] == bucket[own]
                at = at[live]
                rows = np.unique(np.stack([ids[at + j] for j in range(k)], 1), axis=0) if len(at) else np.zeros((0, k), np.int32)
                flat = pa.array(rows.ravel(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * k, flat)], ["ids"])

    out = cut_lineage(texts.mapInArrow(collect, "ids array<int>").distinct())
    for w in wanted:
        w.destroy()
    return out


def phrase_counts(docs: DataFrame, least: int = 30, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, words array<string>, f) of all phrases of up to ``longest`` words with f >= least, and (lang, n)."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    every = cut_lineage(word_counts(docs))
    sizes = every.groupBy("lang").agg(F.sum("n").alias("n"))
    words = number_words(spark, every.where(F.col("n") >= least))
    texts = stored(spark, docs, words)
    digits = max(1, -(-max(words.count() - 1, 1).bit_length() // 8))
    found, level = [words.select(F.array("id").alias("ids"), "n")], None
    for k in range(2, longest + 1):
        level, shorter = Level(spark, candidates(spark, texts, k, least, level), k, digits), level
        phrases = cut_lineage(level.counted(texts).where(F.col("n") >= least))
        level.keep(phrases)
        found.append(phrases.select("ids", "n"))
        if shorter:
            shorter.close()
    if level:
        level.close()
    union = found[0]
    for f in found[1:]:
        union = union.union(f)
    key = F.struct("ids", "n").alias("key")
    spelled = (
        union.select(key, F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
        .groupBy("key").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
        .select("lang", F.col("w.word").alias("words"), F.col("key.n").alias("f"))
    )
    return cut_lineage(spelled), sizes


def collocations(docs: DataFrame, least: int = 30, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of each language by score."""
    counts, sizes = phrase_counts(docs, least)
    size = F.size("words")
    long = counts.where(size > 1).select("lang", "words", F.col("f").alias("a"))
    parts = counts.select("lang", F.col("words").alias("part"), "f")
    # Where a longer phrase holds this one often enough, so does the one of a single word more between them.
    inner = counts.where(size > 2).select("lang", "f", F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words"))
    within = inner.groupBy("lang", "words").agg(F.max("f").alias("held"))
    kept = long.join(within, ["lang", "words"], "left").where("held IS NULL OR 5 * held < 4 * a").drop("held")
    cut = kept.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    scored = (
        cut.withColumn("part", F.slice("words", F.lit(1), F.col("k"))).join(parts.withColumnRenamed("f", "l"), ["lang", "part"])
        .withColumn("part", F.slice("words", F.col("k") + 1, size - F.col("k"))).join(parts.withColumnRenamed("f", "r"), ["lang", "part"])
        .withColumn("score", F.expr("CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0)) div CAST(l + r AS DECIMAL(19, 0))"))
        .groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("least"))
        .select("lang", F.array_join("words", " ").alias("phrase"), "a", "least.l", "least.r", "least.score")
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    last = first.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return last.where(F.col("rank") <= top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def sql(least: int = 30, top: int = 2000) -> str:
    """Counts every window of every piece; no levels and no tries."""
    pieces = r"[.,;:!?\x0A-\x0D]"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = " UNION ALL ".join(
        f"SELECT lang, unnest([array_to_string(w[i : i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k} + 2)]) AS p FROM pieces WHERE len(w) >= {k}"
        for k in range(1, 5))
    return f"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lower}, '{pieces}')) AS piece FROM documents
), pieces AS (
  SELECT lang, [x FOR x IN string_split_regex(piece, '[ \\t]+') IF x <> ''] AS w FROM texts
), sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM ({grams}) GROUP BY lang, p HAVING count(*) >= {least}),
split AS MATERIALIZED (SELECT *, string_split(p, ' ') AS g FROM counts),
held AS (
  SELECT lang, p, max(f) AS most FROM (
    SELECT lang, f, unnest([array_to_string(g[i : i + k - 1], ' ') FOR i IN range(1, len(g) - k + 2)]) AS p
    FROM split, (VALUES (2), (3)) s(k) WHERE len(g) > k
  ) GROUP BY lang, p
), parts AS MATERIALIZED (
  SELECT lang, p, f AS a, k, array_to_string(g[1 : k], ' ') AS x, array_to_string(g[k + 1 : len(g)], ' ') AS y
  FROM split, (VALUES (1), (2), (3)) s(k) WHERE k < len(g)
), cuts AS (
  SELECT c.lang, c.p, c.a, c.k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score
  FROM parts c JOIN counts l ON l.lang = c.lang AND l.p = c.x JOIN counts r ON r.lang = c.lang AND r.p = c.y
  LEFT JOIN held h ON h.lang = c.lang AND h.p = c.p
  WHERE h.most IS NULL OR 100::HUGEINT * h.most < 80::HUGEINT * c.a
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (
  SELECT lang, p AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= {top}"""
