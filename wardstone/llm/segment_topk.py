"""Exact top-k by inner product with bounds from segment means and deviations.

Components become floor(scale * x) as integers. Of each vector, means and deviations over 1, 4 and 16 segments are kept.
In a segment of L components, q.x <= L * (mean_q * mean_x + dev_q * dev_x); added up over segments this bounds the
product from above (the squared distance from below), and the more segments, the closer. Coarse to fine, candidates whose
bound is below the k-th best product known so far go; what is left is computed exactly.

Queries are packed into blocks and meet the candidates block by block: each chunk of candidates is sent once for every
block of queries, never row by row. A block keeps its k best of each chunk; these few rows are merged by query. A task
holds one block of queries and one batch of candidates, whatever the size of the table.

Vectors that are null, empty or hold a null or non-finite component take no part; repeated ids are separate candidates,
except a query's own id, which is never one. Shorter vectors count as padded with zeros. Fewer than k candidates: all.
Scores are exact integers at every size: sums that doubles hold exactly go through matrix products, larger ones through
64-bit integers and, where these could overflow, through Python's. Scaled components are held within 2**62 either way and
scores within a long, beyond which neither has a number; where scores are held, no candidate is left out by its bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = (1, 4, 16)
BLOCK = 512
CHUNK = 4096
SCALE = 256
PACKED = "block int, ids binary, dims int, data binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    held = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine)
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(
        x.cast("double") * F.lit(float(scale)), F.lit(-float(2**62))), F.lit(float(2**62)))))
    return held.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """Rows of up to ``size`` vectors of one block, packed where they are; the rows of a block come one after another."""

    def pack(batches):
        def out(block, ids, vs):
            dims = max(map(len, vs))
            m = np.zeros((len(vs), dims), "<i8")
            for i, v in enumerate(vs):
                m[i, : len(v)] = v
            return pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int32()), "ids": pa.array([np.asarray(ids, "<i8").tobytes()], pa.binary()),
                "dims": pa.array([dims], pa.int32()), "data": pa.array([m.tobytes()], pa.binary())})

        now, ids, vs = None, [], []
        for batch in batches:
            for block, i, v in zip(*(batch.column(c).to_pylist() for c in ("block", "id", "v"))):
                if ids and (block != now or len(ids) == size):
                    yield out(now, ids, vs)
                    ids, vs = [], []
                now = block
                ids.append(i)
                vs.append(v)
        if ids:
            yield out(now, ids, vs)

    return rows.mapInArrow(pack, PACKED)


def _unpack(ids, dims, data, width):
    m = np.frombuffer(data, "<i8").reshape(-1, dims)
    return np.frombuffer(ids, "<i8"), np.pad(m, ((0, 0), (0, width - dims)))


def exact_kind(q: np.ndarray, c: np.ndarray):
    """The type in which every sum of products of these integers is exact."""
    most = q.shape[1] * int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0))
    return np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


def statistics(m: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row and segment, sqrt(L) * mean and sqrt(L) * deviation, so that bounds are plain inner products."""
    edges = np.linspace(0, m.shape[1], segments + 1).astype(int)
    parts = [m[:, a:b] for a, b in zip(edges, edges[1:]) if b > a]
    mean = np.stack([p.mean(1) * np.sqrt(p.shape[1]) for p in parts], 1)
    dev = np.stack([np.sqrt(np.maximum(0.0, ((p - p.mean(1, keepdims=True)) ** 2).sum(1))) for p in parts], 1)
    return mean, dev


def best_of_chunk(q_ids, q, c_ids, c, k):
    """query position, candidate id, score: per query its k best of the chunk, ties to smaller ids."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    kind = exact_kind(q, c)
    whole_q, whole_c = q.astype(kind), c.astype(kind)
    q, c = q.astype(np.float64), c.astype(np.float64)
    # what rounding may take from a bound or add to the first guess, by Cauchy's inequality
    lost = 1e-9 * np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]
    # k + 1 leave room for the query itself; a first guess: exact products with the candidates of largest coarse bound
    stats = {n: (statistics(q, n), statistics(c, n)) for n in LEVELS}
    (qm, qd), (cm, cd) = stats[LEVELS[-1]]
    some = np.argsort(-(np.linalg.norm(cm, axis=1) + np.linalg.norm(cd, axis=1)), kind="stable")[: 8 * (k + 1)]
    first = q @ c[some].T
    first[q_ids[:, None] == c_ids[some][None, :]] = -np.inf
    floor = -np.sort(-first, axis=1)[:, k - 1] if first.shape[1] >= k else np.full(len(q), -np.inf)
    alive = np.ones((len(q), len(c)), bool)
    for n in LEVELS if kind is not object else ():
        rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(rows) or not len(cols):
            break
        (qm, qd), (cm, cd) = stats[n]
        bound = qm[rows] @ cm[cols].T + qd[rows] @ cd[cols].T
        slack = 1e-6 * (1 + np.abs(bound)) + lost[np.ix_(rows, cols)]
        alive[np.ix_(rows, cols)] &= bound + slack >= floor[rows, None]
    for i in range(len(q)):
        cols = np.flatnonzero(alive[i])
        cols = cols[c_ids[cols] != q_ids[i]]
        scores = whole_c[cols] @ whole_q[i]
        if kind is object:
            scores = [max(-(2**63) + 1, min(2**63 - 1, int(s))) for s in scores]
            top = sorted(range(len(cols)), key=lambda j: (-scores[j], c_ids[cols[j]]))[:k]
        else:
            top = np.lexsort((c_ids[cols], -scores))[:k]
        for j in top:
            yield i, int(c_ids[cols[j]]), int(scores[j])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = SCALE, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score of the rows whose id is divisible by ``every``, against all others."""
    rows = usable(vectors, id_col, vector_col, scale)
    asked = rows.where(F.col("id") % every == 0).distinct()
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    queries = _pack(asked.repartition("block").sortWithinPartitions("block"), block).select(
        "block", F.col("ids").alias("q_ids"), F.col("dims").alias("q_dims"), F.col("data").alias("q_data"))
    parts = _pack(rows.withColumn("block", F.lit(0)), chunk).drop("block")
    # Blocks of a stated query set against chunks of all rows. Chunks fall into groups, so that there are as many keys
    # (block, group) as tasks, however few blocks there are.
    groups = -(-int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)
    group = F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    pairs = parts.select("*", group.alias("group"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).join(
        queries.withColumn("group", every_group), ["block", "group"]).select(*parts.columns, *queries.columns[1:])

    def search(batches):
        for b in batches:
            for ids, dims, data, q_ids, q_dims, q_data in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                width = max(dims, q_dims)
                c_ids, c = _unpack(ids, dims, data, width)
                qs, q = _unpack(q_ids, q_dims, q_data, width)
                found = list(best_of_chunk(qs, q, c_ids, c, k))
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array([int(qs[i]) for i, _, _ in found], pa.int64()),
                    "at": pa.array([i for i, _, _ in found], pa.int32()),
                    "vec_id": pa.array([c for _, c, _ in found], pa.int64()),
                    "score": pa.array([s for _, _, s in found], pa.int64())})

    found = pairs.mapInArrow(search, "query_id long, at int, vec_id long, score long")
    # (-score, id) ascending: at most k rows from each chunk meet here
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(
        F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    out = best.select("query_id", F.posexplode("best").alias("p", "b"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"),
                      (-F.col("b.s")).alias("score"))


def sql(k: int = 5, every: int = 50, source: str = "embeddings") -> str:
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM {source} WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= {k}"""
