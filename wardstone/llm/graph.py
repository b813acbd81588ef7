"""Connected components of a link table, and a bounded filter for the documents a later step needs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone.session import cut_lineage, forget

BITS = 1 << 20


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of the nodes of ``links`` (a, b: long).

    Alternates large and small stars: every node moves its larger, then its smaller neighbours to the smallest node it
    knows. A node's neighbours are never gathered: the minimum is aggregated and joined back, and Spark splits the join
    of a node with very many neighbours. Every round is written to the shared folder; rounds grow with the logarithm of
    the longest chain."""
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(
            low.select("a", F.col("m").alias("b"))).distinct()
        last, edges = edges, cut_lineage(small)
        forget(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _bits(ids: np.ndarray) -> np.ndarray:
    from wardstone.llm.bytesops import mix

    return (mix(ids.astype(np.uint64)) % np.uint64(BITS)).astype(np.int32)


def bits_of(ids: DataFrame) -> np.ndarray:
    """A bitmap of ``BITS`` bits, however many ids (a column of longs) there are: a set bit may be one of them, an unset
    bit is none of them."""

    def bits(batches):
        for b in batches:
            got = np.unique(_bits(b.column(0).drop_null().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_pydict({"bit": pa.array(got, pa.int32())})

    out = np.zeros(BITS, bool)
    out[ids.mapInArrow(bits, "bit int").distinct().toArrow()["bit"].to_numpy()] = True
    return np.packbits(out)


def maybe(bitmap: np.ndarray, ids: pa.Array) -> pa.Array:
    """Whether each id may be in the bitmap; null ids are not."""
    at = _bits(ids.fill_null(0).to_numpy(zero_copy_only=False))
    set_ = (bitmap[at >> 3] >> (7 - (at & 7))) & 1
    return pa.array(set_.astype(bool) & ids.is_valid().to_numpy(zero_copy_only=False))
