"""Exact running totals and ranks along an order, without giving one task a whole group.

A window over a hot key, or over no key at all, sorts that whole group in one task. Here every row also gets a
*bucket* that never decreases along the order. Running totals are taken inside (key, bucket), the totals of the earlier
buckets of the key are added from a table with one row per (key, bucket), which is aggregated map-side. The bucket has
to be a pure function of the row, so that a recomputed task puts every row back where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardstone.functions.sqltext import name

BUCKET = "_bucket"
CELL = "_cell"
GROUP = "_group"
PER_PART = 250_000


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    values: Sequence[str],
    bucket: Column,
    descending: bool = False,
    coarse: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add ``<v>_upto`` (sum of ``v`` up to and with this row) and ``<v>_all`` (sum over the key) for each value.

    ``order`` must be unique within the key. ``descending`` says that the buckets run down along ``order``. Where a key
    may have more buckets than a task should order, ``coarse`` makes groups of a bucket, which never decrease as it
    grows: the groups' totals are ordered by one task a key, those of buckets by one task a group.
    NULL is a key like any other.
    """
    # One struct of key and bucket is the partitioning of the window and of the join, so rows move once; unlike its
    # fields it is never NULL, and structs with NULL fields are equal.
    keys = list(keys)
    placed = df.withColumn(BUCKET, bucket).withColumn(CELL, F.struct(*keys, BUCKET))

    totals = placed.groupBy(CELL).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    key = [F.col(f"{CELL}.{k}") for k in keys]
    place = F.col(f"{CELL}.{BUCKET}")
    offsets = _offsets(totals, key, place, values, descending, coarse)

    inside = Window.partitionBy(CELL).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(v).over(inside).alias(f"_in_{v}") for v in values])
    return local.join(offsets, CELL).select(
        *df.columns,
        *[(F.col(f"_in_{v}") + F.col(f"_before_{v}")).alias(f"{v}_upto") for v in values],
        *[f"{v}_all" for v in values],
    )


def _offsets(
    totals: DataFrame, key: Sequence[Column], place: Column, values: Sequence[str], descending: bool,
    coarse: Callable[[Column], Column] | None,
) -> DataFrame:
    """Per cell what the key's earlier buckets hold, and what it holds in all."""

    def sums(df: DataFrame, by: Sequence[Column], at: Column, before: str, whole: str) -> DataFrame:
        earlier = Window.partitionBy(*by).orderBy(at.desc() if descending else at.asc())
        earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
        return df.select(
            *[c for c in df.columns if not c.startswith("_t_")],
            *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(before.format(v)) for v in values],
            *[F.sum(f"_t_{v}").over(Window.partitionBy(*by)).alias(whole.format(v)) for v in values],
        )

    if coarse is None:
        return sums(totals, key, place, "_before_{}", "{}_all")
    fields = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(key)], coarse(place).alias("at"))
    totals = totals.withColumn(GROUP, fields)
    keys_of = [F.col(f"{GROUP}.k{i}") for i in range(len(key))]
    groups = totals.groupBy(GROUP).agg(*[F.sum(f"_t_{v}").alias(f"_t_{v}") for v in values])
    groups = sums(groups, keys_of, F.col(f"{GROUP}.at"), "_earlier_{}", "{}_all")
    inside = sums(totals, [F.col(GROUP)], place, "_inside_{}", "_group_{}")
    return inside.join(groups, GROUP).select(
        CELL, *[(F.col(f"_inside_{v}") + F.col(f"_earlier_{v}")).alias(f"_before_{v}") for v in values],
        *[f"{v}_all" for v in values])


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, rank: str = "rank", size: str = "size",
    coarse: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Row numbers within the key along ``order``, and the size of the key."""
    out = running_totals(df.withColumn("_one", F.lit(1).cast("long")), keys, order, ["_one"], bucket, coarse=coarse)
    return out.select(*df.columns, F.col("_one_upto").alias(rank), F.col("_one_all").alias(size))


def heavy_keys(df: DataFrame, key: str, per_part: int = PER_PART) -> list:
    """Values of ``key`` that hold more than ``per_part`` rows and more than a thousandth of all, the null among them.

    One pass with a frequent-items sketch of fixed size, no shuffle of rows. It counts a key too high by less than a
    three-thousandth of the rows and never too low, so no heavy key is missed; a lighter one may be named, which only
    means that it is split too.
    """
    found = df.agg(F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("nulls"), F.expr(f"approx_top_k({name(key)}, 1000, 4096)").alias("top")).first()
    most = max(per_part, found.n / 1000)
    return [r["item"] for r in found.top or [] if r["item"] is not None and r["count"] > most] + [None] * (found.nulls > most)


def ranked_by_weight(
    df: DataFrame, key: str, order: Sequence[Column], bucket: Column, rank: str = "rank", size: str = "size", per_part: int = PER_PART
) -> DataFrame:
    """``ranked`` by one key where only heavy keys are split: all others share one window, so their rows move once and
    nothing is joined."""
    heavy = heavy_keys(df, key, per_part)
    whole = Window.partitionBy(key)
    numbers = {rank: F.row_number().over(whole.orderBy(*order)).cast("long"), size: F.count(F.lit(1)).over(whole)}
    if not heavy:
        return df.withColumns(numbers)
    named = [k for k in heavy if k is not None]
    is_heavy = F.when(F.col(key).isNull(), F.lit(None in heavy)).otherwise(F.col(key).isin(named) if named else F.lit(False))
    return df.where(~is_heavy).withColumns(numbers).union(ranked(df.where(is_heavy), [key], order, bucket, rank, size))


def split_points(df: DataFrame, column: str, per_part: int = PER_PART, unique: bool = False) -> list[float]:
    """Values that cut the distinct values of ``column`` into shares of about ``per_part``.

    Counts first, then takes one quantile per ``per_part`` values: that many come back to the driver. ``unique`` says
    that no value occurs twice.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    values = values if unique else values.distinct()
    parts = -(-values.count() // per_part)
    if parts < 2:
        return []
    grid = ", ".join(f"{i / parts}D" for i in range(1, parts))
    return sorted(set(values.agg(F.expr(f"percentile_approx(v, array({grid}), {max(10_000, 10 * parts)})")).first()[0]))


def bucket_by_points(df: DataFrame, column: str, points: Sequence[float], name: str = BUCKET) -> DataFrame:
    """Number the interval between the split points that ``column`` falls into, from low to high."""
    if not points:
        return df.withColumn(name, F.lit(0.0))
    splits = [float("-inf"), *points, float("inf")]
    return Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="keep").transform(df)
