"""Exact quantiles of many columns, with a plan whose size does not depend on how many there are.

Columns become long rows (column, value). Every order statistic that is asked for has an interval of values it must lie
in, at first the column's whole range. A round counts the values of each interval in equal bins, and the bin with the
wanted rank becomes the next interval, from its least to its greatest value. Once an interval holds few values, these are
counted one by one and ranked. Rows are never shuffled, only counts: bins, and at last the few values.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import DataFrame, Window, functions as F

from wardstone.functions import sqltext
from wardstone.functions.sqltext import number_or_null

SCHEMA = "feature string, prob double, value double"
FEW = 10_000
# Finite ends of bins where a value is infinite.
LARGEST = 1.7e308


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.5,), bins: int = 256, few: int = FEW
) -> DataFrame:
    """(feature, prob, value), linearly interpolated between order statistics; NULL and NaN are ignored.

    ``bins`` and ``few`` (values left to an interval that is ranked) change the number of rounds, not the result.
    """
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], SCHEMA)
    numbers = ", ".join(number_or_null(c) for c in columns)
    values = df.select(sqltext.column(f"posexplode(array({numbers}))").alias("c", "v")).where("v IS NOT NULL")
    sizes = {r.c: r for r in values.groupBy("c").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    at = {(c, p): p * (s.n - 1) for c, s in sizes.items() for p in probs}
    ranks = sorted({(c, rank(x)) for (c, _), x in at.items() for rank in (floor, ceil)})
    # (column, rank): least and greatest value of its interval, values below it, values in it.
    where = {(c, r): (sizes[c].low, sizes[c].high, 0, sizes[c].n) for c, r in ranks}
    found, turn = {}, 0
    while len(found) < len(where):
        found |= {k: low for k, (low, high, _, _) in where.items() if low == high}
        left = [(c, r, *x) for (c, r), x in where.items() if (c, r) not in found]
        if not left:
            break
        wide = [x for x in left if x[5] > few]
        picked = _binned(values, wide, bins, turn) if wide else _ranked(values, left)
        for r in picked.collect():
            where[r.c, r.rank] = (r.low, r.high, r.below, r.n)
        turn += 1
    rows = []
    for (c, p), x in at.items():
        a, b = found[c, floor(x)], found[c, ceil(x)]
        rows.append((columns[c], float(p), a if a == b else a + (b - a) * (x - floor(x))))
    return spark.createDataFrame(rows, SCHEMA)


def _inside(values: DataFrame, left: list[tuple]) -> DataFrame:
    """The values of each interval; there is one interval for each rank asked for, so that side is broadcast."""
    asked = values.sparkSession.createDataFrame(left, "c int, rank long, low double, high double, below long, held long")
    return values.join(F.broadcast(asked), "c").where("v BETWEEN low AND high")


def _chosen(counts: DataFrame, order: str) -> DataFrame:
    """Of the counted cells of each interval, the one that holds its rank."""
    upto = F.sum("n").over(Window.partitionBy("c", "rank").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("below", F.col("below") + upto - F.col("n"))
    return placed.where("below <= rank AND rank < below + n").select("c", "rank", "low", "high", "below", "n")


def _binned(values: DataFrame, left: list[tuple], bins: int, turn: int) -> DataFrame:
    """Equal bins of the values, in every other round of their logarithms: these part orders of magnitude at once, the
    former part neighbours."""
    scaled = lambda x: f"least(greatest({x}, {-LARGEST}D), {LARGEST}D)"
    if turn % 2:
        scaled = lambda x: f"signum({x}) * least(log1p(abs({x})), 1000D)"
    v, low, high = scaled("v"), scaled("low"), scaled("high")
    width = f"({high} - {low})"
    share = (
        f"CASE WHEN {width} = 0D THEN 0D WHEN {width} <= {LARGEST}D THEN ({v} - {low}) / {width} "
        f"ELSE ({v} / 2 - {low} / 2) / ({high} / 2 - {low} / 2) END"
    )
    cell = F.expr(f"CAST(least(floor({share} * {bins}), {bins - 1}) AS INT)")
    counts = _inside(values, left).groupBy("c", "rank", "below", cell.alias("bin")).agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    return _chosen(counts, "bin")


def _ranked(values: DataFrame, left: list[tuple]) -> DataFrame:
    counts = _inside(values, left).groupBy("c", "rank", "below", "v").agg(F.count("*").alias("n"))
    return _chosen(counts.withColumns({"low": F.col("v"), "high": F.col("v")}), "v")
