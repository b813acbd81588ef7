"""Looking at a table: shape, columns, frequencies, missing values, item reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wardstone.functions import sqltext
from wardstone.functions.sqltext import literal, name


def shape(df: DataFrame) -> DataFrame:
    return df.groupBy().agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def find_columns(df: DataFrame, parts: Sequence[str]) -> list[str]:
    """Columns whose name holds one of the parts, whatever the case."""
    return [c for c in df.columns if any(p.lower() in c.lower() for p in parts)]


def columns_except(df: DataFrame, excluded: Sequence[str]) -> list[str]:
    out = set(excluded)
    return [c for c in df.columns if c not in out]


def first_columns(df: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` column names with their position."""
    return df.sparkSession.createDataFrame(
        [(i, c) for i, c in enumerate(df.columns[:n], 1)], "position int, column_name string"
    )


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, n) for each value of each column, NULLs left out; one scan, combined map-side."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.inline(pairs)).where(F.col("value").isNotNull())
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def flag_totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, present, total, percent) for each wanted flag column; absent ones get NULL totals."""
    present = [c for c in columns if c in df.columns]
    sums = [F.sum(F.col(c).cast("double")).alias(f"_s{i}") for i, c in enumerate(present)]
    means = [F.avg(F.col(c).cast("double")).alias(f"_m{i}") for i, c in enumerate(present)]
    entries = []
    for c in columns:
        i = present.index(c) if c in present else None
        entries.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(int(i is not None)).alias("present"),
                (F.lit(None).cast("double") if i is None else F.col(f"_s{i}")).alias("total"),
                (F.lit(None).cast("double") if i is None else F.col(f"_m{i}") * 100).alias("percent"),
            )
        )
    return df.agg(F.count(F.lit(1)).alias("_n"), *sums, *means).select(F.inline(F.array(*entries)))


def null_audit(df: DataFrame, columns: Sequence[str], digits: int | None = 1) -> DataFrame:
    """(feature, n_missing, pct_missing) of the columns that miss values, NaN included; one aggregation over one scan."""
    broken = {c for c, kind in df.dtypes if kind in ("double", "float")}
    missing = {c: f"{name(c)} IS NULL" + f" OR isnan({name(c)})" * (c in broken) for c in columns}
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[sqltext.column(f"count_if({missing[c]})", f"_{i}") for i, c in enumerate(columns)],
    )
    entries = ", ".join(f"struct({literal(c)} AS feature, _{i} AS n_missing, _n)" for i, c in enumerate(columns))
    share = F.col("n_missing") / F.col("_n") * 100
    return (
        counts.select(sqltext.column(f"inline(array({entries}))"))
        .where(F.col("n_missing") > 0)
        .select("feature", "n_missing", (share if digits is None else F.round(share, digits)).alias("pct_missing"))
        .orderBy(F.col("pct_missing").desc(), "feature")
    )


def too_sparse(df: DataFrame, columns: Sequence[str], limit_percent: float) -> list[str]:
    """Columns missing in more than ``limit_percent`` of the rows (names only, bounded by the schema)."""
    audit = null_audit(df, columns, digits=None).where(F.col("pct_missing") > limit_percent)
    return [r.feature for r in audit.select("feature").collect()]


def class_ratio(df: DataFrame, label: str) -> DataFrame:
    """Negatives, positives and negatives per positive."""
    return df.agg(
        F.count_if(F.col(label) == 0).alias("n_negative"), F.count_if(F.col(label) == 1).alias("n_positive")
    ).withColumn("ratio", F.col("n_negative") / F.nullif(F.col("n_positive"), F.lit(0)))


def item_report(
    events: DataFrame, dictionary: DataFrame, *, item: str, label: str, pattern: str, where: Column | None = None, k: int = 10
) -> DataFrame:
    """The ``k`` most frequent items whose label matches ``pattern`` regardless of case: (item, label, n).

    Rows are counted per item before the dictionary is joined, so the join sees one row per item.
    """
    named = dictionary.where(F.col(label).ilike(pattern)).select(item, label)
    rows = events if where is None else events.where(where)
    counts = rows.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.join(named, item)
        .groupBy(item, label).agg(F.sum("n").alias("n"))
        .orderBy(F.col("n").desc(), F.col(item).asc()).limit(k)
    )


def items_listed(dictionary: DataFrame, *, item: str, label: str, items: Sequence = (), patterns: Sequence[str] = ()) -> DataFrame:
    """Dictionary entries by id or by label pattern."""
    test = F.lit(False)
    if items:
        test = test | F.col(item).isin(*items)
    for pattern in patterns:
        test = test | F.col(label).ilike(pattern)
    return dictionary.where(test).select(item, label)
