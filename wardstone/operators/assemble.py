"""Putting one-row-per-key tables together, cohort rules and attrition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wardstone.functions import sqltext


# Bits of the array that stands for a set of keys: 8 MB.
MARKS = 1 << 26


def assemble(base: DataFrame, features: Sequence[DataFrame], key: str) -> DataFrame:
    """Left-join feature tables, each unique on ``key``, onto the base.

    The tables come out of aggregations on ``key`` and are partitioned by it already; only the base moves.
    """
    out = base
    for table in features:
        out = out.join(table, key, "left")
    return out


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: sqltext.column(f"coalesce({sqltext.name(c)}, 0)") for c in columns})


def likely_keys(df: DataFrame, keys: DataFrame, key: str, n: int) -> DataFrame:
    """Rows whose ``key`` may be one of the ``n`` ``keys``: all that are, and few others. An inner join with few keys then
    shuffles little. The keys' hashes are marked in an array of at most ``MARKS`` bits, which Spark computes once as a
    scalar subquery; more keys only let more other rows through."""
    bits = min(MARKS, max(1 << 10, 1 << (16 * n).bit_length()))
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    marks = keys.select(at.alias("at")).select(
        F.shiftright("at", 6).alias("word"), sqltext.column("shiftleft(1L, CAST(at & 63 AS INT))", "bit"))
    marks = marks.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    words = df.sparkSession.range(bits >> 6).withColumnRenamed("id", "word").join(marks, "word", "left").agg(
        F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("w"))
    words = words.select(F.col("w.bits").alias("w"))
    word = F.get(words.scalar(), F.shiftright(at, 6).cast("int"))
    return df.where(F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """Raise if a key comes twice; one aggregation that stops at the first offender."""
    if df.groupBy(key).count().where(F.col("count") > 1).limit(1).count():
        raise ValueError(f"{key} is not unique")
    return df


def cohort(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """Rows that pass all named steps."""
    for test in steps.values():
        df = df.where(test)
    return df


def attrition(df: DataFrame, steps: Mapping[str, Column], start: str = "all") -> DataFrame:
    """How many rows are left after each step, counted in one pass: (step_no, step, n, removed)."""
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("_0")]
    for number, test in enumerate(steps.values(), 1):
        passed = passed & F.coalesce(test, F.lit(False))
        counts.append(F.count_if(passed).alias(f"_{number}"))
    names = [start, *steps]
    entries = [
        F.struct(
            F.lit(i).alias("step_no"),
            F.lit(name).alias("step"),
            F.col(f"_{i}").alias("n"),
            (F.col(f"_{max(i - 1, 0)}") - F.col(f"_{i}")).alias("removed"),
        )
        for i, name in enumerate(names)
    ]
    return df.agg(*counts).select(F.inline(F.array(*entries)))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(tbl, n) for each named table."""
    out = None
    for name, df in tables.items():
        one = df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = one if out is None else out.unionByName(one)
    return out
