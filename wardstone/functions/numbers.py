"""Numeric column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def round_half_away(value: Column, digits: int) -> Column:
    """Round half away from zero on the decimal value, so that floating noise in the 11th digit cannot flip a tie."""
    return F.round(value.cast("decimal(30,10)"), digits).cast("double")


def safe_ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, NULL where ``bottom`` is zero."""
    return top / F.nullif(bottom, F.lit(0))


def round_columns(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Result tables as they are published: the named columns, where present, to so many digits."""
    return df.withColumns({c: round_half_away(F.col(c), n) for c, n in digits.items() if c in df.columns})
