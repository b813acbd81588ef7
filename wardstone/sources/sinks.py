"""Writing result tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header in every part file, written by all tasks."""
    df.write.mode(mode).option("header", True).csv(path)


def write_results(results: Mapping[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One folder per named result table."""
    for name, df in results.items():
        if fmt == "csv":
            write_csv(df, f"{folder}/{name}", mode)
        else:
            df.write.mode(mode).format(fmt).save(f"{folder}/{name}")


def materialise(df: DataFrame, path: str, view: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """Write an intermediate table once and read it back, with exact size statistics for later joins."""
    df.write.mode(mode).parquet(path)
    out = df.sparkSession.read.parquet(path)
    if view:
        out.createOrReplaceTempView(view)
    return out


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, sort: tuple[str, ...] = ()) -> DataFrame:
    """Store events bucketed by their entity: joins and aggregations on ``key`` then read them without a shuffle."""
    df.write.mode("errorifexists").bucketBy(buckets, key).sortBy(key, *sort).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


