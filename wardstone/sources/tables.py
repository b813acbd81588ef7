"""Reading tables by logical name, and CSV files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def load_tables(
    spark: SparkSession,
    base: str,
    names: Sequence[str],
    *,
    physical: Mapping[str, str] | None = None,
    register: bool = False,
    fmt: str = "parquet",
) -> dict[str, DataFrame]:
    """Scan tables under ``base``. ``physical`` maps a logical name to a path below ``base`` or, with a ``table:``
    prefix, to a catalog table; the default path is ``<name>.<fmt>``. ``register`` also makes temp views."""
    out = {}
    for name in names:
        target = (physical or {}).get(name, f"{name}.{fmt}")
        if target.startswith("table:"):
            df = spark.table(target.removeprefix("table:"))
        else:
            df = spark.read.format(fmt).load(f"{base}/{target}")
        if register:
            df.createOrReplaceTempView(name)
        out[name] = df
    return out


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header. Give a schema where it is known: inferring one reads the file once more."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_optional(spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str = "csv") -> DataFrame | None:
    """The table at ``path``, or ``None`` where nothing is there; any other fault is raised."""
    try:
        return read_csv(spark, path, schema) if fmt == "csv" else spark.read.format(fmt).load(path)
    except AnalysisException as fault:
        if fault.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
