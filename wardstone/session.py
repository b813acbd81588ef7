"""Session settings and the place where a plan touches shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

# Tables that cut_lineage wrote, and where.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

# Spark deletes a query's shuffle files once the query has ended, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Runtime settings the operators count on. None of them is a size guess about the data:
# broadcasts are left to Spark, which only makes one for a side it measured below the threshold,
# and a hot join key is split at run time even when that costs one more (pre-aggregated) exchange.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # the JVM only interprets methods of more bytecode; many rules in one stage make such methods
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else made."""
    for name, setting in RUNTIME_SETTINGS.items():
        spark.conf.set(name, setting)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster in ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="wardstone-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; never an existing one."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def keep_checkpoints(spark: SparkSession) -> None:
    """Rounds of boosting cut their lineage in the shared folder; a chain of hundreds would not fit a task's stack."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(scratch_path(spark, "rounds"))


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """What queries made and run in here shuffle goes with their end: nothing else may read it."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: later jobs neither recompute it nor lose it with an
    executor, they read only the columns they use, and joins know its size. Vector columns keep their feature names. What
    the write shuffled goes with its end: nothing else reads it."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    with dropping_shuffles(spark):
        df.write.parquet(path)
    table = spark.read.parquet(path)
    _WRITTEN[table] = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` returned, once all that reads them is written itself: then no later job, and no
    task repeated after a lost executor, asks for them. Other DataFrames are left alone."""
    for table in tables:
        path = _WRITTEN.pop(table, None)
        if path:
            sc = table.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def local_session(cpus: str = "8", app: str = "wardstone") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
