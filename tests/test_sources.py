import os
import time
import uuid

from pyspark.sql import functions as F

from wardstone.operators import profile
from wardstone.session import cut_lineage, forget
from wardstone.sources import load_tables, materialise, read_csv, read_optional, write_bucketed, write_csv


def test_csv_round_trip_with_and_without_schema(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", None), (2, 'q"x', 2.5)], "id int, s string, v double")
    write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "out"), df.schema).collect())) == sorted(map(tuple, df.collect()))
    assert dict(read_csv(spark, str(tmp_path / "out")).dtypes)["v"] == "double"


def test_optional_source(spark, tmp_path):
    assert read_optional(spark, str(tmp_path / "missing.csv")) is None


def test_logical_names(spark, base):
    out = load_tables(spark, base, ["visits", "nation"], physical={"visits": "orders.parquet"}, register=True)
    assert out["visits"].count() == spark.table("visits").count() and out["nation"].count() == 25


def test_materialised_tables_know_their_size(spark, tmp_path):
    out = materialise(spark.range(10), str(tmp_path / "t"), view="ten")
    assert spark.table("ten").count() == out.count() == 10


def test_bucketed_tables_aggregate_and_join_without_a_shuffle(spark, base):
    from tests.test_scale import plan_of

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = spark.read.parquet(f"{base}/lineitem.parquet").withColumnRenamed("l_orderkey", "o_orderkey")
        a = write_bucketed(lines, f"lines_{uuid.uuid4().hex}", "o_orderkey", 4)
        b = write_bucketed(spark.read.parquet(f"{base}/orders.parquet"), f"orders_{uuid.uuid4().hex}", "o_orderkey", 4)
        out = a.join(b, "o_orderkey").groupBy("o_orderkey").agg(F.sum("l_quantity").alias("q"))
        assert "Exchange" not in plan_of(out) and out.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_forgotten_tables_are_deleted_and_others_stay(spark, tmp_path):
    kept, gone = cut_lineage(spark.range(5)), cut_lineage(spark.range(7))
    folder = gone.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    spark.range(3).write.parquet(f"{tmp_path}/own")
    own = spark.read.parquet(f"{tmp_path}/own")
    out = cut_lineage(gone.join(kept, "id"))
    forget(gone, own, kept.where("id > 1"))
    forget(gone)
    assert not os.path.exists(folder)
    assert (kept.count(), own.count(), out.count()) == (5, 3, 5)


def test_shuffle_files_of_a_written_table_go_at_once(spark):
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {str(x) for x in (f.getName() for f in _java_list(folder.getAllFiles())) if str(x).startswith("shuffle_")}

    before = files()
    out = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    deadline = time.time() + 20
    while files() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - before and out.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def _java_list(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3)], "race_coded int, Ethnic int, age int")
    assert profile.find_columns(df, ["RACE", "ethnic"]) == ["race_coded", "Ethnic"]
    assert profile.columns_except(df, ["age"]) == ["race_coded", "Ethnic"]
    assert [tuple(r) for r in profile.first_columns(df, 2).collect()] == [(1, "race_coded"), (2, "Ethnic")]
