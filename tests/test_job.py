from catalogue import clinical
from catalogue.registry import Tables
from wardstone import job
from wardstone.plans import profiling, rulebook as rules


def test_three_stages(spark, tmp_path):
    tables = clinical.stored(Tables(spark, "/root/testdata/sf0.01"))
    raw = tmp_path / "raw"
    for name, df in tables.items():
        df.write.parquet(f"{raw}/{name}.parquet")
    job.main(["cohort", "--tables", str(raw), "--out", str(tmp_path / "built")])
    job.main(["cohort", "--tables", str(raw), "--out", str(tmp_path / "built"), "--name", "full", "--all-stays"])
    analytic = f"{tmp_path}/built/analytic"
    back = spark.read.option("header", True).csv(analytic)
    assert tuple(back.columns) == rules.COLUMNS and back.count() > 1000

    job.main(["profile", "--table", analytic, "--out", str(tmp_path / "profile")])
    flags = spark.read.option("header", True).csv(f"{tmp_path}/profile/flags").collect()
    assert {r.column_name: r.present for r in flags} == {"dementia_icd": "1", "outcome_incident_cam_24h": "1"}

    job.main([
        "study", "--table", analytic, "--second", f"{tmp_path}/built/full", "--out", str(tmp_path / "study"), "--revised",
        "--penalties", "0.05", "--rounds", "3", "--cv-rounds", "2", "--folds", "2", "--max-iter", "10", "--replicates", "50",
    ])
    for name in ("summary", "coefficients", "attribution", "subgroups", "missing_data", "second_cohort"):
        assert spark.read.option("header", True).csv(f"{tmp_path}/study/{name}").count() > 0


def test_report_without_race_or_dementia_columns(spark):
    df = spark.createDataFrame([(50, 1, 0)], "age int, dementia_flag int, x int")
    out = profiling.report(df)
    assert [r.column_name for r in out["demographic_columns"].collect()] == ["age"]
    assert [r.column_name for r in out["similar_columns"].collect()] == ["dementia_flag"]
