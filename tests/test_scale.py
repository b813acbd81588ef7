"""Hot keys, interval edges and plan shapes."""

import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import Window, functions as F

from catalogue import all_queries, clinical
from catalogue.registry import Tables
from wardstone.operators import evaluate, prep
from wardstone.operators.assemble import likely_keys
from wardstone.operators.ordered import bucket_by_points, running_totals, split_points
from wardstone.operators.quantiles import exact_quantiles
from wardstone.operators.rules import FeatureRule
from wardstone.operators.sequence import entity_sequence
from wardstone.operators.windowed import windowed_features
from wardstone.plans import cohort


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_stay_is_split_and_result_is_whole(spark, no_broadcast):
    """One stay holds most rows: the join splits it at run time, the aggregation sees pre-aggregated rows."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        start = F.lit("2130-01-01").cast("timestamp_ntz")
        ids = spark.range(0, 60_000, 1, 8)
        events = ids.select(
            F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id") % 500).alias("k"), F.lit(1).alias("item"),
            (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") % 100_000).cast("decimal(18,6)"))).alias("t"),
            (F.col("id") % 97).cast("double").alias("v"),
        )
        anchors = spark.range(500).select(F.col("id").alias("k"), start.alias("t0"))
        rules = [FeatureRule("total", "sum", (1,), window=(0, 24)), FeatureRule("top", "max", (1,)), FeatureRule("n", "count", (1,))]
        out = windowed_features(
            events, anchors, rules, on="k", entity="k", time="t", anchor_time="t0", item="item", value="v"
        )
        rows = out.collect()
        assert "skew=true" in plan_of(out)
        assert sum(r.n for r in rows) == 60_000
        assert next(r for r in rows if r.k == 7).n == events.where("k = 7").count()
    finally:
        for k in settings:
            spark.conf.unset(k)


@pytest.mark.parametrize("per_part", [1, 3, 17, 10_000])
def test_running_totals_do_not_depend_on_the_intervals(spark, per_part):
    rng = random.Random(per_part)
    rows = [(rng.choice(["a", "a", "a", "b", None]), x / 8, rng.randint(0, 5)) for x in rng.sample(range(1000), 60)]
    df = spark.createDataFrame(rows, "k string, x double, n long")
    placed = bucket_by_points(df, "x", split_points(df, "x", per_part), "_i")
    got = {(r.k, r.x): (r.n_upto, r.n_all) for r in running_totals(placed, ["k"], [F.col("x").asc()], ["n"], F.col("_i")).collect()}
    w = Window.partitionBy("k").orderBy("x")
    want = df.select("k", "x", F.sum("n").over(w).alias("u"), F.sum("n").over(Window.partitionBy("k")).alias("a"))
    assert got == {(r.k, r.x): (r.u, r.a) for r in want.collect()}


def test_metrics_do_not_depend_on_the_intervals(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), rng.randint(0, 40) / 64) for _ in range(400)]
    df = spark.createDataFrame(rows, "label int, score double")
    pos, neg = ([s for y, s in rows if y == c] for c in (1, 0))
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    for per_part in (2, 7, 1000):
        m = evaluate.ranking_metrics(df, "score", "label", per_part=per_part).first()
        assert m.auroc == pytest.approx(brute, abs=1e-12)
        assert evaluate.roc_points(df, "score", "label", per_part=per_part).count() == evaluate.roc_points(df, "score", "label").count()


def test_tied_scores(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    m = evaluate.ranking_metrics(df, "score", "label").first()
    assert (m.auroc, m.average_precision) == (0.5, 0.5)


def test_reliability_bin_edges(spark):
    df = spark.createDataFrame([(p, 1) for p in (0.0, 0.1, 0.1000001, 1.0)], "score double, label int")
    assert sorted((r.bin, r.n) for r in evaluate.reliability(df, "score", "label").collect()) == [(0, 2), (1, 1), (9, 1)]


def test_small_subgroups_are_skipped(spark):
    rows = [("a", 1, 0.9)] * 9 + [("a", 0, 0.1)] * 20 + [("b", 1, 0.9)] * 10 + [("b", 0, 0.1)] * 20
    df = spark.createDataFrame(rows, "g string, label int, score double")
    masks = {"first": F.col("g") == "a", "second": F.col("g") == "b"}
    assert [r.subgroup for r in evaluate.subgroup_metrics(df, {"m": "score"}, "label", masks).collect()] == ["second"]


@pytest.mark.parametrize("bins, few", [(3, 10), (256, 10), (256, 10_000)])
def test_quantiles_are_exact_in_any_number_of_rounds(spark, bins, few):
    import numpy as np

    rng = np.random.default_rng(3)
    values = np.where(rng.random(6000) < 0.34, 1.5, rng.normal(size=6000))
    df = spark.createDataFrame([(float(v), None if i % 4 else float(i)) for i, v in enumerate(values)], "x double, y double")
    got = {(r.feature, r.prob): r.value for r in exact_quantiles(df, ["x", "y"], (0.25, 0.5, 0.975), bins, few).collect()}
    for p in (0.25, 0.5, 0.975):
        assert got["x", p] == pytest.approx(np.quantile(values, p), abs=1e-12)
        assert got["y", p] == pytest.approx(np.quantile(np.arange(0, 6000, 4), p), abs=1e-9)


def test_quantiles_of_far_apart_and_infinite_values(spark):
    import numpy as np

    values = [float("-inf"), -1.7e308, -5e-324, 0.0, 5e-324, 1e-324 * 2, 1.0, 1 + 2**-52, 1e15, 1e15 + 1, 1e300, 1.79e308, float("inf")] * 3
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r.prob: r.value for r in exact_quantiles(df, ["x"], [i / 38 for i in range(39)], bins=2, few=1).collect()}
    assert [got[i / 38] for i in range(39)] == sorted(values)


def test_quantile_plans_do_not_grow_with_the_columns(spark):
    """A hundred columns take as many jobs as one and about as long."""
    import time

    wide = spark.range(2000).selectExpr(*[f"CAST((id * {k + 7}) % 1009 AS DOUBLE) AS c{k}" for k in range(127)])
    names = wide.columns
    exact_quantiles(wide, names[:1]).collect()
    start = time.perf_counter()
    got = {r.feature: r.value for r in exact_quantiles(wide, names).collect()}
    assert time.perf_counter() - start < 20 and len(got) == 127
    assert got["c0"] == sorted((i * 7) % 1009 for i in range(2000))[999] / 2 + sorted((i * 7) % 1009 for i in range(2000))[1000] / 2


def test_all_null_and_constant_columns(spark):
    df = spark.createDataFrame([(5.0, None, 0), (5.0, None, 1), (None, None, 1)], "c double, e double, b int")
    assert prep.column_kinds(df, ["c", "e", "b"]) == (["c"], ["e", "b"])
    fitted = prep.fit_prep(df, ["c"], ["e", "b"])
    out = fitted.scale(fitted.impute(df)).collect()
    assert all(r.z_c == 0 and r.z_e == 0 and r.c == 5 and r.e == 0 for r in out)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_of_buckets_in_groups(spark, descending):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), x, rng.choice([None, 1, 5])) for x in rng.sample(range(4000), 300)]
    df = spark.createDataFrame(rows, "k string, x long, n long")
    order = F.col("x").desc() if descending else F.col("x").asc()
    grouped, plain = (
        running_totals(df, ["k"], [order], ["n"], F.floor(F.col("x") / 10), descending, coarse).select("k", "x", "n_upto", "n_all")
        for coarse in (lambda b: F.floor(b / 7), None))
    assert grouped.count() == 300 and grouped.exceptAll(plain).count() == 0


def test_hot_label_is_ranked_in_groups_of_buckets(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 50 = 0 THEN 1 WHEN id % 50 = 1 THEN NULL ELSE 0 END AS y")
    split = prep.stratified_split(df, "y", "id", 0.2, 42, digits=5)
    assert split.exceptAll(prep.stratified_split(df, "y", "id", 0.2, 42, digits=1)).count() == 0
    # only the window over totals of groups is by the label alone
    ranked = split._jdf.queryExecution().optimizedPlan().toString()
    assert "_group" in ranked and "_earlier__one" in ranked


def test_quotas_share_the_rounded_up_total():
    assert prep.quotas({0: 40742 - 5342, 1: 5342}, 0.2) == {0: 8149 - 1068, 1: 1068}


@pytest.mark.parametrize("digits", [1, 3])
def test_split_and_folds_are_exact(spark, digits):
    df = spark.range(1001).select("id", (F.col("id") % 10 < 2).cast("int").alias("y"))
    out = prep.stratified_split(df, "y", "id", 0.2, 42, digits=digits).cache()
    assert out.count() == 1001
    sizes = {r.y: r["count"] for r in df.groupBy("y").count().collect()}
    want = prep.quotas(sizes, 0.2)
    assert {r.y: r["n"] for r in out.groupBy("y").agg(F.sum("is_test").alias("n")).collect()} == want
    sizes = [r["count"] for r in prep.folds(df, "y", "id", 5, 1, digits=digits).groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 2


def test_one_scan_per_fact(spark, base):
    tables = clinical.stored(Tables(spark, base))
    plan = plan_of(cohort.cohort_table(tables))
    scans = {n: plan.count(f"/{n}-") for n in ("chartevents", "labevents", "inputevents", "outputevents", "diagnoses_icd")}
    assert scans == {"chartevents": 2, "labevents": 1, "inputevents": 1, "outputevents": 1, "diagnoses_icd": 1}
    for wrong in ("CartesianProduct", "BroadcastNestedLoopJoin", "SortAggregate", "BatchEvalPython"):
        assert wrong not in plan


def test_items_and_columns_are_pushed_to_the_scan(spark, base):
    tables = clinical.stored(Tables(spark, base), ["icustays", "labevents"])
    plan = plan_of(cohort.lab_features(tables))
    assert "PushedFilters: [In(itemid" in plan
    assert "struct<hadm_id:bigint,charttime:timestamp_ntz,itemid:int,valuenum:double>" in plan


def test_sequence_moves_rows_once(spark, base, no_broadcast):
    orders = spark.read.parquet(f"{base}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    plan = plan_of(entity_sequence(orders, "o_custkey", "o_orderdate", ["o_orderkey"]))
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_running_total_never_windows_a_whole_hot_key(spark, base):
    events = spark.read.parquet(f"{base}/events.parquet").select("event_id", "event_type", "ts")
    out = entity_sequence(events, "event_type", "ts", ["event_id"])
    biggest = events.groupBy("event_type", F.to_date("ts")).count().agg(F.max("count")).first()[0]
    assert out.count() == events.count() and biggest < events.count() / 20


def test_sequence_moves_rows_once_unless_an_entity_is_heavy(spark):
    rows = spark.range(4000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN -1 WHEN id % 3 = 1 THEN NULL ELSE id % 50 END AS who",
                                        "timestamp_seconds(id * 9000) AS at")
    light = entity_sequence(rows, "who", "at", ["id"])
    plan = light._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    split = entity_sequence(rows, "who", "at", ["id"], per_part=500)
    assert "Join" in split._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, split.collect())) == sorted(map(str, light.collect()))


@pytest.mark.parametrize("name", ["item_labels", "lab_features"])
def test_hospital_queries_write_no_copies_of_the_event_tables(spark, base, tmp_path, monkeypatch, name):
    """Queries derive the tables they read; before, the first one wrote all eleven to the shared folder."""
    given, shared = tmp_path / "given", tmp_path / "shared"
    shared.mkdir()
    given.symlink_to(base)
    monkeypatch.setattr("wardstone.session.shared_folder", lambda _: str(shared))
    assert all_queries()[name](spark, str(given)).count() > 0
    assert not list(shared.iterdir())


def moved_columns(df) -> list[str]:
    """What the shuffles of a plan carry: the output of each node below an exchange."""
    out, node = [], df._jdf.queryExecution().executedPlan()
    todo = [node.initialPlan() if "AdaptiveSparkPlan" in node.nodeName() else node]
    while todo:
        plan = todo.pop()
        children = plan.children()
        if plan.nodeName() == "Exchange":
            out.append(children.apply(0).output().mkString(" "))
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_score_items_alone_leave_the_scans(spark, base, no_broadcast):
    """rows of items that no score looks at were shuffled, and drugs row by row."""
    tables = clinical.stored(Tables(spark, base))
    plan = plan_of(cohort.organ_failure_scores(tables))
    assert "223791" not in plan and "51237" not in plan and "amountuom" not in plan
    assert not any("starttime" in c or "amount" in c for c in moved_columns(cohort.organ_failure_scores(tables)))


def test_assessments_move_once(spark, base, no_broadcast):
    """answers were shuffled by (entity, time), then their counts by entity."""
    tables = clinical.stored(Tables(spark, base), ["icustays", "chartevents"])
    moved = moved_columns(cohort.assessment_features(tables))
    assert len(moved) == 2 and sum("charttime" in c for c in moved) == 1
    assert not any("value#" in c for c in moved)


def test_row_counts_move_keys_and_times_only(spark, base, no_broadcast):
    """values, items and whole assessments were shuffled to be counted."""
    tables = clinical.stored(Tables(spark, base))
    for counts in (cohort.sanity_counts(tables), cohort.study_table_counts(tables)):
        for columns in moved_columns(counts):
            assert not any(c in columns for c in ("itemid", "value", "amount", "n_rows", "_said"))


def test_events_of_other_stays_are_left_out_before_they_move(spark, base):
    """all events were shuffled for a cohort of few stays."""
    some = spark.range(0, 3000, 17).withColumnRenamed("id", "k").union(spark.range(-1, 0).toDF("k"))
    rows = spark.range(-10, 3000).withColumnRenamed("id", "k").union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    left = likely_keys(rows, some, "k", some.count())
    assert left.join(some, "k").count() == some.count() == 178
    assert 178 <= left.count() < 500
    assert likely_keys(rows, some.limit(0), "k", 0).count() == 0
    tables = clinical.stored(Tables(spark, base))
    assert plan_of(cohort.cohort_table(tables)).count("getbit") >= 6
