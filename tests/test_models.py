"""Invariants of what cannot be said in SQL."""

import os
from dataclasses import replace
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from catalogue import clinical, model_queries
from catalogue.registry import Tables
from wardstone.operators import ensemble, evaluate, explain, isotonic, linear, models, prep
from wardstone.plans import cohort, modelling
from wardstone.session import cut_lineage, shared_folder


@pytest.fixture(scope="module")
def prepared(spark):
    return model_queries.prepared(Tables(spark, "/root/testdata/sf0.01"))


@pytest.fixture(scope="module")
def boosted(prepared):
    return model_queries._boosted(prepared[0])


def test_path_shapley_against_brute_force():
    rng = np.random.default_rng(0)
    for d in (1, 2, 4):
        met, cover = rng.integers(0, 2, (5, d)).astype(float), rng.random(d)
        got = explain.path_shapley(met, cover)
        for row, out in zip(met, got):
            game = lambda s: np.prod([row[j] if j in s else cover[j] for j in range(d)])
            for i in range(d):
                rest = [j for j in range(d) if j != i]
                want = sum(
                    factorial(k) * factorial(d - k - 1) / factorial(d) * (game({*s, i}) - game(set(s)))
                    for k in range(d) for s in combinations(rest, k)
                )
                assert out[i] == pytest.approx(want)


def test_attributions_add_up_to_the_log_odds(spark, prepared, boosted):
    matrix, fitted = prepared
    model, _, _ = boosted
    test = matrix.where("is_test = 1")
    parts = explain.tree_attribution(model, test, "raw", fitted.columns, "doc_id")
    sums = {r.doc_id: r.s for r in parts.groupBy("doc_id").agg(F.sum("attribution").alias("s")).collect()}
    p = models.score(model, test, "p").select("doc_id", "p").collect()
    start = explain.base_value(model, spark)
    assert len(p) == len(sums) > 0
    for r in p:
        assert start + sums[r.doc_id] == pytest.approx(np.log(r.p / (1 - r.p)), abs=1e-6)


def test_calibration_is_monotone_and_in_range(prepared, boosted):
    model, _, hold = boosted
    scored = models.score(model, prepared[0], "p")
    calibration = models.calibrate(models.score(model, hold, "p"), "p")
    rows = models.apply_calibration(calibration, scored, "p", "c").orderBy("p").select("p", "c").collect()
    assert all(a.c <= b.c + 1e-12 for a, b in zip(rows, rows[1:])) and all(0 <= r.c <= 1 for r in rows)


def test_lasso_keeps_fewer_features_under_a_stronger_penalty(prepared):
    train = prepared[0].where("is_test = 0")
    kept = [len(models.selected_features(models.lasso("scaled", reg, max_iter=30).fit(train), prepared[1].columns)) for reg in (0.001, 0.05, 10.0)]
    assert kept[0] >= kept[1] >= kept[2] == 0


def test_scaled_training_columns_have_unit_population_deviation(prepared):
    x = vector_to_array("scaled")
    train = prepared[0].where("is_test = 0")
    row = train.agg(F.avg(x[0]).alias("m"), F.stddev_pop(x[0]).alias("s")).first()
    assert row.m == pytest.approx(0, abs=1e-9) and row.s == pytest.approx(1)


def test_best_round_waits_for_patience():
    aurocs = [0.5, 0.6, 0.55, 0.56, 0.7, 0.65, 0.64, 0.63, 0.9]
    assert models.best_round(aurocs, 2) == 2
    assert models.best_round(aurocs, 3) == 5
    assert models.best_round(aurocs, 30) == 9


def test_staged_margins_and_the_cut_model_agree_with_the_fit(spark, prepared):
    train = prep.class_weights(prepared[0].where("is_test = 0"), "label", 2.0)
    model = models.boosted("raw", rounds=4, depth=3, weight="weight").fit(train)
    nodes = ensemble.model_nodes(model, spark)
    rows = models.score(model, train, "p").select("raw", "p").limit(50).collect()
    margins = ensemble.staged_margins(nodes, np.stack([r.raw.toArray() for r in rows]))
    assert 1 / (1 + np.exp(-margins[:, -1])) == pytest.approx([r.p for r in rows])
    shorter = ensemble.cut_model(model, 2)
    assert shorter.getNumTrees == 2
    rows = models.score(shorter, train, "p").select("raw", "p").limit(50).collect()
    margins = ensemble.staged_margins(nodes, np.stack([r.raw.toArray() for r in rows]))
    assert 1 / (1 + np.exp(-margins[:, 1])) == pytest.approx([r.p for r in rows])


def test_path_scores_and_certificates(spark, prepared):
    train = prepared[0].where("is_test = 0")
    n = train.count()
    path = models.l1_path(train, "scaled", "fold", grid=[(c, 1 / (c * n)) for c in (0.01, 0.1, 1.0)], k=3)
    held = {c: models.cross_validated_auroc(models.lasso("scaled", reg, max_iter=1000), train, "fold", k=3) for c, reg, *_ in path.cv}
    for c, _, mean, sd, violation in path.cv:
        assert (mean, sd) == pytest.approx(held[c], abs=0.01) and violation < 1e-3
    rough = models.l1_path(train, "scaled", "fold", grid=[(1.0, 1 / n)], k=3, max_iter=1)
    assert rough.cv[0][-1] > path.cv[2][-1]


def test_blocks_do_not_depend_on_the_intervals(spark):
    df = scores(spark)
    one, many = (sorted(tuple(r) for r in isotonic.isotonic_blocks(df, "score", "label", n).collect()) for n in (250_000, 3))
    assert one == many and len(one) > 3
    assert all(a[1] < b[0] and a[4] < b[4] for a, b in zip(one, one[1:]))
    assert isotonic.isotonic_blocks(df.limit(0), "score", "label").count() == 0

def test_fewer_rounds_grow_the_same_leading_trees(prepared):
    train = prep.class_weights(prepared[0].where("is_test = 0"), "label", 2.0)
    grow = lambda n: [t.toDebugString.split("\n", 1)[1] for t in models.boosted("raw", rounds=n, depth=3, weight="weight").fit(train).trees]
    assert grow(4)[:2] == grow(2)


def test_penalty_grid():
    grid = models.penalty_grid(32_593)
    assert len(grid) == 30 and grid[0][0] == pytest.approx(1e-4) and grid[-1] == (10.0, pytest.approx(1 / 325_930))


def scores(spark, n=3000):
    rng = np.random.default_rng(9)
    y = rng.random(n) < 0.3
    s = np.round(rng.normal(size=n) + y, 2)
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")


def test_bootstrap_is_reproducible_and_does_not_lean(spark):
    df = scores(spark)
    exact = evaluate.auroc(df, "score", "label").first()[0]
    reps = evaluate.bootstrap_aurocs(df, "score", "label", n=300, per_part=50)
    got = np.array([r.auroc for r in reps.orderBy("replicate").collect()])
    again = np.array([r.auroc for r in evaluate.bootstrap_aurocs(df, "score", "label", n=300, per_part=50).orderBy("replicate").collect()])
    assert len(got) == 300 and (got == again).all()
    assert abs(got.mean() - exact) < 0.002
    # Against resampling rows one by one on the driver.
    pdf = df.toPandas()
    rng, brute = np.random.default_rng(1), []
    for _ in range(300):
        part = pdf.sample(len(pdf), replace=True, random_state=rng.integers(1 << 30))
        rank = part["score"].rank()
        p = part["label"].sum()
        brute.append((rank[part["label"] == 1].sum() - p * (p + 1) / 2) / (p * (len(part) - p)))
    assert got.std() == pytest.approx(np.std(brute), rel=0.2)


def test_one_class_resamples_are_left_out(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (0, 0.2)], "label int, score double")
    n = evaluate.bootstrap_aurocs(df, "score", "label", n=200).count()
    assert 100 < n < 200


def test_second_cohort_lacking_a_feature_is_zero_filled(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, a double")
    ready, lacking = prep.reconcile(df, ["a", "b"], keep=["id"])
    assert lacking == ["b"] and tuple(ready.first()) == (1, 2.0, 0.0)


def test_study_end_to_end(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.01")
    docs = model_queries.text_features(t)
    masks = {"english": F.col("is_en") == 1, "other": F.col("is_en") == 0}
    out = modelling.fit_and_evaluate(docs, "doc_id", "label", model_queries.FEATURES, masks=masks, settings=model_queries.SHORT)
    summary = {r.model: r for r in out.results["summary"]().collect()}
    assert set(summary) == {"lr", "boosted_raw", "boosted"}
    assert summary["boosted_raw"].ci_95_lo <= summary["boosted_raw"].auroc <= summary["boosted_raw"].ci_95_hi
    assert {r.subgroup for r in out.results["subgroups"]().collect()} <= set(masks)
    names = ["summary", "coefficients", "reliability", "attribution", "missing_data", "roc_points"]
    out.write(str(tmp_path), names=names)
    assert spark.read.option("header", True).csv(str(tmp_path / "coefficients")).count() == len(model_queries.FEATURES)
    again = modelling.evaluate_second_cohort(out.model, docs.drop("src1"), "label", "all").collect()
    assert {r.model for r in again} == {"lr", "boosted"}
    assert modelling.evaluate_second_cohort(out.model, None, "label", "absent") is None


def test_another_cohort_is_scored_on_chosen_features_only(spark, tmp_path, monkeypatch):
    """Features that no model reads are not computed, and the vectors of the others stay as they were."""
    names = ["a", "b", "c"]
    numbers = {n: float(i) for i, n in enumerate(names, 1)}
    fitted = prep.Prep(["a", "c"], ["b"], numbers, numbers, numbers)
    spark.sql("SELECT 7 AS id, 5D AS a, CAST(NULL AS DOUBLE) AS b, 9D AS c").write.parquet(f"{tmp_path}/rows")
    model = modelling.RiskModel("id", names, fitted, ["c", "b"], None, None, None)
    monkeypatch.setattr(modelling.RiskModel, "score_matrix", lambda self, matrix, keep: matrix)
    out, lacking = model.score(spark.read.parquet(f"{tmp_path}/rows"), ["id"])
    row = out.first()
    assert list(row.chosen_scaled) == [(9 - 3) / 3, 0.0] and list(row.chosen_raw) == [9.0, 2.0] and not lacking
    read = out._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert "b:double" in read and "c:double" in read and "a:double" not in read


def test_moments_of_many_columns_are_no_wide_aggregate(spark):
    wide = spark.range(500).selectExpr("id", *[f"CAST((id * {k + 7}) % 101 AS DOUBLE) AS c{k}" for k in range(100)])

    class Seen:
        def agg(self, *functions):
            raise AssertionError(f"{len(functions)} functions in one aggregate")

        def __getattr__(self, name):
            return getattr(wide, name)

    names = [c for c in wide.columns if c != "id"]
    fitted = prep.fit_prep(Seen(), [], names)
    values = [(i * 10) % 101 for i in range(500)]
    assert fitted.means["c3"] == pytest.approx(sum(values) / 500)
    assert fitted.sds["c3"] == pytest.approx((sum(v * v for v in values) / 500 - (sum(values) / 500) ** 2) ** 0.5)
    assert prep.fit_prep(wide.where("id < 0"), ["c0"], ["c1"]).means == {"c0": None, "c1": None}


def test_the_cohort_is_the_first_stays_of_all(spark, base):
    tables = Tables(spark, base)
    first = cohort.cohort_table(clinical.Derived(tables))
    everyone = cohort.cohort_table(clinical.Derived(tables), cohort.Options(first_stay_only=False))
    first, same = cut_lineage(first), cut_lineage(everyone.where("is_first_icu_stay = 1"))
    assert first.count() == same.count() > 0 and first.exceptAll(same).count() == 0


def test_the_study_queries_take_the_studys_own_numbers(monkeypatch):
    """all penalties, folds, rounds and replicates, not those of a short test."""
    def fit(df, key, target, features, *, settings=modelling.Settings(), **options):
        raise StopIteration(settings)

    class Given(dict):
        columns = ["stay_id", "age"]

        def where(self, _):
            return self

    monkeypatch.setattr(modelling, "fit_and_evaluate", fit)
    monkeypatch.setattr(model_queries, "_cohort", lambda *_: Given())
    for run in (model_queries._risk, model_queries._temporal):
        with pytest.raises(StopIteration) as asked:
            run(None)
        s = asked.value.value
        assert (s.penalties, s.folds, s.max_iter, s.rounds, s.cv_rounds, s.depth) == (None, 5, 1000, 500, 200, 5)
        assert (s.rate, s.patience, s.replicates) == (0.05, 30, 1000)


def test_rounds_of_l1_fits_leave_no_shuffles(spark):
    """each round moves a Hessian of every fit; it goes with its round."""
    def shuffled():
        places = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for place in places for _, _, names in os.walk(str(place)) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    rows = spark.range(400).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 3).cast("int").alias("fold"),
                                   array_to_vector(F.array(F.sin("id"), F.cos("id") + F.col("id") % 2)).alias("x"))
    rows = cut_lineage(rows)
    before = shuffled()
    linear.fit_l1(rows, "x", "label", "fold", [0.1, 0.01], range(3))
    assert not shuffled() - before


def test_the_cohort_and_a_study_delete_what_nothing_reads_again(spark, base):
    """feature tables go once the cohort is stored, matrices of all features once the chosen ones are."""
    def stored():
        return {x for x in os.listdir(shared_folder(spark)) if x.startswith("cut-")}

    before = stored()
    model_queries._cohort(Tables(spark, base))
    assert len(stored() - before) == 1
    docs, before = model_queries.text_features(Tables(spark, "/root/testdata/sf0.01")), stored()
    out = modelling.fit_and_evaluate(docs, "doc_id", "label", model_queries.FEATURES, settings=replace(model_queries.SHORT, rounds=2, cv_rounds=1))
    left = [set(spark.read.parquet(f"{shared_folder(spark)}/{x}").columns) for x in stored() - before]
    assert any("chosen_raw" in c for c in left) and not any({"raw", "weight"} & c or "n_words" in c for c in left)
    missing = {r.feature: r.n_missing for r in out.results["missing_data"]().collect()}
    assert missing.get("n_words", 0) == docs.where("n_words IS NULL").count()
    assert out.results["summary"]().count() == 3 and out.results["attribution"]().count() > 0
