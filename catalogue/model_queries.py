"""Model fits on labelled documents. Iterative, so without SQL; tests hold their invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import clinical
from catalogue.registry import Tables, query
from wardstone.operators import evaluate, explain, models, prep
from wardstone.plans import cohort as cohort_plan, modelling, rulebook as rules
from wardstone.session import cut_lineage, forget

FEATURES = ["n_chars", "n_words", "n_lines", "digit_share", "upper_share", "punct_share", "word_length", "is_en", "is_fr", "is_de", "src0", "src1"]


def text_features(t: Tables):
    """Features of whole texts with a quality label; sparse where the text has no words."""
    text, n = F.col("text"), F.nullif(F.length("text"), F.lit(0))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    words = F.nullif(count(r"\S+"), F.lit(0.0))
    docs = t("documents").join(t("labels"), "doc_id").where(F.col("quality").isNotNull())
    return docs.select(
        "doc_id", F.col("quality").alias("label"), "toxic", "lang",
        F.col("n_chars").cast("double").alias("n_chars"), words.alias("n_words"), count(r"\n").alias("n_lines"),
        (count(r"\d") / n).alias("digit_share"), (count(r"\p{Lu}") / n).alias("upper_share"),
        (count(r"\p{Punct}") / n).alias("punct_share"), (count(r"\S") / words).alias("word_length"),
        *[F.when(F.col("lang") == x, 1.0).otherwise(0.0).alias(f"is_{x}") for x in ("en", "fr", "de")],
        *[F.when(F.col("source") == x, 1.0).otherwise(0.0).alias(x) for x in ("src0", "src1")],
    )


def prepared(t: Tables):
    """(all rows as vectors with a split and a fold, fitted preparation); written once, read by every fit."""
    rows = cut_lineage(prep.stratified_split(text_features(t), "label", "doc_id", 0.25, 42))
    continuous, binary = prep.column_kinds(rows, FEATURES)
    fitted = prep.fit_prep(rows.where("is_test = 0"), continuous, binary)
    matrix = prep.folds(fitted.matrix(rows, ["doc_id", "label", "toxic", "lang", "is_test"]), "label", "doc_id", 3, 42)
    return cut_lineage(matrix), fitted


def _path(matrix, fitted):
    """The study's own path: 30 penalties; three folds, since the rare class of the smallest table has few rows."""
    return models.l1_path(matrix.where("is_test = 0"), "scaled", "fold", k=3)


@query("l1_path")
def _l1_path(t: Tables):
    return _path(*prepared(t)).table(t.spark)


@query("coefficient_table")
def _coefficients(t: Tables):
    matrix, fitted = prepared(t)
    return models.coefficient_table(t.spark, _path(matrix, fitted).model, fitted.columns)


@query("selected_logistic")
def _selected(t: Tables):
    """Keep the features with a non-zero coefficient, fit them again, score the held-out rows."""
    matrix, fitted = prepared(t)
    path = _path(matrix, fitted)
    names = models.selected_features(path.model, fitted.columns)
    chosen = prep.slice_features(matrix, "scaled", names, "chosen")
    model = models.lasso("chosen", path.best_lambda, max_iter=20).fit(chosen.where("is_test = 0"))
    return models.score(model, chosen.where("is_test = 1"), "probability_lr").select("doc_id", "label", "probability_lr")


def _boosted(matrix, rounds: int = 12):
    train = matrix.where("is_test = 0")
    ratio = train.agg(F.count_if(F.col("label") == 0) / F.greatest(F.count_if(F.col("label") == 1), F.lit(1))).first()[0]
    weighted = cut_lineage(
        prep.stratified_split(prep.class_weights(train, "label", ratio), "label", "doc_id", 0.2, "42-cal", flag="is_cal")
    )
    estimator = models.boosted("raw", rounds=rounds, depth=3, rate=0.3, weight="weight")
    fit, hold = weighted.where("is_cal = 0"), weighted.where("is_cal = 1")
    model, losses = models.fit_boosted(fit, hold, estimator, patience=4)
    return model, losses, hold


@query("boosted_trees")
def _trees(t: Tables):
    matrix, _ = prepared(t)
    model, _, _ = _boosted(matrix)
    return models.score(model, matrix.where("is_test = 1"), "probability_gbt").select("doc_id", "label", "probability_gbt")


@query("calibrated_scores")
def _calibrated(t: Tables):
    matrix, _ = prepared(t)
    model, _, hold = _boosted(matrix)
    calibration = models.calibrate(models.score(model, hold, "p"), "p")
    test = models.score(model, matrix.where("is_test = 1"), "p")
    return models.apply_calibration(calibration, test, "p", "calibrated").select("doc_id", "label", "p", "calibrated")


@query("cross_validated_auroc")
def _cv(t: Tables):
    matrix, _ = prepared(t)
    train = matrix.where("is_test = 0")
    mean, sd = models.cross_validated_auroc(models.lasso("scaled", 0.01, max_iter=20), train, "fold", k=3)
    return train.groupBy().agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(mean).alias("cv_mean"), F.lit(sd).alias("cv_sd"))


@query("scored_second_cohort")
def _second(t: Tables):
    """A frozen pipeline on all documents, which lack one of the features it was fitted with."""
    matrix, fitted = prepared(t)
    model = models.lasso("scaled", 0.01, max_iter=20).fit(matrix.where("is_test = 0"))
    wide = text_features(t).drop("src1")
    second, _ = prep.reconcile(wide, FEATURES, keep=["doc_id", "label"])
    scored = models.score(model, fitted.matrix(second, ["doc_id", "label"]), "probability_lr")
    return evaluate.summary(scored, {"frozen": "probability_lr"}, "label", "all documents")


@query("tree_attribution")
def _attribution(t: Tables):
    matrix, fitted = prepared(t)
    model, _, _ = _boosted(matrix)
    return explain.tree_attribution(model, matrix.where("is_test = 1"), "raw", fitted.columns, "doc_id")


@query("attribution_top_features")
def _top(t: Tables):
    matrix, fitted = prepared(t)
    model, _, _ = _boosted(matrix)
    parts = explain.tree_attribution(model, matrix.where("is_test = 1"), "raw", fitted.columns, "doc_id")
    return explain.attribution_ranking(parts, 20)


# Few penalties and rounds, for tests of the study end to end; the queries take the study's own numbers.
SHORT = modelling.Settings(
    penalties=(0.05,), folds=2, max_iter=15, rounds=6, cv_rounds=3, depth=3, rate=0.3, patience=3, replicates=200,
)


def _cohort(t: Tables, options: cohort_plan.Options = cohort_plan.Options()):
    stored = []
    table = cut_lineage(cohort_plan.cohort_table(clinical.Derived(t), options, stored))
    forget(*stored)
    return table


def _study(table, **options):
    """The whole study with the defaults of Settings: all penalties, folds, rounds and replicates."""
    features = cohort_plan.feature_names(table.columns, rules.SPARSE_REVISED)
    return modelling.fit_and_evaluate(table, "stay_id", rules.TARGET, features, **options)


@query("cohort_risk_summary")
def _risk(t: Tables):
    """The whole study on the cohort, then the frozen pipeline on all adult stays."""
    # a stay's row does not depend on which stays are kept: the cohort is the first stays among all, derived once
    everyone = _cohort(t, cohort_plan.Options(first_stay_only=False))
    outcome = _study(everyone.where("is_first_icu_stay = 1"), masks=modelling.study_masks())
    second = modelling.evaluate_second_cohort(outcome.model, everyone, rules.TARGET, "all adult stays")
    first = outcome.results["summary"]()
    return first.unionByName(second, allowMissingColumns=True)


@query("temporal_validation_subgroups")
def _temporal(t: Tables):
    """Train on the earlier year groups, test on the later ones, by race."""
    outcome = _study(_cohort(t), masks=modelling.race_masks(), is_test=modelling.is_after("anchor_year_group"))
    return outcome.results["subgroups"]()
