"""Risk modelling on the analytic table: split, prepare, select, fit, calibrate, evaluate, explain.

Every result is a DataFrame. The driver holds only what the fits are made of: names, a few numbers per feature, the
trees. The matrix is written to reliable storage once and read by all fits.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, functions as F

from wardstone.functions import round_columns, sqltext
from wardstone.operators import evaluate, explain, models, prep, profile
from wardstone.plans import rulebook as rules
from wardstone.session import cut_lineage, forget
from wardstone.sources import write_results

FEW_ROWS = 250_000  # training rows of fits that run side by side


@dataclass(frozen=True)
class Settings:
    """FIXED VALUES: the defaults are those of the study. ``kinds_from`` says which rows decide what is binary."""

    test_fraction: float = 0.2
    calibration_fraction: float = 0.2
    seed: int = 42
    penalties: Sequence[float] | None = None
    folds: int = 5
    max_iter: int = 1000
    rounds: int = 500
    cv_rounds: int = 200
    depth: int = 5
    rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    patience: int = 30
    replicates: int = 1000
    bins: int = 10
    min_events: int = rules.MIN_SUBGROUP_EVENTS
    kinds_from: str = "all"
    parallelism: int = 4


@dataclass
class RiskModel:
    """The frozen pipeline: preparation, both models and the calibration."""

    key: str
    features: list[str]
    prep: prep.Prep
    chosen: list[str]
    logistic: object
    boosted: object
    calibration: object

    def score(self, df: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
        """Score any table: missing features count as 0 and are reported."""
        ready, lacking = prep.reconcile(df, self.features, keep=keep)
        matrix = self.prep.only(self.chosen).matrix(ready, keep)  # of all other features nothing is computed
        return self.score_matrix(_slices(matrix, self.chosen), keep), lacking

    def score_matrix(self, matrix: DataFrame, keep: Sequence[str]) -> DataFrame:
        out = models.score(self.logistic, matrix, "lr")
        out = models.score(self.boosted, out, "boosted_raw")
        out = models.apply_calibration(self.calibration, out, "boosted_raw", "boosted")
        return out.select(*keep, "lr", "boosted_raw", "boosted")


@dataclass
class Outcome:
    """The fitted pipeline, the scored rows and the result tables, each built when it is asked for."""

    model: RiskModel
    results: dict[str, Callable[[], DataFrame]]
    scored: DataFrame
    best_c: float
    losses: list[float] = field(default_factory=list)

    def write(self, folder: str, fmt: str = "csv", names: Sequence[str] = ()) -> None:
        """Write the named result tables, or all of them, with the published number of digits."""
        tables = {n: round_columns(self.results[n](), rules.PUBLISHED_DIGITS) for n in names or self.results}
        write_results(tables, folder, fmt)


def _slices(matrix: DataFrame, chosen: Sequence[str]) -> DataFrame:
    matrix = prep.slice_features(matrix, "scaled", chosen, "chosen_scaled")
    return prep.slice_features(matrix, "raw", chosen, "chosen_raw")


def study_masks() -> dict[str, Column]:
    """FIXED VALUES: the subgroups of the study."""
    return {
        "No dementia (dementia_icd=0)": F.col("dementia_icd") == 0,
        "Dementia (dementia_icd=1)": F.col("dementia_icd") == 1,
        "Alzheimer's dementia": F.col("dementia_alzheimers") == 1,
        "Vascular dementia": F.col("dementia_vascular") == 1,
    }


def race_masks() -> dict[str, Column]:
    names = ("White", "Black", "Hispanic", "Asian", "Other")
    return {name: F.col("race_coded") == code for code, name in enumerate(names, 1)}


def fit_and_evaluate(
    df: DataFrame,
    key: str,
    target: str,
    features: Sequence[str],
    *,
    masks: Mapping[str, Column] | None = None,
    is_test: Column | None = None,
    settings: Settings = Settings(),
) -> Outcome:
    """The whole study on one analytic table.

    ``is_test`` replaces the random split, for a temporal validation. Early stopping and calibration use rows held out
    of training; the test rows are only scored.
    """
    s, spark, features = settings, df.sparkSession, list(features)
    # Subgroup columns ride along under names of their own, apart from the imputed features.
    flags = {f"_m{i}": F.coalesce(test.cast("int"), F.lit(0)) for i, test in enumerate((masks or {}).values())}
    rows = df.select(
        key, F.col(target).cast("int").alias("label"), *[test.alias(n) for n, test in flags.items()],
        *([is_test.cast("int").alias("is_test")] if is_test is not None else []),
        *[sqltext.column(sqltext.number_or_null(c), c) for c in features],
    )
    given, rows = rows, cut_lineage(rows)  # the split reads its input more than once
    if is_test is None:
        before, rows = rows, cut_lineage(prep.stratified_split(rows, "label", key, s.test_fraction, s.seed))
        forget(before)
    train_rows = rows.where("is_test = 0")

    continuous, binary = prep.column_kinds(rows if s.kinds_from == "all" else train_rows, features)
    fitted = prep.fit_prep(train_rows, continuous, binary)
    keep = [key, "label", "is_test", *flags]
    matrix = cut_lineage(fitted.matrix(prep.folds(rows, "label", key, s.folds, s.seed), [*keep, "fold"]))
    forget(rows)
    train = matrix.where("is_test = 0")

    n_train = train.count()
    grid = [(c, 1 / (c * n_train)) for c in s.penalties] if s.penalties else models.penalty_grid(n_train)
    path = models.l1_path(
        train, "scaled", "fold", grid=grid, k=s.folds
    )
    chosen = models.selected_features(path.model, fitted.columns)
    if not chosen:
        raise ValueError(f"no feature has a coefficient at the best penalty, {path.best_c}")
    ready = cut_lineage(_slices(matrix, chosen).drop("raw", "scaled"))
    forget(matrix)
    train = ready.where("is_test = 0")

    logistic_fit = models.lasso("chosen_scaled", path.best_lambda, max_iter=s.max_iter)
    logistic = logistic_fit.fit(train)
    at_once = s.parallelism if n_train <= FEW_ROWS else 1  # each fit keeps its rows; of many, one fit's alone
    lr_cv = models.cross_validated_auroc(logistic_fit, train, "fold", k=s.folds, parallelism=at_once)

    ratio = profile.class_ratio(train, "label").first().ratio
    if not ratio:
        raise ValueError("training rows hold one class only")
    weighted = prep.class_weights(train.select(key, "label", "fold", "chosen_raw"), "label", ratio)
    weighted = cut_lineage(
        prep.stratified_split(weighted, "label", key, s.calibration_fraction, f"{s.seed}-calibration", "is_cal")
    )
    estimator = models.boosted(
        "chosen_raw", rounds=s.rounds, depth=s.depth, rate=s.rate, rows=s.row_share, columns=s.column_share,
        weight="weight", seed=s.seed,
    )
    hold = weighted.where("is_cal = 1")
    shorter = estimator.copy({estimator.maxIter: s.cv_rounds})
    with ThreadPool(1) as side:
        cv_of = lambda: models.cross_validated_auroc(shorter, weighted, "fold", k=s.folds, parallelism=at_once)
        beside = side.apply_async(inheritable_thread_target(spark)(cv_of)) if at_once > 1 else None
        boosted, losses = models.fit_boosted(weighted.where("is_cal = 0"), hold, estimator, s.patience)
        boosted_cv = beside.get() if beside else cv_of()
    calibration = models.calibrate(models.score(boosted, hold, "p"), "p")
    forget(weighted)

    model = RiskModel(key, features, fitted, chosen, logistic, boosted, calibration)
    scored = cut_lineage(model.score_matrix(ready, keep))
    test = scored.where("is_test = 1")
    scores = {"lr": "lr", "boosted_raw": "boosted_raw", "boosted": "boosted"}

    def long(part: DataFrame, chosen_scores: Sequence[str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in chosen_scores])
        return part.select("label", F.inline(pairs))

    cv = spark.createDataFrame(
        [("lr", *lr_cv), ("boosted_raw", *boosted_cv)], "model string, cv_auroc_mean double, cv_auroc_sd double"
    )

    def summary() -> DataFrame:
        interval = evaluate.bootstrap_interval(test, "boosted_raw", "label", s.replicates, s.seed).select(
            F.lit("boosted_raw").alias("model"), F.col("lo").alias("ci_95_lo"), F.col("hi").alias("ci_95_hi")
        )
        rows = evaluate.summary(test, scores, "label", "test")
        return rows.join(cv, "model", "left").join(interval, "model", "left")

    results = {
        "missing_data": lambda: profile.null_audit(given, features),
        "penalty_path": lambda: path.table(spark),
        "coefficients": lambda: models.coefficient_table(spark, path.model, fitted.columns),
        "preparation": lambda: fitted.table(spark),
        "summary": summary,
        "train_summary": lambda: evaluate.summary(scored.where("is_test = 0"), scores, "label", "train"),
        "roc_points": lambda: evaluate.roc_points(long(test, ["lr", "boosted"]), "score", "label", ["model"]),
        "pr_points": lambda: evaluate.pr_points(long(test, ["lr", "boosted"]), "score", "label", ["model"]),
        "reliability": lambda: evaluate.reliability(long(test, list(scores)), "score", "label", s.bins, ["model"]),
        "attribution": lambda: explain.attribution_ranking(
            explain.tree_attribution(boosted, ready.where("is_test = 1"), "chosen_raw", chosen, key)
        ),
    }
    if masks:
        tested = {name: F.col(flag) == 1 for name, flag in zip(masks, flags)}
        pair = {"boosted": "boosted", "lr": "lr"}
        results["subgroups"] = lambda: evaluate.subgroup_metrics(test, pair, "label", tested, s.min_events)
        results["subgroup_roc"] = lambda: evaluate.subgroup_roc(test, "boosted", "label", tested, s.min_events)
    return Outcome(model, results, scored, path.best_c, losses)


def evaluate_second_cohort(model: RiskModel, df: DataFrame | None, target: str, name: str) -> DataFrame | None:
    """Metrics of the frozen pipeline on another table; ``None`` where there is no such table."""
    if df is None:
        return None
    scored, _ = model.score(df.withColumn("label", F.col(target).cast("int")), [model.key, "label"])
    return evaluate.summary(cut_lineage(scored), {"lr": "lr", "boosted": "boosted"}, "label", name)


def is_after(year_group: str, last_train_year: int = rules.LAST_TRAIN_YEAR) -> Column:
    """Test rows of a temporal validation: the year group ends after the last training year."""
    return prep.group_end(year_group) > last_train_year
