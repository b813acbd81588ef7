"""Exact ranking, calibration and subgroup metrics.

Everything starts from one row per distinct score with its numbers of positives and negatives, so ties are exact and a
score shared by many rows is combined map-side. Cumulative counts come from ``running_totals`` over score intervals.
Every function takes ``by``, the columns that tell several evaluations apart.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardstone.operators.ordered import BUCKET, PER_PART, bucket_by_points, running_totals, split_points
from wardstone.session import cut_lineage

def evaluable(df: DataFrame, score: str, label: str) -> DataFrame:
    """The rows a metric is about: those with a label and a score. NaN is a missing score."""
    return df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))


def score_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., score, pos, neg), one row per distinct score of the evaluable rows."""
    one = lambda value: F.count_if(F.col(label) == value)
    return (
        evaluable(df, score, label)
        .groupBy(*by, F.col(score).cast("double").alias("score")).agg(one(1).alias("pos"), one(0).alias("neg"))
    )


def _placed_counts(df: DataFrame, score: str, label: str, by: Sequence[str], per_part: int, name: str) -> DataFrame:
    """Score counts with the number of their score interval.

    Three passes follow (split points, interval totals, running sums), so the counts are written once: whatever made the
    scores runs a single time.
    """
    counts = cut_lineage(score_counts(df, score, label, by))
    return bucket_by_points(counts, "score", split_points(counts, "score", per_part, unique=not by), name)


def cumulative_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = (), per_part: int = PER_PART) -> DataFrame:
    """(by..., score, pos, neg, tp, fp, n_pos, n_neg): positives and negatives scored at least as high, and in all."""
    placed = _placed_counts(df, score, label, by, per_part, "_interval")
    out = running_totals(placed, by, [F.col("score").desc()], ["pos", "neg"], F.col("_interval"), descending=True)
    return out.select(
        *by, "score", "pos", "neg",
        F.col("pos_upto").alias("tp"), F.col("neg_upto").alias("fp"),
        F.col("pos_all").alias("n_pos"), F.col("neg_all").alias("n_neg"),
    )


def _auroc(ranked: Column) -> Column:
    return F.sum(ranked) / F.nullif(F.first("n_pos").cast("double") * F.first("n_neg"), F.lit(0.0))


def ranking_metrics(df: DataFrame, score: str, label: str, by: Sequence[str] = (), per_part: int = PER_PART) -> DataFrame:
    """(by..., n, n_pos, auroc, average_precision). Ties count one half; precision steps at distinct scores."""
    counts = cumulative_counts(df, score, label, by, per_part)
    beaten = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    step = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return counts.groupBy(*by).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.sum("pos").alias("n_pos"),
        _auroc(beaten).alias("auroc"),
        (F.sum(step) / F.nullif(F.first("n_pos"), F.lit(0))).alias("average_precision"),
    )


def auroc(df: DataFrame, score: str, label: str, by: Sequence[str] = (), per_part: int = PER_PART) -> DataFrame:
    return ranking_metrics(df, score, label, by, per_part).select(*by, "auroc")


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = (), per_part: int = PER_PART) -> DataFrame:
    return ranking_metrics(df, score, label, by, per_part).select(*by, "average_precision")


def brier(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    miss = F.col(score) - F.col(label)
    return evaluable(df, score, label).groupBy(*by).agg(F.avg(miss * miss).alias("brier"))


def roc_points(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), drop_intermediate: bool = True, per_part: int = PER_PART
) -> DataFrame:
    """(by..., threshold, fpr, tpr), from the (0, 0) corner with an infinite threshold.

    ``drop_intermediate`` leaves out points inside a straight run: those whose step in both counts equals the next one. The
    first and the last threshold stay.
    """
    placed = _placed_counts(df, score, label, by, per_part, "_interval")
    sums = running_totals(placed, by, [F.col("score").desc()], ["pos", "neg"], F.col("_interval"), descending=True)
    if drop_intermediate:
        sums = _with_next_step(sums, placed, by)
        straight = (F.col("pos") == F.col("_next_pos")) & (F.col("neg") == F.col("_next_neg"))
        first = (F.col("pos_upto") == F.col("pos")) & (F.col("neg_upto") == F.col("neg"))
        sums = sums.where(first | ~F.coalesce(straight, F.lit(False)))
    rate = lambda part, whole: F.col(part) / F.nullif(F.col(whole), F.lit(0))
    curve = sums.select(
        *by, F.col("score").alias("threshold"),
        rate("neg_upto", "neg_all").alias("fpr"), rate("pos_upto", "pos_all").alias("tpr"),
    )
    corner = placed.select(*by).distinct() if by else placed.groupBy().agg(F.count(F.lit(1))).select()
    corner = corner.select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return curve.unionByName(corner)


def _with_next_step(sums: DataFrame, placed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of the next lower score, also across the edge of an interval."""
    inside = Window.partitionBy(*by, "_interval").orderBy(F.col("score").desc())
    head = placed.groupBy(*by, "_interval").agg(F.max_by(F.struct("pos", "neg"), "score").alias("_head"))
    across = Window.partitionBy(*by).orderBy(F.col("_interval").desc())
    head = head.select(
        *[F.col(b).alias(f"_h_{b}") for b in by], F.col("_interval").alias("_h_interval"),
        F.lead("_head").over(across).alias("_following"),
    )
    on = F.col("_interval") == F.col("_h_interval")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_h_{b}"))
    step = F.coalesce(F.lead(F.struct("pos", "neg")).over(inside), F.col("_following"))
    return sums.join(head, on, "left").withColumn("_step", step).withColumns(
        {"_next_pos": F.col("_step.pos"), "_next_neg": F.col("_step.neg")}
    )


def pr_points(df: DataFrame, score: str, label: str, by: Sequence[str] = (), per_part: int = PER_PART) -> DataFrame:
    """(by..., threshold, precision, recall, baseline), with the (1, 0) end point at a NULL threshold."""
    counts = cumulative_counts(df, score, label, by, per_part)
    share = F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))
    curve = counts.select(
        *by, F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.nullif(F.col("n_pos"), F.lit(0))).alias("recall"),
        share.alias("baseline"),
    )
    totals = evaluable(df, score, label).groupBy(*by).agg(F.avg(F.col(label)).alias("baseline"))
    end = totals.select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"), "baseline",
    )
    return curve.unionByName(end)


def reliability(df: DataFrame, score: str, label: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(by..., bin, n, mean_predicted, observed) over equal-width bins closed on the right; empty bins do not appear."""
    inner_edges = [k * (1.0 / bins) for k in range(1, bins)]
    number = reduce(lambda a, b: a + b, [F.when(F.col(score) > F.lit(e), 1).otherwise(0) for e in inner_edges])
    return evaluable(df, score, label).groupBy(*by, number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col(score)).alias("mean_predicted"),
        F.avg(F.col(label).cast("double")).alias("observed"),
    )


def bootstrap_aurocs(
    df: DataFrame, score: str, label: str, n: int = 1000, seed: int = 42, per_part: int = PER_PART, chunk: int = 100
) -> DataFrame:
    """(replicate, auroc) of ``n`` resamples with replacement of all rows; resamples with one class only are left out.

    Rows are first reduced to counts per (score, label). Drawing N rows with replacement makes those counts
    multinomial, and a multinomial splits exactly into a draw over score intervals and a draw inside each: every task
    repeats the first draw (same seed, same interval totals) and makes its own second one. Rows times replicates is
    never built; each interval sends three sums per replicate on.
    """
    placed = _placed_counts(df, score, label, (), per_part, BUCKET).withColumn(BUCKET, F.col(BUCKET).cast("int"))
    sizes = {r[0]: r[1] for r in placed.groupBy(BUCKET).agg(F.sum(F.col("pos") + F.col("neg"))).collect()}
    intervals = sorted(sizes)
    weights = np.array([sizes[b] for b in intervals], dtype="int64")
    total = int(weights.sum())

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score", ascending=False)
        place = intervals.index(int(pdf[BUCKET].iloc[0]))
        cells = np.concatenate([pdf["pos"].to_numpy(), pdf["neg"].to_numpy()])
        shares, k = cells / cells.sum(), len(pdf)
        out = []
        for start in range(0, n, chunk):
            stop = min(start + chunk, n)
            outer = np.stack(
                [np.random.default_rng([seed, r]).multinomial(total, weights / total)[place] for r in range(start, stop)]
            )
            inner = np.random.default_rng([seed, n + start, place])
            got = np.stack([inner.multinomial(size, shares) for size in outer])
            pos, neg = got[:, :k].astype("float64"), got[:, k:].astype("float64")
            beaten = (neg * (np.cumsum(pos, axis=1) - pos / 2)).sum(axis=1)
            out.append(pd.DataFrame({
                "replicate": np.arange(start, stop), BUCKET: place,
                "p": pos.sum(axis=1), "q": neg.sum(axis=1), "beaten": beaten,
            }))
        return pd.concat(out)

    sums = placed.groupBy(BUCKET).applyInPandas(draw, f"replicate int, {BUCKET} int, p double, q double, beaten double")
    above = Window.partitionBy("replicate").orderBy(F.col(BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sums.withColumn("above", F.coalesce(F.sum("p").over(above), F.lit(0.0)))
    area = F.sum(F.col("beaten") + F.col("q") * F.col("above"))
    return (
        ranked.groupBy("replicate").agg((area / F.nullif(F.sum("p") * F.sum("q"), F.lit(0.0))).alias("auroc"))
        .where(F.col("auroc").isNotNull())
    )


def interval(df: DataFrame, column: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(n, lo, hi): percentile interval of a column whose size the caller bounds, such as the bootstrap replicates."""
    both = F.percentile(F.col(column), F.array(F.lit(low), F.lit(high)))
    return df.agg(F.count(column).alias("n"), both.alias("_p")).select(
        "n", F.col("_p")[0].alias("lo"), F.col("_p")[1].alias("hi")
    )


def bootstrap_interval(df: DataFrame, score: str, label: str, n: int = 1000, seed: int = 42, per_part: int = PER_PART) -> DataFrame:
    return interval(bootstrap_aurocs(df, score, label, n, seed, per_part), "auroc")


def in_subgroups(df: DataFrame, masks: Mapping[str, Column], name: str = "subgroup") -> DataFrame:
    """A copy of each row per subgroup whose mask it passes; subgroups may overlap."""
    names = F.array_compact(F.array(*[F.when(mask, F.lit(label)) for label, mask in masks.items()]))
    return df.withColumn(name, F.explode(names))


def subgroup_metrics(
    df: DataFrame, scores: Mapping[str, str], label: str, masks: Mapping[str, Column], min_events: int = 10, per_part: int = PER_PART
) -> DataFrame:
    """(subgroup, n, n_events, prevalence_pct, <model>_auroc, <model>_ap ...); small subgroups are skipped.

    ``scores`` maps a model name to its score column. All models are evaluated in one pass over long rows.
    """
    long = in_subgroups(df, masks)
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score")) for m, c in scores.items()])
    long = long.select("subgroup", F.col(label).alias("label"), F.inline(pairs))
    metrics = ranking_metrics(long, "score", "label", ["subgroup", "model"], per_part)
    pick = lambda column, model: F.max(F.when(F.col("model") == model, F.col(column)))
    wide = [
        pick(source, m).alias(f"{m}_{short}")
        for m in scores for source, short in (("auroc", "auroc"), ("average_precision", "ap"))
    ]
    return (
        metrics.where(F.col("n_pos") >= min_events)
        .groupBy("subgroup").agg(F.max("n").alias("n"), F.max("n_pos").alias("n_events"), *wide)
        .withColumn("prevalence_pct", F.col("n_events") / F.col("n") * 100)
    )


def subgroup_roc(
    df: DataFrame, score: str, label: str, masks: Mapping[str, Column], min_events: int = 10, per_part: int = PER_PART
) -> DataFrame:
    long = in_subgroups(df, masks)
    enough = long.groupBy("subgroup").agg(F.count_if(F.col(label) == 1).alias("_events")).where(F.col("_events") >= min_events)
    curve = roc_points(long, score, label, ["subgroup"], per_part=per_part)
    return curve.join(enough.select("subgroup"), "subgroup", "left_semi")


def summary(df: DataFrame, scores: Mapping[str, str], label: str, cohort: str, per_part: int = PER_PART) -> DataFrame:
    """(model, cohort, n, n_positive, auroc, pr_auc, brier), one row per score column, all from the same scores."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score")) for m, c in scores.items()])
    long = df.select(F.col(label).alias("label"), F.inline(pairs))
    ranking = ranking_metrics(long, "score", "label", ["model"], per_part)
    return ranking.join(brier(long, "score", "label", ["model"]), "model").select(
        "model", F.lit(cohort).alias("cohort"), "n", F.col("n_pos").alias("n_positive"),
        "auroc", F.col("average_precision").alias("pr_auc"), "brier",
    )
