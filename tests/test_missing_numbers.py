"""NaN counts as missing; small tables take the same way as large ones; failed fits are not papered over."""

import random
import statistics

import pytest

from wardstone.operators import prep, profile
from wardstone.operators.ordered import split_points
from wardstone.operators.quantiles import exact_quantiles


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,), (3.0,), (None,)], "x double")
    assert exact_quantiles(df, ["x"]).first().value == 2.0
    assert profile.null_audit(df, ["x"]).first().n_missing == 2
    fitted = prep.fit_prep(df, ["x"], [])
    assert fitted.fills["x"] == 2.0 and fitted.means["x"] == 2.0
    assert fitted.sds["x"] == pytest.approx(statistics.pstdev([2.0, 1.0, 2.0, 3.0, 2.0]))
    binary = spark.createDataFrame([(1.0,), (float("nan"),), (0.0,)], "x double")
    assert prep.column_kinds(binary, ["x"]) == ([], ["x"])


@pytest.mark.parametrize("n", [1, 2, 3, 11, 12, 50, 997])
def test_quantiles_of_any_size(spark, n):
    draw = random.Random(n)
    values = [float(draw.randrange(1 + n // 2)) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    got = {r.prob: r.value for r in exact_quantiles(df, ["x"], (0.0, 0.1, 0.25, 0.5, 0.9, 1.0), bins=2, few=2).collect()}
    ordered = sorted(values)
    for p, value in got.items():
        at = p * (n - 1)
        low, high = ordered[int(at)], ordered[min(int(at) + 1, n - 1)]
        assert value == pytest.approx(low + (high - low) * (at - int(at))), p
    assert len(got) == 6


def test_no_values(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "x double"), ["x"]).count() == 0


def test_split_points_follow_the_count(spark):
    df = spark.range(5000).selectExpr("cast(id AS double) AS v")
    points = split_points(df, "v", per_part=3, unique=True)
    assert len(points) > 1500
    assert points == split_points(df.union(df), "v", per_part=3)


def test_folds_of_hot_label(spark):
    df = spark.range(1003).selectExpr("id", "cast(id % 100 = 0 AS int) AS label")
    sizes = prep.folds(df, "label", "id", 5).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        n = [r["count"] for r in sizes if r.label == label]
        assert len(n) == 5 and max(n) - min(n) <= 1
