"""Metrics and splits on missing labels, missing scores and empty tables."""

import math

import pytest

from wardstone.operators import evaluate, prep

SCHEMA = "label int, score double"


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.4), (0, 0.2)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark, known):
    return known.union(spark.createDataFrame([(None, 0.99), (None, None), (1, None), (0, math.nan)], SCHEMA))


@pytest.mark.parametrize("metric", [
    evaluate.ranking_metrics, evaluate.brier, evaluate.roc_points, evaluate.pr_points, evaluate.reliability,
])
def test_rows_without_label_or_score_do_not_count(known, odd, metric):
    rows = lambda df: sorted(map(repr, metric(df, "score", "label").collect()))
    assert rows(odd) == rows(known)


def test_roc_keeps_the_first_threshold(known):
    # the steps of 0.9 and 0.8 are equal: 0.9 is inside a straight run from the corner, but the first one
    got = {r.threshold for r in evaluate.roc_points(known, "score", "label").collect()}
    assert got == {math.inf, 0.9, 0.8, 0.7, 0.4, 0.2}


def test_roc_leaves_out_the_middle_of_a_run(spark):
    rows = [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6)]
    got = {r.threshold for r in evaluate.roc_points(spark.createDataFrame(rows, SCHEMA), "score", "label").collect()}
    assert got == {math.inf, 0.9, 0.7, 0.6}


def test_split_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "id long, label int")
    assert prep.stratified_split(empty, "label", "id").count() == 0
