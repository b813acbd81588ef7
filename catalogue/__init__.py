"""Queries over the given tables, each with an independent SQL statement of the same result."""

from catalogue import (  # noqa: F401
    cohort_queries, evaluation_queries, feature_queries, model_queries, prep_queries,
)
from catalogue.registry import QUERIES, SQL


def all_queries():
    return dict(QUERIES)


def all_sql():
    return dict(SQL)
