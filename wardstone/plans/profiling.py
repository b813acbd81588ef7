"""A first look at an analytic table: shape, the columns a study depends on, their values, the leading columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wardstone.operators import profile
from wardstone.plans import rulebook as rules

# What the report looks for.
RACE_PARTS = ("race", "ethnic")
DEMOGRAPHIC_PARTS = ("age", "sex", "gender", "insurance", "marital")
CHECKED_FLAGS = ("dementia_icd", rules.TARGET)
SIMILAR_PARTS = ("dement",)


def report(df: DataFrame) -> dict[str, DataFrame]:
    """The parts of the report that the table's columns allow, each built lazily."""
    out = {
        "shape": profile.shape(df),
        "flags": profile.flag_totals(df, CHECKED_FLAGS),
        "leading_columns": profile.first_columns(df),
    }
    race = profile.find_columns(df, RACE_PARTS)
    if race:
        out["race_values"] = profile.frequencies(df, race)
    else:
        out["demographic_columns"] = profile.first_columns(df.select(*profile.find_columns(df, DEMOGRAPHIC_PARTS)))
    similar = profile.find_columns(df, SIMILAR_PARTS)
    if CHECKED_FLAGS[0] not in df.columns and similar:
        out["similar_columns"] = profile.first_columns(df.select(*similar))
    return out
