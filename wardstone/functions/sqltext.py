"""Spelling rule tables as Spark SQL text: one parsed expression per rule instead of hundreds of column objects."""

from __future__ import annotations

from collections.abc import Sequence
from math import isfinite

from pyspark.sql import Column, functions as F


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D" if isfinite(value) else f"double('{value}')"
    return str(int(value))


def member(expression: str, values: Sequence) -> str:
    if len(values) == 1:
        return f"{expression} = {literal(values[0])}"
    return f"{expression} IN ({', '.join(literal(v) for v in values)})"


def either(tests: Sequence[str]) -> str:
    return "(" + " OR ".join(tests) + ")"


def every(tests: Sequence[str]) -> str:
    return "(" + " AND ".join(tests) + ")" if tests else "TRUE"


def flag(test: str) -> str:
    return f"CASE WHEN {test} THEN 1 ELSE 0 END"


def cases(steps: Sequence[tuple[str, object]], otherwise) -> str:
    """``CASE`` over (test, value) steps in order."""
    body = " ".join(f"WHEN {test} THEN {literal(value)}" for test, value in steps)
    return f"CASE {body} ELSE {literal(otherwise)} END"


def column(text: str, alias: str | None = None) -> Column:
    out = F.expr(text)
    return out.alias(alias) if alias else out


def number_or_null(c: str) -> str:
    """Column ``c`` as a double; NaN counts as missing."""
    return f"nullif(CAST({name(c)} AS DOUBLE), CAST('NaN' AS DOUBLE))"
