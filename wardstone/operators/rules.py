"""Rule tables: plain data that the operators spell as Spark SQL expressions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

@dataclass(frozen=True)
class FeatureRule:
    """One output column of a windowed pivot.

    ``agg`` is one of max, min, avg, sum, stddev, count, any. ``items`` are the item ids that feed the feature,
    ``window`` is ``(from, to)`` in hours after the anchor (``None`` for all rows of the entity), ``valid`` a closed
    range of plausible values, ``where`` a further test ``(op, cut)`` on the value or SQL text over the event's columns,
    ``convert`` maps item ids to SQL text that brings their value ``{v}`` to the common unit, ``digits`` rounds the
    result, ``none_if_empty`` turns a count of zero into NULL.
    """

    name: str
    agg: str
    items: tuple = ()
    window: tuple[float | None, float | None] | None = None
    valid: tuple[float, float] | None = None
    where: tuple[str, float] | str | None = None
    convert: Mapping[Any, str] = field(default_factory=dict)
    digits: int | None = None
    none_if_empty: bool = False


@dataclass(frozen=True)
class CodeRule:
    """A flag raised by a code that starts with a prefix, equals a code or lies in a ``[low, high)`` string range.

    ``version`` restricts the rule to rows of one coding version; ``None`` takes all rows.
    """

    flag: str
    prefixes: tuple[str, ...] = ()
    codes: tuple[str, ...] = ()
    ranges: tuple[tuple[str, str], ...] = ()
    version: int | None = None


@dataclass(frozen=True)
class TextClass:
    value: Any
    contains: tuple[str, ...] = ()
    equals: tuple[str, ...] = ()


@dataclass(frozen=True)
class OrdinalRule:
    """An ordinal score: the points of the first step ``(column, op, cut, points)`` that holds, else ``otherwise``."""

    name: str
    steps: tuple[tuple[str, str, float, int], ...]
    otherwise: int = 0


@dataclass(frozen=True)
class ThresholdRule:
    flag: str
    tests: tuple[tuple[str, str, float], ...]
