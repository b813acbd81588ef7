"""Windowed features: a whole rule table over one event table, in one scan and one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wardstone.functions import sqltext
from wardstone.functions.numbers import round_half_away
from wardstone.functions.sqltext import literal, name
from wardstone.functions.timeops import in_window
from wardstone.operators.rules import FeatureRule

AGGREGATES = {"max": "max", "min": "min", "avg": "avg", "sum": "sum", "stddev": "stddev_samp"}


def within_window(
    events: DataFrame,
    anchors: DataFrame,
    on: str | Sequence[str],
    time: str,
    anchor_time: str,
    start: float | None,
    end: float | None,
    bounds: str = "[]",
) -> DataFrame:
    """Inner join on ``on`` that keeps events from ``anchor + start`` to ``anchor + end`` hours."""
    return events.join(anchors, on).where(in_window(F.col(time), F.col(anchor_time), start, end, bounds))


def _hull(rules: Sequence[FeatureRule]) -> tuple[float | None, float | None] | None:
    """The smallest window that covers all rules, ``None`` if some rule is unbounded."""
    windows = [r.window for r in rules]
    if any(w is None for w in windows):
        return None
    lows, highs = [w[0] for w in windows], [w[1] for w in windows]
    return (None if None in lows else min(lows), None if None in highs else max(highs))


def _measure(rule: FeatureRule, item: str | None, value: str | None) -> str:
    if not rule.convert:
        return name(value)
    said = [(m, rule.convert.get(m, "{v}").format(v=name(value))) for m in rule.items]
    return f"CASE {name(item)} " + " ".join(f"WHEN {literal(m)} THEN {text}" for m, text in said) + " END"


def _feature(rule: FeatureRule, item: str | None, value: str | None, windows: dict) -> Column:
    tests = []
    if rule.items:
        tests.append(sqltext.member(name(item), rule.items))
    if rule.window in windows:
        tests.append(windows[rule.window])
    if rule.valid:
        tests.append(f"{name(value)} BETWEEN {literal(rule.valid[0])} AND {literal(rule.valid[1])}")
    if isinstance(rule.where, str):
        tests.append(rule.where)
    elif rule.where:
        tests.append(f"{name(value)} {rule.where[0]} {literal(rule.where[1])}")
    test = sqltext.every(tests)

    if rule.agg == "any":
        return sqltext.column(f"max({sqltext.flag(test)})", rule.name)
    if rule.agg == "count":
        text = f"count(CASE WHEN {test} THEN 1 END)"
        return sqltext.column(f"nullif({text}, 0L)" if rule.none_if_empty else text, rule.name)
    picked = _measure(rule, item, value)
    if tests:
        picked = f"CASE WHEN {test} THEN {picked} END"
    out = sqltext.column(f"{AGGREGATES[rule.agg]}({picked})")
    return (out if rule.digits is None else round_half_away(out, rule.digits)).alias(rule.name)


def windowed_features(
    events: DataFrame,
    anchors: DataFrame | None,
    rules: Sequence[FeatureRule],
    *,
    on: str | None = None,
    entity: str,
    time: str | None = None,
    anchor_time: str | None = None,
    item: str | None = None,
    value: str | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per entity that has a row in the union of the rule windows, one column per rule.

    The item lists of all rules become one ``IN`` filter at the scan, only the columns the rules use are read, the
    window test is part of the join, and all rules share one partial and one final aggregation.
    ``on`` may be coarser than ``entity``; an event then counts for every anchor whose window holds it.
    ``carry`` names further event columns that ``where`` texts look at.
    """
    if item and all(r.items for r in rules):
        wanted = sorted({i for r in rules for i in r.items})
        events = events.where(sqltext.member(name(item), wanted))
    columns = [c for c in dict.fromkeys([on or entity, item, time, value, *carry]) if c]
    events = events.select(*columns)
    if value and all(r.agg not in ("any", "count") or r.valid for r in rules):
        events = events.where(F.col(value).isNotNull())
    if anchors is None:
        return events.groupBy(entity).agg(*[_feature(r, item, value, {}) for r in rules])

    hull = _hull(rules)
    joined = within_window(events, anchors, on, time, anchor_time, *(hull or (None, None)))
    flags = {}
    for window in windows_of(rules):
        if window is not None and window != hull:
            flags[window] = f"_w{len(flags)}"
            joined = joined.withColumn(
                flags[window], in_window(F.col(time), F.col(anchor_time), window[0], window[1])
            )
    if flags:
        # Rows outside the window of every rule that reads their item need not reach the aggregation.
        joined = joined.where(sqltext.either([_reached(rules, w, item, flags) for w in windows_of(rules)]))
    return joined.groupBy(entity).agg(*[_feature(r, item, value, flags) for r in rules])


def windowed_entities(
    events: DataFrame,
    anchors: DataFrame,
    rules: Sequence[FeatureRule],
    *,
    on: str,
    entity: str,
    time: str,
    anchor_time: str,
    item: str | None = None,
    value: str | None = None,
) -> DataFrame:
    """The entities that have a row in ``windowed_features``, without its columns: of bounded windows only keys and times
    move, of unbounded ones keys that are made distinct before."""
    if value and all(r.agg not in ("any", "count") or r.valid for r in rules):
        events = events.where(F.col(value).isNotNull())
    found = None
    for window in windows_of(rules):
        rows = events.where(_reached(rules, window, item, {}))
        if window is None:
            seen = rows.select(on).distinct().join(anchors.select(*dict.fromkeys([on, entity])), on)
        else:
            seen = within_window(rows.select(on, time), anchors, on, time, anchor_time, *window)
        seen = seen.select(entity)
        found = seen if found is None else found.union(seen)
    return found.distinct()


def windows_of(rules: Sequence[FeatureRule]) -> list:
    return list(dict.fromkeys(r.window for r in rules))


def _reached(rules: Sequence[FeatureRule], window, item: str | None, flags: dict) -> str:
    members = [r for r in rules if r.window == window]
    tests = [flags[window]] if window in flags else []
    if item and all(r.items for r in members):
        tests.append(sqltext.member(name(item), sorted({i for r in members for i in r.items})))
    return sqltext.every(tests)
