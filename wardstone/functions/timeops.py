"""Column expressions over zone-less timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS_PER_HOUR = 3.6e9
MICROS_PER_DAY = 8.64e10


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from ``start`` to ``end`` on the wall clock, in any session time zone."""
    seconds = (end - start).cast("interval second").cast("decimal(18,6)")
    return (seconds * F.lit(1_000_000)).cast("long")


def hours_between(start: Column, end: Column) -> Column:
    """Fractional hours, from whole microseconds so that no digit depends on the engine."""
    return micros_between(start, end) / F.lit(MICROS_PER_HOUR)


def days_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(MICROS_PER_DAY)


def shift(ts: Column, *, years: int = 0, days: int = 0, hours: float = 0) -> Column:
    """``ts`` moved by a fixed calendar or clock interval."""
    if years:
        ts = ts + F.make_ym_interval(F.lit(years))
    if days or hours:
        ts = ts + F.make_dt_interval(F.lit(days), F.lit(0), F.lit(0), F.lit(float(hours * 3600)))
    return ts


def in_window(ts: Column, anchor: Column, start: float | None, end: float | None, bounds: str = "[]") -> Column:
    """Is ``ts`` between ``anchor + start`` and ``anchor + end`` hours; ``None`` leaves that side open."""
    test = None
    if start is not None:
        edge = shift(anchor, hours=start)
        test = ts >= edge if bounds[0] == "[" else ts > edge
    if end is not None:
        edge = shift(anchor, hours=end)
        upper = ts <= edge if bounds[1] == "]" else ts < edge
        test = upper if test is None else test & upper
    return F.lit(True) if test is None else test


def age_at(anchor_age: Column, anchor_year: Column, ts: Column) -> Column:
    """Age in the year of ``ts`` of somebody who was ``anchor_age`` in ``anchor_year``."""
    return anchor_age + (F.year(ts) - anchor_year)


def night_flag(ts: Column, start_hour: int = 20, end_hour: int = 6) -> Column:
    return F.when((F.hour(ts) >= start_hour) | (F.hour(ts) < end_hour), 1).otherwise(0)


def died_between(death: Column, start: Column, end: Column) -> Column:
    return F.when(death.between(start, end), 1).otherwise(0)


def died_within(death: Column, anchor: Column, *, years: int = 0, days: int = 0) -> Column:
    """Died up to an interval after ``anchor``, deaths before the anchor included."""
    return F.when(death <= shift(anchor, years=years, days=days), 1).otherwise(0)
