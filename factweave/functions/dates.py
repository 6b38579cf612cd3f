"""Calendar columns: the same weeks as factweave.plans.calendar, for any date column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(day: Column) -> Column:
    """The Sunday that opens the week (date_trunc's weeks open on Monday)."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def week_end(day: Column) -> Column:
    return F.date_add(week_start(day), 6)


def last_complete_day(as_of: Column) -> Column:
    return F.date_sub(as_of, 1)


def review_week_start(as_of: Column) -> Column:
    """Start of the last week that ended before ``as_of``."""
    latest = last_complete_day(as_of)
    return F.when(F.dayofweek(latest) == 7, week_start(latest)).otherwise(F.date_sub(week_start(latest), 7))


def partial_week_start(as_of: Column) -> Column:
    """Start of the running week, or null when ``as_of`` is a Sunday."""
    latest = last_complete_day(as_of)
    return F.when(F.dayofweek(latest) != 7, week_start(latest))


def prior_week_starts(start: Column, n: int) -> Column:
    """Array of the starts of ``n`` weeks before, the latest first."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.date_sub(start, (i * 7).cast("int")))


def days_of(start: Column, end: Column) -> Column:
    return F.sequence(start, end)


def n_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1
