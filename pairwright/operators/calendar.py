"""Business days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weekdays_between(start: Column, end: Column) -> Column:
    """All Mondays to Fridays from ``start`` to ``end``, both included, as an array."""
    days = F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))
    return F.filter(days, lambda d: F.weekday(d) < 5)


def first_weekdays(start: Column, days: int) -> Column:
    """The first ``days`` weekdays from ``start`` on, as an array."""
    # five weekdays fit in any seven days, so this many calendar days always suffice
    reach = (days // 5 + 1) * 7 + 2
    return F.slice(weekdays_between(start, F.date_add(start, reach)), 1, days)


def expected_runs(calendar: DataFrame, config, only: str | None = None) -> DataFrame:
    """Every source on every day: one row per run that should exist.

    ``calendar`` has a ``run_date`` column; the sources are a literal array, so the grid is an
    explode and not a join.
    """
    names = [s.name for s in config.only(only)]
    sources = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    return calendar.select(F.explode(sources).alias("source"), "run_date")
