"""Date column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNITS = ("day", "week", "month", "year")


def period_start(day: Column, unit: str) -> Column:
    """First day of the calendar period; weeks start on Monday."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    return day.cast("date") if unit == "day" else F.to_date(F.date_trunc(unit, day))


def shift(day: Column, n: int | Column, unit: str) -> Column:
    """Move by ``n`` units; months and years keep to the last day of a shorter month."""
    n = F.lit(n) if isinstance(n, int) else n
    if unit == "month":
        return F.add_months(day, n)
    if unit == "year":
        return F.add_months(day, n * 12)
    return F.date_add(day, n * (7 if unit == "week" else 1))


def month_index(day: Column) -> Column:
    """Months since year 0, for RANGE frames over months."""
    return F.year(day) * F.lit(12) + F.month(day)


def from_ymd(year: Column, month: Column, day: Column) -> Column:
    return F.make_date(year, month, day)


def units_between(end: Column, start: Column, unit: str, approximate: bool = False) -> Column:
    """Whole units from ``start`` to ``end``.

    ``approximate`` counts weeks as 52 per year, 4 per month and 1 per 7 remaining days.
    """
    months = F.floor(F.months_between(end, start)).cast("int")
    if unit == "month":
        return months
    if unit == "day":
        return F.datediff(end, start)
    if unit != "week":
        raise ValueError("unit must be day, week or month")
    if not approximate:
        return F.floor(F.datediff(end, start) / 7).cast("int")
    years = F.floor(months / 12)
    rest = F.floor(F.datediff(end, F.add_months(start, months)) / 7)
    return (years * 52 + (months - years * 12) * 4 + rest).cast("int")
