"""Calendar aggregation, densifying and calendar spines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.dates import period_start, shift
from ..functions.numeric import rate_per


def count_by_period(
    events: DataFrame,
    unit: str,
    entity: str = "entity",
    date: str = "event_date",
    period: str = "start_date",
    first: Sequence[str] = (),
    order: Sequence[str] = (),
    aggs: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Events per entity and calendar period.

    ``first`` columns take the value of the earliest event, ties broken by ``order``. Only
    mergeable aggregates are used, so each map task sends one row per entity and period however
    many events an entity has.
    """
    keyed = events.withColumn(period, period_start(F.col(date), unit))
    columns = [F.count("*").alias("count")]
    rank = F.struct(date, *order, *[c for c in first if c not in order])
    columns += [F.min_by(F.col(c), rank).alias(c) for c in first]
    columns += [expr.alias(name) for name, expr in (aggs or {}).items()]
    return keyed.groupBy(entity, period).agg(*columns)


def add_rate(panel: DataFrame, count: str = "count", population: str = "pop", name: str = "cases_per_100k") -> DataFrame:
    return panel.withColumn(name, rate_per(F.col(count), F.col(population)))


def sliding_counts(
    events: DataFrame, months: int = 1, entity: str = "entity", date: str = "event_date", period: str = "start_date"
) -> DataFrame:
    """Events in ``[d, d + months)`` for every day ``d`` from an entity's first to last event day.

    Events are counted per day first. Each event day holds the days that may share a window with it, at most
    31 * ``months``, and makes the windows whose first event day it is: those that start after the event day before.
    So each window is made once, in a task that holds the days of one entity at a time. Windows without events are left out.
    """
    daily = events.filter(F.col(date).isNotNull()).groupBy(entity, F.col(date).alias("_day")).agg(F.count("*").alias("_n"))
    by_day = W.partitionBy(entity).orderBy(F.unix_date("_day"))
    ahead = F.collect_list(F.struct("_day", "_n")).over(by_day.rangeBetween(0, 31 * months - 1))
    lined = daily.select(entity, "_day", ahead.alias("_ahead"), F.lag("_day").over(by_day).alias("_before"))
    first = F.greatest(F.date_sub("_day", 31 * months - 1), F.coalesce(F.date_add("_before", 1), F.col("_day")))
    started = lined.select(entity, "_day", "_ahead", F.explode(F.sequence(first, F.col("_day"))).alias(period))
    end = F.add_months(F.col(period), months)
    inside = F.filter("_ahead", lambda x: x["_day"] < end)
    count = F.aggregate(inside, F.lit(0).cast("long"), lambda total, x: total + x["_n"])
    return started.filter(F.col("_day") < end).select(entity, period, count.alias("count"))


def periods_present(df: DataFrame, period: str = "start_date") -> Column:
    """Sorted list of the periods in ``df`` as a scalar subquery; its length is bounded by the calendar."""
    return df.agg(F.array_sort(F.collect_set(period))).scalar()


def full_calendar(first: str, last: str, unit: str = "month") -> Column:
    """Every period from ``first`` to ``last``, both included."""
    return F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr(f"interval 1 {unit}"))


def densify(
    panel: DataFrame,
    entities: DataFrame,
    fill: Mapping[str, object],
    periods: Column | None = None,
    entity: str = "entity",
    period: str = "start_date",
) -> DataFrame:
    """Add the missing (entity, period) rows with ``fill`` values.

    Periods are those present in the panel, or the list given in ``periods``. Each entity expands
    its own list, so no cross join is planned.
    """
    wanted = periods_present(panel, period) if periods is None else periods
    spine = entities.select(entity).distinct().withColumn(period, F.explode(wanted))
    joined = spine.join(panel, [entity, period], "full")
    types = {f.name: f.dataType for f in panel.schema.fields}
    filled = {name: F.coalesce(F.col(name), F.lit(value).cast(types[name])) for name, value in fill.items()}
    return joined.withColumns(filled).select(*panel.columns)


def unpivot_years(wide: DataFrame, entity: str, years: Sequence[int], value: str = "pop") -> DataFrame:
    """Wide yearly columns to one row per entity and year."""
    long = wide.unpivot(entity, [str(y) for y in years], "year", value)
    return long.withColumn("year", F.col("year").cast("int"))


def upsample_daily(df: DataFrame, entity: str = "entity", date: str = "start_date") -> DataFrame:
    """One row per entity and day between its first and last date; new rows are null elsewhere."""
    limits = df.groupBy(entity).agg(F.min(date).alias("_first"), F.max(date).alias("_last"))
    spine = limits.select(entity, F.explode(F.sequence("_first", "_last")).alias(date))
    return spine.join(df, [entity, date], "left")


def chunk_ranges(df: DataFrame, start: str, end: str, n: int, unit: str = "month") -> DataFrame:
    """Split ``[start, end)`` of every row into chunks of ``n`` units, the last one shorter."""
    step = F.expr(f"interval {n} {unit}")
    inside = df.filter(F.col(start) < F.col(end))
    spread = inside.withColumn(
        "chunk_start", F.explode(F.filter(F.sequence(F.col(start), F.col(end), step), lambda x: x < F.col(end)))
    )
    return spread.withColumn("chunk_end", F.least(shift(F.col("chunk_start"), n, unit), F.col(end)))


def explode_units(df: DataFrame, start: str, end: str, unit: str = "month") -> DataFrame:
    """One row per unit of ``[start, end)`` with its own start, end and 0-based number."""
    inside = df.filter(F.col(start) < F.col(end))
    step = F.expr(f"interval 1 {unit}")
    days = F.filter(F.sequence(F.col(start), F.col(end), step), lambda x: x < F.col(end))
    spread = inside.select("*", F.posexplode(days).alias("unit_no", "unit_start"))
    return spread.withColumn("unit_end", shift(F.col("unit_start"), 1, unit))


def missing_datasets(expected: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Every expected dataset with the status ``complete`` or ``missing``."""
    have = found.select(name).distinct().withColumn("_found", F.lit(True))
    return expected.join(have, name, "left").select(
        name, F.when(F.col("_found"), F.lit("complete")).otherwise(F.lit("missing")).alias("status")
    )
