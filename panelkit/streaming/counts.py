"""Fixed-length window counts over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_counts(
    events: DataFrame, entity: str, time: str, length: str, slide: str | None = None, late: str = "1 day",
    offset: str | None = None,
) -> DataFrame:
    """Counts per entity and window; works the same on a stream and on a batch.

    Weeks that start on Monday need ``offset="4 days"``, as windows count from a Thursday.
    """
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, length, slide or length, offset or "0 seconds")
    counted = timed.groupBy(entity, window.alias("w")).agg(F.count("*").alias("count"))
    return counted.select(entity, F.to_date("w.start").alias("start_date"), "count")


def monthly_counts(events: DataFrame, entity: str, time: str, late: str = "1 day") -> DataFrame:
    """Counts per calendar month for update mode; months are no fixed-length window."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    month = F.to_date(F.date_trunc("month", time)).alias("start_date")
    return timed.groupBy(entity, month).agg(F.count("*").alias("count"))
