"""Pixel composites, zonal statistics, fixed-bin histograms and lookback features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .joins import salted_join
from .ranking import exact_quantiles


def in_box(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows inside (min x, min y, max x, max y), edges included."""
    return df.filter(F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3]))


def composite(pixels: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median per pixel and period, exact for any number of images."""
    return exact_quantiles(pixels, keys, value, {"median": 0.5})


def zonal_mean(pixels: DataFrame, keys: Sequence[str], value: str, weight: str, count: str | None = None) -> DataFrame:
    """Weighted mean of the values; with ``count`` a row stands for that many and ``value`` is their sum (``image_sums``)."""
    x, w = F.col(value), F.col(weight)
    n = w if count is None else w * F.col(count)
    return pixels.filter(x.isNotNull()).groupBy(*keys).agg(F.try_divide(F.sum(w * x), F.sum(n)).alias("mean"))


def image_sums(pixels: DataFrame, keys: Sequence[str], value: str, count: str = "images") -> DataFrame:
    """One row per pixel and period with the sum and the number of its known values, for zones that share pixels."""
    known = pixels.filter(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(F.sum(value).alias(value), F.count("*").alias(count))


def zonal_median(pixels: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """First value whose running weight reaches half of the total weight."""
    return exact_quantiles(pixels, keys, value, {"median": 0.5}, weight=weight)


def add_period_weight(
    pixels: DataFrame, yearly: DataFrame, keys: Sequence[str], period: str, weight: str, spread_on: Sequence[str] = ()
) -> DataFrame:
    """Join the yearly table on the year of the period; with ``spread_on`` hot keys are salted."""
    dated = pixels.withColumn("year", F.year(period))
    table = yearly.select(*keys, "year", weight)
    if spread_on:
        return salted_join(dated, table, [*keys, "year"], spread_on, how="left")
    return dated.join(table, [*keys, "year"], "left")


def fixed_histogram(
    df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, steps: int, suffix: str = ""
) -> DataFrame:
    """Counts in ``steps`` equal bins of ``[low, high)`` as columns ``1{suffix}`` ..; values outside count nowhere."""
    at = F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(steps))
    return df.groupBy(*keys).agg(*[F.count(F.when(at == k, 1)).alias(f"{k}{suffix}") for k in range(1, steps + 1)])


def lookback_histogram(
    records: DataFrame, series: DataFrame, keys: Sequence[str], record_date: str, series_date: str, value: str,
    days: int, low: float, high: float, steps: int, suffix: str = "",
) -> DataFrame:
    """Histogram of the series in ``[date - days, date)`` for every (key, date) of the records.

    The series is counted per key, day and bin first. Each distinct (key, date) of the records
    expands to its ``days`` days and meets the counts on equal keys, so neither a hot key nor many
    records on one date make a large group.
    """
    daily = fixed_histogram(
        series.withColumn("_day", F.col(series_date)), [*keys, "_day"], value, low, high, steps, suffix
    )
    names = [f"{k}{suffix}" for k in range(1, steps + 1)]
    wanted = records.select(*keys, record_date).distinct()
    window = wanted.withColumn(
        "_day", F.explode(F.sequence(F.date_sub(record_date, days), F.date_sub(record_date, 1)))
    )
    return (
        window.join(daily, [*keys, "_day"], "left")
        .groupBy(*keys, record_date)
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    )


def presence_records(presence: DataFrame, absence: DataFrame, days: int, date: str = "date") -> DataFrame:
    """Presence rows (1) and absence rows (0) with the start of their lookback window."""
    both = presence.withColumn("presence", F.lit(1)).unionByName(absence.withColumn("presence", F.lit(0)))
    return both.withColumn("back_date", F.date_sub(date, days))
