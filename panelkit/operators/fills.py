"""Gap filling by window. Every frame is one entity's own periods, bounded by the calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F


def interpolate(df: DataFrame, value: str, keys: Sequence[str], order: str) -> DataFrame:
    """Linear interpolation of inner gaps by row position."""
    w = W.partitionBy(*keys).orderBy(order)
    before, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    marked = df.withColumn("_pos", F.row_number().over(w)).withColumn(
        "_known", F.when(F.col(value).isNotNull(), F.struct(F.col("_pos"), F.col(value).cast("double").alias("v")))
    )
    around = marked.withColumns(
        {
            "_left": F.last("_known", ignorenulls=True).over(before),
            "_right": F.first("_known", ignorenulls=True).over(after),
        }
    )
    left, right = F.col("_left"), F.col("_right")
    between = left["v"] + (right["v"] - left["v"]) * (F.col("_pos") - left["_pos"]) / (right["_pos"] - left["_pos"])
    return around.withColumn(
        value, F.when(F.col(value).isNotNull(), F.col(value).cast("double")).otherwise(between)
    ).drop("_pos", "_known", "_left", "_right")


def backward_fill(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(0, W.unboundedFollowing)
    return df.withColumns({c: F.first(c, ignorenulls=True).over(w) for c in columns})


def forward_fill(df: DataFrame, keys: Sequence[str], order: str, but: Sequence[str] = ()) -> DataFrame:
    """Forward fill of all columns except the keys, the order and ``but``."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    names = [c for c in df.columns if c not in {*keys, order, *but}]
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in names})


def fill_exposure(long: DataFrame, entity: str = "entity", year: str = "year", value: str = "pop") -> DataFrame:
    """Interpolate inner gaps and extend the first known value backwards; later years stay null."""
    return backward_fill(interpolate(long, value, [entity], year), [value], [entity], year)
