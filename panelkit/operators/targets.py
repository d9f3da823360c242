"""Categorical targets and seasonal expectations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numeric import right_closed_bins
from .schema import drop_any_null

# Class limits of the simple targets, in cases per 100,000.
HIGH_RATE = 300.0
MODERATE_RATE = 100.0
# Shares of the seasonal median that end the low, moderate and high risk bands.
RISK_SHARES = {"low_max": 0.10, "moderate_max": 0.30, "high_max": 0.50}

Target = Callable[..., tuple[DataFrame, "DataFrame | None"]]


def expectations(df: DataFrame, keys: Sequence[str] = ("entity", "month"), target: str = "target") -> DataFrame:
    """Mean target per key, as sum over count."""
    return df.groupBy(*keys).agg((F.sum(target) / F.count(target)).alias("expected"))


def risk_bands(df: DataFrame, keys: Sequence[str] = ("entity", "month"), value: str = "cases_per_100k") -> DataFrame:
    """Seasonal median with the upper limits of the risk bands. A key holds one value per year."""
    grouped = df.groupBy(*keys).agg(F.median(value).alias(value))
    return grouped.withColumns({name: F.col(value) * F.lit(share) for name, share in RISK_SHARES.items()})


def apply_expectations(df: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join: rows whose key was never seen drop out. Expectations by month alone are twelve rows."""
    side = F.broadcast(expected) if tuple(keys) == ("month",) else expected
    return df.join(side, list(keys), "inner")


def _with_expected(df: DataFrame, expected: DataFrame | None, keys: Sequence[str], target: str, entity: str):
    """Rows with ``expected``, and the expectations for later data.

    A key that holds the entity has one row per year, so its own expectation comes from a window
    and the rows are computed once. Coarser keys are aggregated first and joined.
    """
    if expected is not None:
        return apply_expectations(df, expected, keys), expected
    made = expectations(df, keys, target)
    if entity not in keys:
        return apply_expectations(df, made, keys), made
    w = W.partitionBy(*keys)
    mean = F.sum(target).over(w) / F.count(target).over(w)
    return drop_any_null(df, list(keys)).withColumn("expected", mean), made


def simple_binary(df: DataFrame, expected: DataFrame | None = None, keys: Sequence[str] = (), target: str = "target"):
    return df.withColumn("cat_target", right_closed_bins(F.col(target), [HIGH_RATE], ["0", "1"])), None


def simple_ternary(df: DataFrame, expected: DataFrame | None = None, keys: Sequence[str] = (), target: str = "target"):
    bins = right_closed_bins(F.col(target), [MODERATE_RATE, HIGH_RATE], ["0", "1", "2"])
    return df.withColumn("cat_target", bins), None


def relative_binary(
    df: DataFrame, expected: DataFrame | None = None, keys: Sequence[str] = ("entity", "month"), target: str = "target",
    entity: str = "entity",
):
    """``1`` above the seasonal expectation. Returns the expectations for use on later data."""
    rows, expected = _with_expected(df, expected, keys, target, entity)
    label = F.when(F.col(target) > F.col("expected"), F.lit("1")).otherwise(F.lit("0"))
    return rows.withColumn("cat_target", label).drop("expected"), expected


def relative_ternary(
    df: DataFrame, expected: DataFrame | None = None, keys: Sequence[str] = ("entity", "month"), target: str = "target",
    entity: str = "entity",
):
    """``0`` up to half of the expectation, ``1`` up to the expectation, ``2`` above."""
    rows, expected = _with_expected(df, expected, keys, target, entity)
    value, mean = F.col(target), F.col("expected")
    label = F.when(value <= mean * 0.5, F.lit("0")).when(value <= mean, F.lit("1")).otherwise(F.lit("2"))
    return rows.withColumn("cat_target", label).drop("expected"), expected


def target_registry() -> dict[str, Target]:
    return {
        "relative_ternary": relative_ternary,
        "relative_binary": relative_binary,
        "simple_binary": simple_binary,
        "simple_ternary": simple_ternary,
    }


def label_splits(
    train: DataFrame, test: DataFrame, style: str, keys: Sequence[str] = ("entity", "month"), target: str = "target"
) -> tuple[DataFrame, DataFrame]:
    """Label both splits; the test rows only ever see expectations made from the training rows."""
    make = target_registry()[style]
    labelled, expected = make(train, None, keys, target)
    return labelled, make(test, expected, keys, target)[0]
