"""Seasonal-naive probabilistic forecasts and forecast tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.dates import shift
from .metrics import QUANTILES, quantile_column
from .splits import evaluation_cut


def seasonal_naive(
    panel: DataFrame, horizon: int, target: str, season: int = 12, quantiles: Sequence[float] = QUANTILES,
    extra: Sequence[float] = (), entity: str = "entity", date: str = "start_date",
) -> tuple[DataFrame, DataFrame]:
    """Forecast the last ``horizon`` steps of each series from the rest.

    The mean is the value one season earlier; quantiles add the quantiles of an entity's past
    seasonal changes. Returns the steps with their truth, and the history.
    """
    if horizon > season:
        raise ValueError("the horizon may not be longer than a season")
    cut = evaluation_cut(panel, horizon, entity, date)
    w = W.partitionBy(entity).orderBy(date)
    y = F.col(target).cast("double")
    lagged = cut.withColumns({"y": y, "mean": F.lag(y, season).over(w), "_n": F.row_number().over(w)})
    history = lagged.filter(F.col("part") == "history").drop("_n", "mean")
    changes = lagged.filter((F.col("part") == "history") & F.col("mean").isNotNull())
    probs = [*quantiles, *extra]
    spread = changes.groupBy(entity).agg(F.percentile(F.col("y") - F.col("mean"), probs).alias("_q"))
    first = lagged.filter(F.col("part") == "truth")
    step = (F.row_number().over(w) - 1).alias("step")
    steps = first.select(entity, date, step, "y", "mean").join(spread, entity, "left")
    columns = [(F.col("mean") + F.get("_q", F.lit(i))).alias(quantile_column(p)) for i, p in enumerate(probs)]
    return steps.select(entity, date, "step", "y", "mean", *columns), history


def residual_samples(
    steps: DataFrame, history: DataFrame, season: int = 12, entity: str = "entity", date: str = "start_date"
) -> DataFrame:
    """Forecast samples per entity: the mean path moved by each past seasonal change."""
    w = W.partitionBy(entity).orderBy(date)
    changed = history.withColumn("_d", F.col("y") - F.lag("y", season).over(w)).filter(F.col("_d").isNotNull())
    moves = changed.groupBy(entity).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(date, "_d"))), lambda x: x["_d"]).alias("_moves")
    )
    paths = steps.groupBy(entity).agg(
        F.min(date).alias("start_date"),
        F.transform(F.array_sort(F.collect_list(F.struct("step", "mean"))), lambda x: x["mean"]).alias("_path"),
    )
    shifted = F.transform("_moves", lambda d: F.transform(F.col("_path"), lambda m: m + d))
    return paths.join(moves, entity).select(entity, "start_date", shifted.alias("samples"))


def sample_means(forecasts: DataFrame, keys: Sequence[str], samples: str = "samples") -> DataFrame:
    """Mean over the samples, as one list per forecast."""
    n = F.size(F.col(samples))
    total = F.aggregate(
        F.slice(F.col(samples), 2, F.greatest(n - 1, F.lit(0))),
        F.get(F.col(samples), F.lit(0)),
        lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b),
    )
    return forecasts.select(*keys, F.transform(total, lambda x: x / n).alias("mean"))


def forecast_rows(
    forecasts: DataFrame, entity: str, start: str, means: str, model_id: str, task_id: str, unit: str = "month"
) -> DataFrame:
    """One row per forecast step with its date."""
    codes = {"month": "M", "week": "W", "day": "D"}
    return forecasts.select(
        F.lit(model_id).alias("model_id"),
        F.lit(task_id).alias("task_id"),
        F.col(entity).cast("string").alias("muni_id"),
        F.col(start).alias("start_date"),
        F.posexplode(means).alias("step", "mean"),
    ).select(
        "model_id", "task_id", "muni_id", "start_date",
        shift(F.col("start_date"), F.col("step"), unit).alias("predict_date"),
        F.col("step").cast("smallint").alias("step"),
        F.lit(codes[unit]).alias("time_unit"),
        "mean",
    )
