"""Classification and forecast metrics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage
from ..functions.numeric import safe_div

QUANTILES = (0.1, 0.5, 0.9)


def quantile_column(p: float) -> str:
    return f"q_{p:g}".replace(".", "_")


def _suffix(p: float) -> str:
    return f"{p:g}".replace(".", "_") + "_"


def regression_scores(df: DataFrame, keys: Sequence[str], truth: str, pred: str) -> DataFrame:
    """RMSE and R2 per group."""
    y, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    sums = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum((p - y) * (p - y)).alias("_sse"), F.sum(y).alias("_sy"), F.sum(y * y).alias("_syy")
    )
    sst = F.col("_syy") - F.col("_sy") * F.col("_sy") / F.col("n")
    return sums.select(
        *keys, "n", F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.col("_sse"), sst)).alias("r2"),
    )


def confusion(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts for every (truth, predicted) pair of the classes that occur, zeros included."""
    counts = df.groupBy(*keys, F.col(truth).alias("truth"), F.col(pred).alias("predicted")).agg(
        F.count("*").alias("n")
    )
    counts = cut_lineage(counts, "confusion")  # a row for each pair of classes; the rows themselves are read once
    labels = counts.select(F.explode(F.array("truth", "predicted")).alias("c")).agg(F.array_sort(F.collect_set("c"))).scalar()
    groups = counts.select(*keys).distinct() if keys else df.sparkSession.range(1)
    spine = groups.select(*keys, F.explode(labels).alias("truth")).withColumn("predicted", F.explode(labels))
    return spine.join(counts, [*keys, "truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_report(matrix: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a denominator is 0."""
    stacked = matrix.select(
        *keys, "n", "truth", "predicted", F.explode(F.array_distinct(F.array("truth", "predicted"))).alias("class")
    )
    n = F.col("n")
    sums = stacked.groupBy(*keys, "class").agg(
        F.sum(F.when((F.col("truth") == F.col("class")) & (F.col("predicted") == F.col("class")), n).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("predicted") == F.col("class"), n).otherwise(0)).alias("n_predicted"),
        F.sum(F.when(F.col("truth") == F.col("class"), n).otherwise(0)).alias("support"),
    )
    zero = F.lit(0.0)
    return sums.withColumns(
        {
            "precision": F.coalesce(safe_div(F.col("tp"), F.col("n_predicted")), zero),
            "recall": F.coalesce(safe_div(F.col("tp"), F.col("support")), zero),
            "f1": F.coalesce(safe_div(F.col("tp") * 2, F.col("n_predicted") + F.col("support")), zero),
        }
    )


def report_averages(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro and weighted averages, and balanced accuracy over the classes with support."""
    used = (F.col("support") > 0) | (F.col("n_predicted") > 0)
    live = report.filter(used)
    weigh = lambda c: safe_div(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    return live.groupBy(*keys).agg(
        safe_div(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("f1_macro"),
        weigh("precision").alias("weighted_precision"),
        weigh("recall").alias("weighted_recall"),
        weigh("f1").alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.sum("support").alias("support"),
    )


def class_weights(df: DataFrame, label: str, keys: Sequence[str] = (), name: str = "weight") -> DataFrame:
    """Balanced weight n / (classes * count) on every row.

    Without keys the few class weights travel as one scalar map, so the rows are not shuffled.
    """
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    weights = counts.select(
        *keys, label, (F.sum("_c").over(w) / (F.count("*").over(w) * F.col("_c"))).alias(name)
    )
    if keys:
        return df.join(weights, [*keys, label])
    table = weights.agg(F.map_from_entries(F.collect_list(F.struct(label, name)))).scalar()
    return df.withColumn(name, F.try_element_at(table, F.col(label)))


def seasonal_error(history: DataFrame, target: str, keys: Sequence[str], season: int = 12, date: str = "start_date"):
    """Mean absolute change against the value ``season`` steps earlier, per series."""
    w = W.partitionBy(*keys).orderBy(date)
    y = F.col(target).cast("double")
    change = history.withColumn("_d", F.abs(y - F.lag(y, season).over(w)))
    return change.groupBy(*keys).agg(F.avg("_d").alias("seasonal_error"))


def item_metrics(
    steps: DataFrame, season: DataFrame, keys: Sequence[str] = ("entity",), truth: str = "y", mean: str = "mean",
    median: str = "q_0_5", quantiles: Sequence[float] = QUANTILES, interval: tuple[str, str] | None = None,
    alpha: float = 0.05,
) -> DataFrame:
    """Forecast metrics per item from one row per forecast step.

    ``interval`` names the lower and upper columns of the 1 - ``alpha`` interval for MSIS.
    """
    y, m, mu = F.col(truth).cast("double"), F.col(median), F.col(mean)
    err, size = F.abs(y - m), F.abs(y)
    aggs: list[Column] = [
        F.avg((y - mu) * (y - mu)).alias("MSE"),
        F.sum(err).alias("abs_error"),
        F.sum(size).alias("abs_target_sum"),
        F.avg(size).alias("abs_target_mean"),
        F.avg(err).alias("_mae"),
        F.avg(F.try_divide(err, size)).alias("MAPE"),
        F.avg(F.try_divide(err * 2, size + F.abs(m))).alias("sMAPE"),
    ]
    if interval:
        lo, hi = F.col(interval[0]), F.col(interval[1])
        over = F.when(y < lo, lo - y).otherwise(F.lit(0.0)) + F.when(y > hi, y - hi).otherwise(F.lit(0.0))
        aggs.append(F.avg(hi - lo + F.lit(2.0 / alpha) * over).alias("_width"))
    for p in quantiles:
        q = F.col(quantile_column(p))
        below = F.when(y <= q, 1.0).otherwise(0.0)
        aggs.append((F.sum(F.abs((y - q) * (below - F.lit(p)))) * 2).alias(f"QuantileLoss_{_suffix(p)}"))
        aggs.append(F.avg(F.when(y < q, 1.0).otherwise(0.0)).alias(f"Coverage_{_suffix(p)}"))
    base = steps.groupBy(*keys).agg(*aggs).join(season, list(keys), "left")
    out = base.withColumns(
        {
            "MASE": F.try_divide(F.col("_mae"), F.col("seasonal_error")),
            "ND": F.try_divide(F.col("abs_error"), F.col("abs_target_sum")),
            "MSIS": F.try_divide(F.col("_width"), F.col("seasonal_error")) if interval else F.lit(None).cast("double"),
        }
    )
    return out.drop("_mae", "_width")


def agg_metrics(
    items: DataFrame, keys: Sequence[str] = (), quantiles: Sequence[float] = QUANTILES,
    naive: tuple[float, float] | None = None,
) -> DataFrame:
    """Metrics over all items, or per group of items. ``naive`` gives the baseline's (sMAPE, MASE) for OWA."""
    summed = ["abs_error", "abs_target_sum", *[f"QuantileLoss_{_suffix(p)}" for p in quantiles]]
    averaged = [
        "MSE", "abs_target_mean", "seasonal_error", "MASE", "MAPE", "sMAPE", "MSIS",
        *[f"Coverage_{_suffix(p)}" for p in quantiles],
    ]
    base = items.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in summed], *[F.avg(c).alias(c) for c in averaged]
    )
    losses = [f"QuantileLoss_{_suffix(p)}" for p in quantiles]
    more = {
        "RMSE": F.sqrt("MSE"),
        "NRMSE": F.try_divide(F.sqrt("MSE"), F.col("abs_target_mean")),
        "ND": F.try_divide(F.col("abs_error"), F.col("abs_target_sum")),
        "mean_absolute_QuantileLoss": sum((F.col(c) for c in losses), F.lit(0.0)) / len(losses),
        "MAE_Coverage": sum((F.abs(F.col(f"Coverage_{_suffix(p)}") - F.lit(p)) for p in quantiles), F.lit(0.0))
        / len(quantiles),
    }
    for p in quantiles:
        more[f"wQuantileLoss_{_suffix(p)}"] = F.try_divide(F.col(f"QuantileLoss_{_suffix(p)}"), F.col("abs_target_sum"))
    weighted = [F.try_divide(F.col(c), F.col("abs_target_sum")) for c in losses]
    more["mean_wQuantileLoss"] = sum(weighted, F.lit(0.0)) / len(losses)
    if naive:
        more["OWA"] = (F.col("sMAPE") / F.lit(naive[0]) + F.col("MASE") / F.lit(naive[1])) / 2
    else:
        more["OWA"] = F.lit(None).cast("double")
    return base.withColumns(more)


def compare_runs(with_extra: DataFrame, without: DataFrame, keys: Sequence[str], metric: str = "rmse") -> DataFrame:
    """Metric without the extra feature less the metric with it, per key."""
    a = with_extra.select(*keys, F.col(metric).alias("with_extra"))
    b = without.select(*keys, F.col(metric).alias("without_extra"))
    return a.join(b, list(keys)).withColumn("improvement", F.col("without_extra") - F.col("with_extra"))


def count_improved(deltas: DataFrame) -> DataFrame:
    return deltas.agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("improvement") > 0, 1).otherwise(0)).alias("n_improved")
    )


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bins between the least and greatest value; the last bin takes its upper edge."""
    low = df.agg(F.min(F.col(column).cast("double"))).scalar()
    high = df.agg(F.max(F.col(column).cast("double"))).scalar()
    share = F.coalesce(F.try_divide(F.col(column) - low, high - low), F.lit(0.0))
    inside = df.filter(F.col(column).isNotNull())
    at = F.least(F.floor(share * bins) + 1, F.lit(bins)).cast("int")
    return inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
