"""Result and reporting tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import named_fields
from ..functions.numeric import clip
from ..session import cut_lineage
from .metrics import class_report, confusion
from .ranking import global_position
from .schema import safe_columns

# Probability columns, highest class first as the reversed list gives them.
TERNARY_FIELDS = ("high_p", "medium_p", "low_p")
BINARY_FIELDS = ("low_p", "high_p")


def result_frame(
    predictions: DataFrame, style: str, settings: dict[str, Sequence], prediction: str = "prediction",
    truth: str = "label", probabilities: str | None = "probabilities", entity: str = "entity", date: str = "start_date",
) -> DataFrame:
    """Predictions, truth and probabilities with the settings of the run on every row."""

    def literal(value) -> Column:
        if isinstance(value, (list, tuple)):
            kind = "array<string>" if any(isinstance(v, str) for v in value) else "array<int>"
            return F.array(*[F.lit(v) for v in value]).cast(kind)
        return F.lit(value)

    return predictions.select(
        F.col(prediction).cast("double").alias("predictions"),
        F.col(truth).cast("double").alias("ground_truth"),
        F.col(date).alias("date"),
        F.col(entity),
        F.lit(style).alias("cat_style"),
        (F.col(probabilities) if probabilities else F.array(F.lit(None).cast("double"))).alias("probabilities"),
        *[literal(v).alias(k) for k, v in settings.items()],
    )


def probability_columns(df: DataFrame, ternary: bool, probabilities: str = "probabilities") -> DataFrame:
    """Probability list to named columns; three classes are reversed first."""
    if ternary:
        picked = named_fields(F.reverse(F.col(probabilities)), TERNARY_FIELDS)
    else:
        picked = named_fields(F.col(probabilities), BINARY_FIELDS)
    return df.withColumn("_p", picked).select("*", "_p.*").drop("_p")


def truth_columns(df: DataFrame, ternary: bool) -> DataFrame:
    """Correct / incorrect label and the truth as indicator list or text."""
    hit = F.when(F.col("predictions") == F.col("ground_truth"), "Correct Prediction").otherwise("Incorrect Prediction")
    out = df.withColumn("correct", hit)
    if not ternary:
        name = F.when(F.col("ground_truth") == 1.0, "High Case Rate").otherwise("Low Case Rate")
        return out.withColumn("truth_label", name)
    flags = [F.when(F.col("ground_truth") == k, 1.0).otherwise(0.0) for k in (2, 1, 0)]
    return out.withColumn("truth_color", F.array(*flags))


def month_slice(df: DataFrame, month: str, ternary: bool, date: str = "date") -> DataFrame:
    """Rows of one month, filtered first, with probability and truth columns."""
    return truth_columns(probability_columns(df.filter(F.col(date) == F.lit(month).cast("date")), ternary), ternary)


def run_row(df: DataFrame, config: dict, model_id: str, task_id: str) -> DataFrame:
    """One row per run from a configuration; limits may be columns of ``df``, which has one row per run."""
    name = config["base"]["model"]
    shape, general = config["reshape"], config["general_model"]

    def limit(key: str) -> Column:
        value = shape[key]
        return (value if isinstance(value, Column) else F.lit(value)).cast("timestamp_ntz").alias(key.replace("_time", ""))

    text = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    return df.select(
        F.lit(model_id).alias("model_id") if isinstance(model_id, str) else model_id.alias("model_id"),
        F.lit(task_id).alias("task_id"),
        F.lit(name).alias("model_type"),
        limit("train_time_limit"), limit("valid_time_limit"), limit("test_time_limit"),
        F.lit(general["train_batch_size"]).cast("int").alias("batch_size"),
        F.lit(general["prediction_length"]).cast("smallint").alias("prediction_length"),
        F.lit(general["epochs"]).cast("smallint").alias("train_epochs"),
        F.lit(shape["frequency"]).alias("frequency"),
        text(shape.get("static_features", [])).alias("static_features"),
        text(shape.get("dynamic_features", [])).alias("dynamic_features"),
        F.lit(str(config.get(name, {}))).alias("model_args"),
    )


def tag_run(metrics: DataFrame, model_id: str, task_id: str) -> DataFrame:
    """Metrics with safe column names and the run they belong to."""
    return safe_columns(metrics).withColumns({"model_id": F.lit(model_id), "task_id": F.lit(task_id)})


def map_table(attributes: DataFrame, metrics: DataFrame, key: str, item: str, metric: str, low=None, high=None) -> DataFrame:
    """Region attributes with one metric limited to ``low``..``high``.

    Attribute ids carry one digit more than item ids.
    """
    left = attributes.withColumn(item, F.substring(F.col(key), 1, 6))
    return left.join(metrics.withColumn(item, F.col(item).cast("string")), item).withColumn(
        metric, clip(F.col(metric), low, high)
    )


def equal_breaks(df: DataFrame, metric: str, classes: int = 5) -> DataFrame:
    """Class number 1..classes by equal intervals between the least and greatest value."""
    low = df.agg(F.min(F.col(metric).cast("double"))).scalar()
    high = df.agg(F.max(F.col(metric).cast("double"))).scalar()
    share = F.coalesce(F.try_divide(F.col(metric) - low, high - low), F.lit(0.0))
    at = F.when(F.col(metric).isNotNull(), F.least(F.floor(share * classes) + 1, F.lit(classes)).cast("int"))
    return df.withColumn("class", at)


def natural_breaks(df: DataFrame, metric: str, classes: int = 5, cells: int = 4096) -> DataFrame:
    """Class number 1..classes with the least sum of squared distances to the class means, exactly.

    Spark merges the rows to distinct values with their counts. A dynamic programme over prefix sums of these finds the
    breaks; among equal sums the lowest break wins. With more than ``cells`` values neighbouring ones are first merged into
    so many ranges of even size, and breaks fall between ranges. With fewer values than classes each has its own.
    """
    values = df.filter(F.col(metric).isNotNull()).groupBy(F.col(metric).cast("double").alias("v")).agg(F.count("*").cast("double").alias("n"))
    values = cut_lineage(values, "values")
    distinct = values.count()
    if distinct > cells:
        ranked = global_position(values, "v", name="at")
        values = ranked.groupBy(F.floor((F.col("at") - 1) * cells / distinct).alias("cell")).agg(
            F.max("v").alias("v"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("s"), F.sum(F.col("n") * F.col("v") * F.col("v")).alias("q"))
    else:
        values = values.select("v", "n", (F.col("n") * F.col("v")).alias("s"), (F.col("n") * F.col("v") * F.col("v")).alias("q"))
    rows = sorted(values.select("v", "n", "s", "q").collect())  # up to ``cells`` rows
    uppers = [rows[k][0] for k in break_positions(np.array(rows, float)[:, 1:], classes)] if rows else []
    at = F.lit(1)
    for upper in uppers[:-1]:
        at = at + F.when(F.col(metric).cast("double") > upper, 1).otherwise(0)
    return df.withColumn("class", F.when(F.col(metric).isNotNull(), at).cast("int"))


def break_positions(sums: np.ndarray, classes: int) -> list[int]:
    """Last item of each class for items with count, sum and sum of squares, in order."""
    n, s, q = (np.concatenate([[0.0], np.cumsum(c)]) for c in sums.T)
    m = len(sums)

    def spread(low: np.ndarray, high: int) -> np.ndarray:
        return q[high] - q[low] - (s[high] - s[low]) ** 2 / (n[high] - n[low])

    best = np.array([np.inf, *(np.round(spread(np.array([0]), k)[0], 6) for k in range(1, m + 1))])
    chosen = []
    for k in range(2, min(classes, m) + 1):
        following, cut = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        for high in range(k, m + 1):
            low = np.arange(k - 1, high)
            total = np.round(best[low] + spread(low, high), 6)
            cut[high] = low[np.argmin(total)]
            following[high] = total.min()
        best = following
        chosen.append(cut)
    ends = [m]
    for cut in reversed(chosen):
        ends.append(int(cut[ends[-1]]))
    return [e - 1 for e in reversed(ends)]


def run_reports(results: DataFrame, run: str = "run") -> DataFrame:
    """Classification report per run, rows with an error left out."""
    good = results.filter(F.col("error") == "NONE")
    return class_report(confusion(good, "ground_truth", "predictions", [run]), [run])
