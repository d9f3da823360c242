"""Whole runs composed of the operators: build the case panel, merge panels, classify, forecast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from .functions.dates import period_start
from .operators import forecast, linear, metrics, models, results, splits, targets
from .operators.joins import reconcile
from .operators.lags import lag_frame
from .operators.periods import add_rate, densify
from .operators.schema import conform_keys, drop_any_null, feature_bundle, rename_present
from .session import cut_lineage

CLASSES = {"relative_ternary": 3, "relative_binary": 2, "simple_binary": 2, "simple_ternary": 3}


def case_panel(
    events: DataFrame, population: DataFrame, regions: DataFrame, unit: str = "month", entity: str = "entity",
    date: str = "event_date",
) -> DataFrame:
    """Line list to dense panel with counts, population, region attributes and rate.

    Events without a known population of their year, or of an unknown region, are dropped, as are
    those with a null. Events are counted per entity, period and year before anything is joined;
    a period that spans two years takes the population of its first year with events. Every entity
    of the population table gets a row with 0 cases for each period in which any entity has some.
    """
    attributes = [c for c in regions.columns if c != entity]
    known = drop_any_null(events)
    yearly = known.groupBy(
        entity, period_start(F.col(date), unit).alias("start_date"), F.year(date).alias("year")
    ).agg(F.count("*").alias("count"))
    complete = drop_any_null(yearly.join(population, [entity, "year"]).join(regions, entity))
    counted = complete.groupBy(entity, "start_date").agg(
        F.sum("count").alias("count"), F.min("year").alias("year"),
        *[F.min_by(c, "year").alias(c) for c in ("pop", *attributes)],
    )
    dense = densify(add_rate(counted), population.select(entity), {"count": 0, "cases_per_100k": 0.0}, entity=entity)
    dated = dense.withColumn("year", F.coalesce("year", F.year("start_date")))
    blanks = {c: f"_{c}" for c in ("pop", *attributes)}
    filled = dated.join(population.withColumnsRenamed(blanks), [entity, "year"], "left").join(
        regions.withColumnsRenamed(blanks), entity, "left"
    )
    return filled.withColumns({c: F.coalesce(c, other) for c, other in blanks.items()}).select(
        entity, "start_date", "year", "count", "pop", "cases_per_100k", *attributes
    )


def merge_panels(
    parameters: DataFrame, cases: DataFrame, keys: Sequence[str] = ("entity", "start_date"),
    renames: Mapping[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Inner join of two panels after repairing names and key types, with the row counts of the join."""
    right = rename_present(cases, renames or {})
    left = conform_keys(rename_present(parameters, renames or {}), right, keys)
    return left.join(right, list(keys)), reconcile(left, right, list(keys))


def run_classifier(
    data: DataFrame, train_start: str, train_end: str, test_end: str, style: str = "simple_binary", model: str = "trees",
    target: str = "cases_per_100k", env_list: Sequence[str] = (), additional: Sequence[str] = (), cat_vars: Sequence[str] = ("month",),
    case_lookback: int = 24, case_lag: int = 1, specific_cases: Sequence[int] | None = None, env_lookback: int = 12,
    env_lag: int = 0, specific_env: Sequence[int] | None = None, keys: Sequence[str] = ("entity", "month"), scaled: bool = True,
    dense: bool = False,
) -> DataFrame:
    """Fit on ``[train_start, train_end)``, predict ``[train_end, test_end)``, one result row per test row.

    ``model`` is ``trees``, ``ridge`` or ``local`` (one ridge per entity, with bypass and error rows).
    Scaling limits and expectations come from the training rows only.
    """
    extra = [*additional, *cat_vars]
    shape = dict(
        target=target, case_lookback=case_lookback, case_lag=case_lag, env_list=env_list, env_lookback=env_lookback,
        env_lag=env_lag, additional=extra, specific_cases=specific_cases, specific_env=specific_env, dense=dense,
    )
    frame = cut_lineage(lag_frame(data, train_start, test_end, **shape))  # labels, limits and both splits pass over it
    train, test = splits.temporal_holdout(frame, train_start, train_end, test_end)
    zero = splits.zero_entities(train)
    labelled = targets.label_splits(train, test, style, keys)
    (fit_rows, features), (score_rows, _) = (feature_bundle(df, "cat_target") for df in labelled)
    if model == "local":
        rows = fit_rows.withColumn("split", F.lit("train")).unionByName(score_rows.withColumn("split", F.lit("test")))
        fitted = linear.local_ridge_classes(rows.join(zero, "entity", "left_anti"), features, style)
        return fitted.unionByName(splits.bypass_rows(zero).drop("probabilities"))
    numbers = [c for c in features if c not in cat_vars]
    if scaled and numbers:
        fit_rows, score_rows = models.robust_scale(fit_rows, [score_rows], numbers)
    settings = {
        "env_vars": list(env_list) or [""], "additional_vars": extra or [""], "case_lag": case_lag, "env_lag": env_lag,
        "specific_cases": list(specific_cases or [None]), "specific_env": list(specific_env or [None]),
    }
    if model == "ridge":
        scored = models.ridge_classifier(fit_rows, score_rows, features, CLASSES[style])
        return results.result_frame(scored, style, settings, probabilities=None)
    scored = models.tree_classifier(fit_rows, score_rows, features, CLASSES[style])
    return results.result_frame(scored, style, settings)


def classify_report(run: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Confusion matrix, report per class and averages of a result frame, rows with an error left out."""
    good = run.filter(F.col("error") == "NONE") if "error" in run.columns else run
    matrix = metrics.confusion(good, "ground_truth", "predictions")
    report = metrics.class_report(matrix)
    return matrix, report, metrics.report_averages(report)


def run_forecast(panel: DataFrame, config: dict, run_id: str, task_id: str) -> dict[str, DataFrame]:
    """Forecast the last steps up to the test limit; frames named and shaped like the result tables."""
    shape, horizon = config["reshape"], config["general_model"]["prediction_length"]
    entity, date, target = shape["item_id"], shape["time_stamp"], shape["target"]
    prefix = panel.filter(F.col(date) <= F.lit(shape["test_time_limit"]).cast("date"))
    steps, history = forecast.seasonal_naive(prefix, horizon, target, extra=(0.025, 0.975), entity=entity, date=date)
    season = metrics.seasonal_error(history, "y", [entity], date=date)
    items = metrics.item_metrics(steps, season, [entity], interval=("q_0_025", "q_0_975"))
    first = steps.groupBy(entity).agg(F.min(date).cast("timestamp_ntz").alias("forecast_start"))
    paths = steps.groupBy(entity).agg(
        F.min(date).alias("start_date"),
        F.transform(F.array_sort(F.collect_list(F.struct("step", "mean"))), lambda x: x["mean"]).alias("path"),
    )
    one = panel.sparkSession.range(1)
    return {
        "model_runs": results.run_row(one, config, run_id, task_id),
        "predictions": forecast.forecast_rows(paths, entity, "start_date", "path", run_id, task_id),
        "item_metrics": results.tag_run(
            items.join(first, entity).withColumn("item_id", F.col(entity).cast("string")).drop(entity), run_id, task_id
        ),
        "agg_metrics": results.tag_run(metrics.agg_metrics(items), run_id, task_id),
    }
