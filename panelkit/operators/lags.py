"""Lag frames and history lists over a panel with one row per entity and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.dates import month_index
from .joins import salted_join
from .schema import drop_any_null


def offsets(lag: int, lookback: int, specific: Sequence[int] | None = None) -> list[int]:
    """The list given, or ``lookback`` offsets starting at ``lag``."""
    return list(specific) if specific is not None else list(range(lag, lag + lookback))


def lag_name(offset: int, column: str) -> str:
    return f"{offset}_shifted_{column}"


def add_lags(
    panel: DataFrame, wanted: dict[str, Sequence[int]], entity: str = "entity", date: str = "start_date",
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Add ``{offset}_shifted_{column}`` for all columns and offsets on one window."""
    w = W.partitionBy(entity).orderBy(date)
    names = names or {}
    return panel.withColumns(
        {
            lag_name(i, names.get(column, column)): F.col(column) if i == 0 else F.lag(column, i).over(w)
            for column, steps in wanted.items()
            for i in steps
        }
    )


def lag_frame(
    panel: DataFrame,
    start: str,
    end: str,
    target: str = "cases_per_100k",
    case_lookback: int = 24,
    case_lag: int = 1,
    env_list: Sequence[str] = (),
    env_lookback: int = 12,
    env_lag: int = 0,
    additional: Sequence[str] = ("month",),
    specific_cases: Sequence[int] | None = None,
    specific_env: Sequence[int] | None = None,
    entity: str = "entity",
    date: str = "start_date",
    filter_first: bool = False,
    dense: bool = False,
) -> DataFrame:
    """Target next to its own lags and those of the covariates, for dates in ``[start, end)``.

    Rows with a null are dropped before the date filter. ``dense`` states that no month is missing
    between an entity's first and last; then nothing before ``start`` less the longest lag can
    matter, and a filter on that month goes below the window to the scan.

    ``filter_first`` filters to ``start`` less the lookback in whole years before the lag and
    keeps the padding rows whose lags are complete.
    """
    case_steps = offsets(case_lag, case_lookback, specific_cases)
    env_steps = offsets(env_lag, env_lookback, specific_env) if env_list else []
    picked = panel.select(entity, date, target, *env_list, *[c for c in additional if c != target])
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    if filter_first:
        years = -(-case_lookback // 12)
        picked = picked.filter((F.col(date) >= F.add_months(first, -12 * years)) & (F.col(date) < last))
    else:
        picked = picked.filter(F.col(date) < last)
        if dense:
            reach = max([*case_steps, *env_steps, 0])
            picked = picked.filter(F.col(date) >= F.add_months(first, -reach))
    wanted: dict[str, Sequence[int]] = {target: case_steps}
    wanted.update({name: env_steps for name in env_list})
    lagged = drop_any_null(add_lags(picked, wanted, entity, date, names={target: "cases"}))
    if not filter_first:
        lagged = lagged.filter((F.col(date) >= first) & (F.col(date) < last))
    return lagged.drop(*env_list).withColumnRenamed(target, "target")


def single_lag(panel: DataFrame, column: str, gap: int = 1, name: str = "case_lag", entity: str = "entity",
               date: str = "start_date") -> DataFrame:
    """One named lag; rows with a null are dropped."""
    w = W.partitionBy(entity).orderBy(date)
    return drop_any_null(panel.withColumn(name, F.lag(column, gap).over(w)))


def rolling_history(
    panel: DataFrame, column: str, months: int, keep: int, name: str = "case_lag", entity: str = "entity",
    date: str = "start_date", test_after_cut: bool = False,
) -> DataFrame:
    """List of the last ``months`` months up to the current one, cut to its first ``keep`` values.

    Only windows with all ``months`` months are kept. With ``test_after_cut`` a window passes as
    soon as ``keep`` values are left after the cut, so the earliest lists hold the current value.
    """
    history = _history(panel, column, -(months - 1), 0, entity, date)
    size = F.size("_list") if not test_after_cut else F.least(F.size("_list"), F.lit(keep))
    need = keep if test_after_cut else months
    return history.filter(size == need).withColumn(name, F.slice("_list", 1, keep)).drop("_list")


def history_vector(
    panel: DataFrame, column: str, years: int, name: str = "history", entity: str = "entity",
    date: str = "start_date", month: str | None = "month",
) -> DataFrame:
    """Values of ``[t - years, t)`` oldest first, followed by the target month; complete ones only."""
    history = _history(panel, column, -12 * years, -1, entity, date)
    full = history.filter(F.size("_list") == 12 * years)
    tail = F.array(F.col(month).cast(panel.schema[column].dataType)) if month else F.array()
    return full.withColumn(name, F.concat("_list", tail) if month else F.col("_list")).drop("_list")


def _history(panel: DataFrame, column: str, low: int, high: int, entity: str, date: str) -> DataFrame:
    w = W.partitionBy(entity).orderBy("_m").rangeBetween(low, high)
    return (
        panel.withColumn("_m", month_index(F.col(date)))
        .withColumn("_list", F.collect_list(column).over(w))
        .drop("_m")
    )


def neighbour_matrix(
    panel: DataFrame, neighbours: DataFrame, column: str, months: int, predict_lag: int = 1,
    entity: str = "entity", date: str = "start_date",
) -> DataFrame:
    """Own lag list followed by the lists of the neighbours, in rank order.

    ``neighbours`` has (entity, neighbour, rank). The neighbours' lists end one step before the
    target, as the own list does. Rows where a neighbour has no full list are dropped.
    """
    keep = months - predict_lag
    own = rolling_history(panel, column, months, keep, "own", entity, date)
    other = own.select(F.col(entity).alias("neighbour"), date, F.col("own").alias("theirs"))
    needed = neighbours.groupBy(entity).agg(F.count("*").alias("_needed"))
    lists = (
        salted_join(neighbours, other, ["neighbour"], [entity])  # a hub is the neighbour of many
        .groupBy(entity, date)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "theirs"))).alias("_theirs"))
    )
    joined = own.join(lists, [entity, date]).join(needed, entity).filter(F.size("_theirs") == F.col("_needed"))
    flat = F.flatten(F.transform("_theirs", lambda x: x["theirs"]))
    return joined.withColumn("features", F.concat("own", flat)).drop("_theirs", "_needed", "own")
