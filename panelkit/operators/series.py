"""One array-valued series per entity, per-step features and training windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.dates import shift
from ..functions.draws import unit_draw
from ..functions.numeric import scaled_month, series_age


def collect_series(
    panel: DataFrame, columns: Sequence[str], entity: str = "entity", date: str = "start_date",
    static: Sequence[str] = (),
) -> DataFrame:
    """Ordered lists per entity; ``static`` columns take their value at the first date.

    The panel holds one row per entity and period, so a list is at most the calendar long.
    """
    steps = F.array_sort(F.collect_list(F.struct(date, *[c for c in columns if c != date])))
    grouped = panel.groupBy(entity).agg(
        steps.alias("_s"), F.min(date).alias("series_start"), *[F.min_by(c, date).alias(c) for c in static]
    )
    lists = [F.transform("_s", _field(c)).alias(c) for c in columns]
    return grouped.select(entity, "series_start", *static, *lists)


def _field(name: str):
    return lambda x: x[name]


def nested_prefixes(df: DataFrame, date: str, limits: dict[str, str]) -> dict[str, DataFrame]:
    """Rows up to and including each limit: train lies inside valid lies inside test."""
    return {name: df.filter(F.col(date) <= F.lit(limit).cast("date")) for name, limit in limits.items()}


def observed_flag(df: DataFrame, target: str) -> DataFrame:
    """1 where the target is known, else 0, with the gap set to 0."""
    missing = F.col(target).isNull() | F.isnan(F.col(target).cast("double"))
    return df.withColumns(
        {
            "observed": F.when(missing, 0).otherwise(1),
            target: F.when(missing, F.lit(0).cast(df.schema[target].dataType)).otherwise(F.col(target)),
        }
    )


def step_features(
    panel: DataFrame, horizon: int, entity: str = "entity", date: str = "start_date", dynamic: Sequence[str] = ()
) -> DataFrame:
    """Scaled month, age and dynamic features per step, as one vector.

    Steps run on for ``horizon`` months past each entity's last date, where dynamic features are
    null in the columns and 0 in the vector.
    """
    last = panel.groupBy(entity).agg(F.max(date).alias("_last"))
    ahead = last.select(
        entity, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_h"), "_last"
    ).select(entity, shift(F.col("_last"), F.col("_h"), "month").alias(date), F.lit(True).alias("is_future"))
    steps = panel.select(entity, date, F.lit(False).alias("is_future"), *dynamic).unionByName(
        ahead, allowMissingColumns=True
    )
    position = F.row_number().over(W.partitionBy(entity).orderBy(date)) - 1
    featured = steps.withColumns({"month_scaled": scaled_month(F.month(date)), "age": series_age(position)})
    parts = [F.col("month_scaled"), F.col("age")]
    parts += [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in dynamic]
    return featured.withColumn("step_vector", F.array(*parts))


def instance_windows(
    series: DataFrame, values: str, cut: Column, past: int, future: int, static: Sequence[str] = ()
) -> DataFrame:
    """Past and future slices around ``cut`` (number of steps before the split point).

    The past is padded with 0 on the left; ``is_pad`` marks the padding.
    """
    have = F.least(cut, F.lit(past))
    pad = F.lit(past) - have
    context = F.slice(F.col(values), cut - have + 1, have)
    zero = F.lit(0).cast(series.schema[values].dataType.elementType)
    return series.select(
        *static,
        cut.alias("cut"),
        F.concat(F.array_repeat(zero, pad), context).alias("past"),
        F.concat(F.array_repeat(F.lit(1), pad), F.array_repeat(F.lit(0), have)).alias("is_pad"),
        F.slice(F.col(values), cut + 1, future).alias("future"),
    )


def split_point(mode: str, values: str, key: str, future: int, seed: int = 42) -> Column:
    """Number of steps before the split: drawn for train, last full horizon for valid, the end for test."""
    length = F.size(F.col(values))
    if mode == "test":
        return length
    if mode == "valid":
        return length - F.lit(future)
    if mode != "train":
        raise ValueError("mode must be train, valid or test")
    room = F.greatest(length - F.lit(future) + 1, F.lit(1))
    return F.floor(unit_draw(seed, key) * room).cast("int")
