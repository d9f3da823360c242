"""Projection and schema repair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.text import safe_name


def rename_present(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns that exist and ignore the rest."""
    return df.withColumnsRenamed(dict(names))


def conform_keys(df: DataFrame, other: DataFrame, keys: Sequence[str], date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Cast each key of ``df`` to its type in ``other`` where the two differ."""
    changed = {}
    for key in keys:
        have, want = df.schema[key].dataType, other.schema[key].dataType
        if have == want:
            continue
        if isinstance(have, T.StringType) and isinstance(want, T.DateType):
            changed[key] = F.to_date(F.col(key), date_format)
        else:
            changed[key] = F.col(key).cast(want)
    return df.withColumns(changed) if changed else df


def blank_columns(df: DataFrame, names: Sequence[str], dtype: str) -> DataFrame:
    """Typed null columns, replacing columns of the same name."""
    return df.withColumns({name: F.lit(None).cast(dtype) for name in names})


def columns_of_type(df: DataFrame, *kinds: type[T.DataType]) -> list[str]:
    return [field.name for field in df.schema.fields if isinstance(field.dataType, kinds)]


def downcast_doubles(df: DataFrame) -> DataFrame:
    names = columns_of_type(df, T.DoubleType)
    return df.withColumns({name: F.col(name).cast("float") for name in names}) if names else df


def safe_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[safe_name(name) for name in df.columns])


def drop_any_null(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any column; NaN is a value and stays."""
    for name in subset or df.columns:
        df = df.filter(F.col(name).isNotNull())
    return df


def fill_null(df: DataFrame, value: float, subset: Sequence[str] | None = None) -> DataFrame:
    """Replace nulls in numeric columns; NaN stays."""
    names = subset or columns_of_type(df, T.NumericType)
    return df.withColumns(
        {name: F.coalesce(F.col(name), F.lit(value).cast(df.schema[name].dataType)) for name in names}
    )


def one_hot_months(df: DataFrame, date: str, keep: Sequence[str] | None = None) -> DataFrame:
    """``month_1`` .. ``month_12`` indicators from a date column."""
    month = F.month(F.col(date))
    base = df.select(*keep) if keep else df
    return base.withColumns({f"month_{m}": F.when(month == m, 1).otherwise(0) for m in range(1, 13)})


def feature_bundle(
    df: DataFrame,
    label: str,
    entity: str = "entity",
    date: str = "start_date",
    not_features: Sequence[str] = ("target", "count", "cat_target"),
) -> tuple[DataFrame, list[str]]:
    """Label as double next to the feature columns, and the names of the features."""
    hidden = {entity, date, *not_features}
    features = [name for name in df.columns if name not in hidden]
    return df.select(entity, date, F.col(label).cast("double").alias("label"), *features), features
