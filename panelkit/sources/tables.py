"""Typed result tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.metrics import QUANTILES

_TEXT, _DOUBLE, _TIME = T.StringType(), T.DoubleType(), T.TimestampNTZType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def _per_quantile(*stems: str) -> list[tuple[str, T.DataType]]:
    return [(f"{stem}_{str(p).replace('.', '_')}_", _DOUBLE) for p in QUANTILES for stem in stems]


_IDS = [("model_id", _TEXT), ("task_id", _TEXT)]

# Names and types of the result tables.
SCHEMAS = {
    "model_runs": _schema(
        *_IDS, ("model_type", _TEXT), ("train_limit", _TIME), ("valid_limit", _TIME), ("test_limit", _TIME),
        ("batch_size", T.IntegerType()), ("prediction_length", T.ShortType()), ("train_epochs", T.ShortType()),
        ("frequency", _TEXT), ("static_features", T.ArrayType(_TEXT)), ("dynamic_features", T.ArrayType(_TEXT)),
        ("model_args", _TEXT),
    ),
    "predictions": _schema(
        *_IDS, ("muni_id", _TEXT), ("start_date", _TIME), ("predict_date", _TIME), ("step", T.ShortType()),
        ("time_unit", _TEXT), ("mean", _DOUBLE),
    ),
    "item_metrics": _schema(
        ("item_id", _TEXT), ("forecast_start", _TIME),
        *[(c, _DOUBLE) for c in ("MSE", "abs_error", "abs_target_sum", "abs_target_mean", "seasonal_error", "MASE",
                                 "MAPE", "sMAPE", "ND", "MSIS")],
        *_per_quantile("QuantileLoss", "Coverage"), *_IDS,
    ),
    "agg_metrics": _schema(
        *[(c, _DOUBLE) for c in ("MSE", "abs_error", "abs_target_sum", "abs_target_mean", "seasonal_error", "MASE",
                                 "MAPE", "sMAPE", "ND", "MSIS", "OWA", "RMSE", "NRMSE", "MAE_Coverage",
                                 "mean_absolute_QuantileLoss", "mean_wQuantileLoss")],
        *_per_quantile("QuantileLoss", "Coverage", "wQuantileLoss"), *_IDS,
    ),
}


def create_table(spark: SparkSession, kind: str, table: str | None = None, path: str | None = None) -> str:
    """Create the result table if it does not exist."""
    name = table or kind
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMAS[kind].fields)
    where = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{where}")
    return name


def _by_name(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema by name; those the frame lacks are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def append_by_name(df: DataFrame, table: str) -> None:
    """Append, matching columns by name; columns the frame lacks become null."""
    _by_name(df, df.sparkSession.table(table).schema).write.mode("append").insertInto(table)


#: Partition column that tells the runs of a folder apart.
RUN = "run_key"


def append_once(df: DataFrame, kind: str, path: str, key: str) -> bool:
    """Append the rows of run ``key`` to the result folder, once: true if this call made them visible.

    Rows are written beside the runs under a name that readers pass over, then one rename shows all of them. A write that
    fails shows nothing, and a retry after a commit neither writes nor adds rows. Of two writers of a run at the same time
    one wins; the other's rows stay hidden. The folder needs a file system that renames a folder in one step.
    ``key`` is not empty and holds letters, digits and ``._-`` only. Columns go by name as in ``append_by_name``.
    """
    if not key or not all(c.isascii() and (c.isalnum() or c in "._-") for c in key):
        raise ValueError(f"not a run key: {key!r}")
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    shown, staged = hadoop(f"{path}/{RUN}={key}"), hadoop(f"{path}/_staged-{uuid.uuid4().hex}")
    fs = shown.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(shown):
        return False
    _by_name(df, SCHEMAS[kind]).write.parquet(staged.toString())
    # where another writer came first, a rename fails or moves the folder, hidden as it is, below the run's
    return bool(fs.rename(staged, shown)) and not fs.exists(hadoop(shown, staged.getName()))


def read_runs(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """All runs of a result folder, with their key as ``run_key``; a filter on it reads those runs only."""
    return spark.read.schema(T.StructType([*SCHEMAS[kind].fields, T.StructField(RUN, _TEXT)])).parquet(path)


def export_table(spark: SparkSession, table: str, path: str) -> None:
    spark.table(table).write.mode("overwrite").parquet(path)
