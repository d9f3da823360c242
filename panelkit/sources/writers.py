"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv_per_entity(df: DataFrame, path: str, entity: str = "entity") -> None:
    """One folder of CSV per entity.

    Rows are rebalanced by entity, so most entities get one file and an entity with many rows is
    split over several tasks and files.
    """
    flat = df.select(*[_as_text(df, c) for c in df.columns]).hint("rebalance", entity)
    flat.write.mode("overwrite").option("header", True).partitionBy(entity).csv(path)


def _as_text(df: DataFrame, name: str):
    kind = df.schema[name].dataType.typeName()
    return F.to_json(name).alias(name) if kind in ("array", "map", "struct") else F.col(name)


def years_present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path).select("year").distinct()
    except AnalysisException:
        return None


def consolidate_years(parts: DataFrame, path: str, year: str = "year", rows_per_file: int = 5_000_000) -> None:
    """Append the years not yet in ``path``, partitioned by year.

    Only the year column of the target is read to find the years already done. File size is
    limited by row count, so a year with most of the rows becomes many files.
    """
    done = years_present(parts.sparkSession, path)
    todo = parts if done is None else parts.join(F.broadcast(done), year, "left_anti")  # one row per year
    todo.write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy(year).parquet(path)


def append_manifest(datasets: DataFrame, path: str, start: str, end: str, unit: str, reducer: str) -> None:
    """Append one provenance record per (collection, parameter) row."""
    datasets.select(
        "collection", "parameter",
        F.lit(start).cast("date").alias("start_date"), F.lit(end).cast("date").alias("end_date"),
        F.lit(unit).alias("time_units"), F.current_timestamp().alias("date_written"),
        F.lit(True).alias("population_weighted"), F.lit("median").alias("time_aggregation"),
        F.lit(reducer).alias("space_aggregation"),
    ).write.mode("append").parquet(path)


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").option("header", True).csv(path)
