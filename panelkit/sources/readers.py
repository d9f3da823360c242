"""Readers. Column lists and filters reach the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import variable_from_path
from ..operators.joins import join_variables
from ..operators.schema import drop_any_null


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One dataset or a glob, with an optional column list."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_line_list(
    spark: SparkSession, path: str, columns: Sequence[str], date: str, start_year: int, pattern: str = "yyyyMMdd"
) -> DataFrame:
    """Line list with dates parsed leniently, from ``start_year`` on."""
    df = read_parquet(spark, path, columns).withColumn(date, F.try_to_date(F.col(date), pattern))
    return df.filter(F.col(date) >= F.make_date(F.lit(start_year), F.lit(1), F.lit(1)))


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, null_value: str = ""
) -> DataFrame:
    """CSV with a header, a file or a glob. Without a schema Spark reads the data twice to infer one."""
    reader = spark.read.option("header", True).option("nullValue", null_value)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_parameter_csvs(
    spark: SparkSession, directory: str, parameter: str, excluded: Sequence[int] = (430000,), fill: float = -999.0
) -> DataFrame:
    """All exports of one parameter: renamed, nulls filled, dates parsed, excluded regions dropped."""
    schema = "CD_MUN long, median double, start_date string, end_date string"
    df = read_csv(spark, f"{directory}/{parameter}_*.csv", schema)
    return df.select(
        F.col("CD_MUN").alias("muni_id"),
        F.coalesce("median", F.lit(fill)).alias(parameter),
        F.to_date("start_date", "yyyy-MM-dd").alias("start_date"),
        F.to_date("end_date", "yyyy-MM-dd").alias("end_date"),
    ).filter(~F.col("muni_id").isin(list(excluded)))


def read_wide_years(spark: SparkSession, path: str, key: str, years: Sequence[int], null_value: str = "...") -> DataFrame:
    """Wide yearly table with a text key and a null token."""
    schema = T.StructType(
        [T.StructField(key, T.StringType()), *[T.StructField(str(y), T.LongType()) for y in years]]
    )
    return read_csv(spark, path, schema, null_value)


def read_complete(spark: SparkSession, path: str, ignored: Sequence[str] = ()) -> DataFrame:
    """Dataset without the ignored columns and without rows that hold a null."""
    return drop_any_null(spark.read.parquet(path).drop(*ignored))


def variables_in(spark: SparkSession, directory: str) -> DataFrame:
    """Name and path of every ``{variable}_{date}_{date}.parquet`` dataset.

    Only the file listing is read, one row per file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    path = F.col("path")
    named = files.select(variable_from_path(path).alias("variable"), F.regexp_extract(path, r"^(.*?\.parquet)", 1).alias("path"))
    return named.filter(F.col("variable") != "").distinct()


def read_variables(
    spark: SparkSession, directory: str, names: Sequence[str], start: str, end: str, keys: Sequence[str]
) -> DataFrame:
    """Inner join of the named variables' datasets."""
    frames: Mapping[str, DataFrame] = {
        name: spark.read.parquet(f"{directory}/{name}_{start}_{end}.parquet") for name in names
    }
    return join_variables(frames, keys)


def read_runs(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """CSV results of many runs, ``run`` taken from the folder name."""
    df = read_csv(spark, pattern, schema)
    return df.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def path_column() -> Column:
    return F.col("_metadata.file_path")
