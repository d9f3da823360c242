"""Readers, writers, tables and the stream."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from panelkit.operators.periods import count_by_period
from panelkit.session import cut_lineage, scratch_path
from panelkit.sources import readers, tables, writers
from panelkit.streaming.counts import monthly_counts, windowed_counts


def test_consolidation_skips_finished_years(spark, rows):
    path = scratch_path(spark, "t-years")
    df = spark.createDataFrame([(2001, 1), (2002, 2)], "year int, v int")
    writers.consolidate_years(df.filter("year = 2001"), path)
    writers.consolidate_years(df, path)
    writers.consolidate_years(df, path)
    assert rows(spark.read.parquet(path), "year", "v") == [(2001, 1), (2002, 2)]


def test_parameter_csvs(spark, rows):
    path = scratch_path(spark, "t-csv")
    text = [(1, "0.5", "2001-01-01"), (430000, "1.0", "2001-01-01"), (2, None, "2001-02-01")]
    df = spark.createDataFrame(text, "CD_MUN long, median string, start_date string").withColumn("end_date", F.lit("2001-03-01"))
    df.write.option("header", True).csv(f"{path}/EVI_2001.csv")
    out = readers.read_parameter_csvs(spark, path, "EVI")
    assert rows(out, "muni_id", "EVI", "start_date") == [(1, 0.5, dt.date(2001, 1, 1)), (2, -999.0, dt.date(2001, 2, 1))]


def test_append_goes_by_name(spark):
    path = scratch_path(spark, "t-table")
    name = tables.create_table(spark, "predictions", f"t_{path.rsplit('-', 1)[1]}", path)
    assert tables.create_table(spark, "predictions", name, path) == name
    df = spark.createDataFrame([(2.5, "m1", "run")], "mean double, muni_id string, model_id string")
    tables.append_by_name(df, name)
    row = spark.table(name).first()
    assert (row["model_id"], row["muni_id"], row["mean"], row["task_id"]) == ("run", "m1", 2.5, None)


def test_append_once_survives_failures_and_retries(spark, rows):
    path = scratch_path(spark, "t-runs")
    good = spark.range(4).selectExpr("CAST(id AS STRING) AS muni_id", "id / 2 AS mean", "'other' AS extra")
    bad = good.withColumn("mean", F.when(F.col("muni_id") == "3", F.raise_error(F.lit("lost"))).otherwise(F.col("mean")))
    assert tables.append_once(good, "predictions", path, "a.1")
    with pytest.raises(Exception, match="lost"):
        tables.append_once(bad, "predictions", path, "b")
    read = lambda: rows(tables.read_runs(spark, "predictions", path), "run_key", "muni_id", "mean")
    first = [("a.1", str(i), i / 2) for i in range(4)]
    assert read() == first  # nothing of the failed run shows
    assert tables.append_once(good, "predictions", path, "b")
    assert not tables.append_once(good, "predictions", path, "b")
    assert not tables.append_once(bad, "predictions", path, "a.1")  # committed: not even computed
    assert read() == first + [("b", i, m) for _, i, m in first]
    assert tables.append_once(good.limit(0), "predictions", path, "none")
    assert len(read()) == 8
    late = f"{path}/_staged-late"
    good.write.parquet(late)
    shutil.move(late.removeprefix("file:"), f"{path}/run_key=b/".removeprefix("file:"))  # a writer that lost the race
    assert len(read()) == 8
    for key in ("", "a/b", "a=b", "\u00e9"):
        with pytest.raises(ValueError, match="run key"):
            tables.append_once(good, "predictions", path, key)


def test_result_tables_hold_the_expected_columns():
    assert len(tables.SCHEMAS["agg_metrics"].fields) == 27
    assert len(tables.SCHEMAS["item_metrics"].fields) == 20
    assert len(tables.SCHEMAS["predictions"].fields) == 8
    assert len(tables.SCHEMAS["model_runs"].fields) == 13


def test_csv_per_entity_makes_one_folder_each(spark, rows):
    path = scratch_path(spark, "t-entity")
    df = spark.createDataFrame([("A", 1, [0.5]), ("B", 2, [1.0]), ("A", 3, [2.0])], "entity string, v int, p array<double>")
    writers.write_csv_per_entity(df, path)
    back = readers.read_csv(spark, path, "v int, p string, entity string")
    assert rows(back, "entity", "v", "p") == [("A", 1, "[0.5]"), ("A", 3, "[2.0]"), ("B", 2, "[1.0]")]


def test_variables_are_found_by_name(spark, rows):
    path = scratch_path(spark, "t-vars")
    spark.range(3).write.parquet(f"{path}/temperature_2m_2001-01-01_2021-01-01.parquet")
    spark.range(2).write.parquet(f"{path}/EVI_2001-01-01_2021-01-01.parquet")
    spark.range(2).write.parquet(f"{path}/other.parquet")
    assert rows(readers.variables_in(spark, path), "variable") == [("EVI",), ("temperature_2m",)]


def test_lineage_is_cut(spark, rows):
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    plan = df._jdf.queryExecution().toString()
    assert "Range" not in plan.split("== Physical Plan ==")[-1]
    assert df.count() == 10


def test_stream_counts_equal_batch(spark, rows):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet("/root/testdata/sf0.001/event[s].parquet")

    def run(df, mode):
        name = f"s_{scratch_path(spark, 'q').rsplit('-', 1)[1]}"
        started = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        started.processAllAvailable()
        started.stop()
        return spark.table(name)

    daily = run(windowed_counts(stream, "user_id", "ts", "1 day"), "update")
    days = batch.select(F.col("user_id").alias("entity"), F.to_date("ts").alias("event_date"))
    assert rows(daily, "user_id", "start_date", "count") == rows(count_by_period(days, "day"), "entity", "start_date", "count")
    monthly = run(monthly_counts(stream, "user_id", "ts"), "update")
    assert rows(monthly, "user_id", "start_date", "count") == rows(count_by_period(days, "month"), "entity", "start_date", "count")
    closed = run(windowed_counts(stream, "user_id", "ts", "7 days", offset="4 days"), "append")
    weeks = {(r[0], r[1]): r[2] for r in count_by_period(days, "week").collect()}
    got = closed.collect()
    assert got and all(weeks[r[0], r[1]] == r[2] for r in got)
