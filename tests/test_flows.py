"""Whole runs on the smallest data."""

import datetime as dt
import inspect

import pytest
from pyspark.sql import functions as F

from panelkit import flows
from panelkit.plans.standins import Tables
from panelkit.plans.whole_runs import CONFIG
from panelkit.session import scratch_path
from panelkit.sources import tables


@pytest.fixture(scope="module")
def panel(spark):
    from panelkit.session import cut_lineage

    return cut_lineage(Tables(spark, "/root/testdata/sf0.001").panel)


def test_case_panel_on_a_year_change(spark, rows):
    day = dt.date.fromisoformat
    events = spark.createDataFrame(
        [("A", day("2019-12-31")), ("A", day("2020-01-01")), ("A", day("2020-01-02")), ("B", day("2020-01-02")), ("C", day("2020-01-02"))],
        "entity string, event_date date",
    )
    population = spark.createDataFrame([("A", 2019, 100000.0), ("A", 2020, 200000.0), ("B", 2019, 50000.0), ("B", 2020, None), ("D", 2019, 1.0)],
                                       "entity string, year int, pop double")
    regions = spark.createDataFrame([("A", "a"), ("B", "b"), ("D", "d")], "entity string, name string")
    out = rows(flows.case_panel(events, population, regions, "week"), "entity", "start_date", "year", "count", "pop", "cases_per_100k", "name")
    monday = day("2019-12-30")
    assert out == [
        ("A", monday, 2019, 3, 100000.0, 3.0, "a"), ("B", monday, 2019, 0, 50000.0, 0.0, "b"), ("D", monday, 2019, 0, 1.0, 0.0, "d"),
    ]


@pytest.mark.parametrize("model, style", [("ridge", "relative_ternary"), ("trees", "simple_binary"), ("local", "relative_binary")])
def test_classifier_gives_one_row_per_test_row(panel, model, style):
    scaled_up = panel.withColumn("count", F.col("count") * 25.0)
    run = flows.run_classifier(
        scaled_up, "1997-01-01", "2000-01-01", "2001-01-01", style, model, target="count", case_lookback=3, dense=True
    )
    out = run.collect()
    good = [r for r in out if "error" not in run.columns or r["error"] == "NONE"]
    assert len(good) == 12 * panel.select("entity").distinct().count()
    assert all(dt.date(2000, 1, 1) <= r["date"] < dt.date(2001, 1, 1) for r in good)
    assert {r["ground_truth"] for r in good} <= {0.0, 1.0, 2.0}
    matrix, report, averages = flows.classify_report(run)
    assert matrix.agg(F.sum("n")).first()[0] == len(good)
    hits = sum(r["predictions"] == r["ground_truth"] for r in good)
    assert averages.first()["accuracy"] == pytest.approx(hits / len(good))


def test_test_rows_do_not_change_training_labels(panel):
    from panelkit.operators import splits, targets

    train, test = splits.temporal_holdout(panel.withColumnRenamed("count", "target"), "1997-01-01", "2000-01-01", "2001-01-01")
    a, b = targets.label_splits(train, test, "relative_binary")
    c, d = targets.label_splits(train, test.withColumn("target", F.col("target") * 1000 + 7), "relative_binary")
    key = ["entity", "start_date", "cat_target"]
    assert sorted(a.select(*key).collect()) == sorted(c.select(*key).collect())
    assert d.filter("cat_target = '0'").count() == 0 and b.count() == d.count()


def test_forecast_frames_fit_the_result_tables(spark, panel):
    out = flows.run_forecast(panel.select("entity", "start_date", "count"), CONFIG, "r1", "t1")
    assert set(out) == set(tables.SCHEMAS)
    for kind, frame in out.items():
        assert set(frame.columns) <= {f.name for f in tables.SCHEMAS[kind].fields}
        path = scratch_path(spark, f"t-{kind}")
        name = tables.create_table(spark, kind, f"t_{path.rsplit('-', 1)[1]}", path)
        tables.append_by_name(frame, name)
        assert spark.table(name).count() == frame.count() > 0
    assert out["predictions"].count() == 3 * out["item_metrics"].count()


@pytest.mark.parametrize("name", ["run_classifier_trees", "run_classifier_local_report"])
def test_classifier_queries_take_24_months(spark, monkeypatch, name):
    from panelkit.plans import all_queries

    class Called(Exception):
        pass

    def called(*args, **kwargs):
        bound = inspect.signature(run).bind(*args, **kwargs)
        bound.apply_defaults()
        raise Called(bound.arguments["case_lookback"])

    run = flows.run_classifier
    monkeypatch.setattr(flows, "run_classifier", called)
    with pytest.raises(Called, match="^24$"):
        all_queries()[name](spark, "/root/testdata/sf0.001")
