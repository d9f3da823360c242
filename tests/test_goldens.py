"""Hand-made inputs with answers worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelkit.functions import arrays, dates, numeric, text
from panelkit.operators import fills, joins, lags, metrics, periods, ranking, series, splits, sweeps, targets, zonal


def day(text_value):
    return dt.date.fromisoformat(text_value)


@pytest.fixture(scope="module")
def events(spark):
    rows = [("A", "2020-01-05"), ("A", "2020-01-31"), ("A", "2020-02-01"), ("B", "2020-02-10")]
    return spark.createDataFrame(rows, "entity string, d string").select("entity", F.to_date("d").alias("event_date"))


def test_monthly_count_and_densify(spark, rows, events):
    counts = periods.count_by_period(events, "month")
    assert rows(counts) == [("A", day("2020-01-01"), 2), ("A", day("2020-02-01"), 1), ("B", day("2020-02-01"), 1)]
    entities = spark.createDataFrame([("A",), ("B",), ("C",)], "entity string")
    dense = periods.densify(counts, entities, {"count": 0})
    assert dense.count() == 6
    assert rows(dense.filter("count = 0")) == [("B", day("2020-01-01"), 0), ("C", day("2020-01-01"), 0), ("C", day("2020-02-01"), 0)]
    assert rows(periods.densify(dense, entities, {"count": 0})) == rows(dense)


def test_densify_keeps_entities_outside_the_universe(spark, rows, events):
    counts = periods.count_by_period(events, "month")
    only_a = spark.createDataFrame([("A",)], "entity string")
    assert rows(periods.densify(counts, only_a, {"count": 0})) == rows(counts)


def test_week_starts_on_monday(spark, rows):
    df = spark.createDataFrame([("A", day("2020-01-01"))], "entity string, event_date date")
    assert rows(periods.count_by_period(df, "week")) == [("A", day("2019-12-30"), 1)]


def test_first_attribute_follows_date_order(spark, rows):
    data = [("A", day("2020-01-09"), "late"), ("A", day("2020-01-02"), "early")]
    df = spark.createDataFrame(data, "entity string, event_date date, name string")
    assert rows(periods.count_by_period(df, "month", first=["name"]), "count", "name") == [(2, "early")]


def test_rate(spark, rows):
    df = spark.createDataFrame([(3, 150000), (3, 0), (3, None)], "count int, pop int")
    assert rows(periods.add_rate(df), "cases_per_100k") == [(2.0,), (None,), (None,)]


def test_interpolate_and_backfill(spark, rows):
    values = [None, 10.0, None, None, 16.0, None]
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(values)], "entity string, year int, pop double")
    assert [r[1] for r in rows(fills.fill_exposure(df), "year", "pop")] == [10.0, 10.0, 12.0, 14.0, 16.0, None]


def panel(spark, values, entity="A"):
    data = [(entity, dt.date(2020 + i // 12, i % 12 + 1, 1), i % 12 + 1, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "entity string, start_date date, month int, x double")


@pytest.mark.parametrize("dense", [True, False])
def test_lag_frame(spark, rows, dense):
    out = lags.lag_frame(panel(spark, [1, 2, 3, 4]), "2020-01-01", "2021-01-01", "x", case_lookback=2, dense=dense)
    assert rows(out, "target", "1_shifted_cases", "2_shifted_cases") == [(3.0, 2.0, 1.0), (4.0, 3.0, 2.0)]


def test_specific_lags(spark, rows):
    out = lags.lag_frame(panel(spark, [1, 2, 3, 4]), "2020-01-01", "2021-01-01", "x", specific_cases=[1, 3])
    assert rows(out, "target", "1_shifted_cases", "3_shifted_cases") == [(4.0, 3.0, 1.0)]


def test_lag_reaches_before_the_start(spark, rows):
    out = lags.lag_frame(panel(spark, range(1, 7)), "2020-05-01", "2020-06-01", "x", case_lookback=3, dense=True)
    assert rows(out, "target", "3_shifted_cases") == [(5.0, 2.0)]


def test_lag_frame_on_a_panel_with_gaps_lags_by_row(spark, rows):
    gappy = panel(spark, range(1, 13)).filter("month <> 6")
    out = lags.lag_frame(gappy, "2020-07-01", "2020-08-01", "x", case_lookback=2)
    assert rows(out, "target", "1_shifted_cases", "2_shifted_cases") == [(7.0, 5.0, 4.0)]


def test_simple_targets(spark, rows):
    df = spark.createDataFrame([(100.0,), (100.01,), (300.0,), (300.01,)], "target double")
    assert rows(targets.simple_ternary(df)[0]) == [(100.0, "0"), (100.01, "1"), (300.0, "1"), (300.01, "2")]
    assert rows(targets.simple_binary(df)[0]) == [(100.0, "0"), (100.01, "0"), (300.0, "0"), (300.01, "1")]


def test_relative_targets(spark, rows):
    expected = spark.createDataFrame([("A", 1, 10.0), ("B", 1, 0.0)], "entity string, month int, expected double")
    df = spark.createDataFrame(
        [("A", 1, 5.0), ("A", 1, 5.1), ("A", 1, 10.0), ("A", 1, 10.1), ("B", 1, 0.0), ("C", 1, 3.0)],
        "entity string, month int, target double",
    )
    ternary, _ = targets.relative_ternary(df, expected)
    assert rows(ternary, "entity", "target", "cat_target") == [
        ("A", 10.0, "1"), ("A", 10.1, "2"), ("A", 5.0, "0"), ("A", 5.1, "1"), ("B", 0.0, "0")
    ]
    binary, _ = targets.relative_binary(df, expected)
    assert rows(binary.filter("target >= 10"), "target", "cat_target") == [(10.0, "0"), (10.1, "1")]


@pytest.mark.parametrize("keys", [("entity", "month"), ("month",)])
def test_own_expectations_equal_joined_ones(spark, rows, keys):
    data = [(e, m, float((i * 7) % 5)) for i, (e, m) in enumerate((e, m) for e in "ABC" for m in (1, 2, 1, 2, 1))]
    df = spark.createDataFrame(data, "entity string, month int, target double")
    made, expected = targets.relative_ternary(df, None, keys)
    again, _ = targets.relative_ternary(df, expected, keys)
    assert rows(made, "entity", "month", "target", "cat_target") == rows(again, "entity", "month", "target", "cat_target")


def test_sliding_month_keeps_to_the_month_end(spark, rows):
    days = ["2020-01-31", "2020-02-28", "2020-02-29"]
    df = spark.createDataFrame([("A", day(d)) for d in days], "entity string, event_date date")
    out = {r[0]: r[1] for r in rows(periods.sliding_counts(df), "start_date", "count")}
    assert out[day("2020-01-31")] == 2
    assert min(out) == day("2020-01-31") and max(out) == day("2020-02-29")


def test_rolling_history(spark, rows):
    df = panel(spark, [1, 2, 3, 4])
    assert rows(lags.rolling_history(df, "x", 3, 2), "month", "case_lag") == [(3, [1.0, 2.0]), (4, [2.0, 3.0])]
    after = rows(lags.rolling_history(df, "x", 3, 2, test_after_cut=True), "month", "case_lag")
    assert after == [(2, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [2.0, 3.0])]


def test_confusion_and_report(spark, rows):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "t int, p int")
    matrix = metrics.confusion(df, "t", "p")
    assert rows(matrix, "truth", "predicted", "n") == [(0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 2)]
    report = metrics.class_report(matrix).filter("class = 1").first()
    assert (report["precision"], report["recall"], report["f1"]) == (pytest.approx(2 / 3), 1.0, pytest.approx(0.8))
    assert metrics.report_averages(metrics.class_report(matrix)).first()["accuracy"] == 0.75


def test_class_weights(spark, rows):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    assert sorted(set(rows(metrics.class_weights(df, "y")))) == [(0, pytest.approx(2 / 3)), (1, 2.0)]


@pytest.mark.parametrize("y, q, loss", [(10.0, 8.0, 3.6), (8.0, 10.0, 0.4)])
def test_quantile_loss(spark, y, q, loss):
    steps = spark.createDataFrame([("A", y, q, q, q, q)], "entity string, y double, mean double, q_0_1 double, q_0_5 double, q_0_9 double")
    season = spark.createDataFrame([("A", 1.0)], "entity string, seasonal_error double")
    assert metrics.item_metrics(steps, season).first()["QuantileLoss_0_9_"] == pytest.approx(loss)


def test_metrics_with_zero_truth_are_null(spark):
    steps = spark.createDataFrame([("A", 0.0, 0.0, 0.0, 0.0, 0.0)], "entity string, y double, mean double, q_0_1 double, q_0_5 double, q_0_9 double")
    season = spark.createDataFrame([("A", 0.0)], "entity string, seasonal_error double")
    out = metrics.item_metrics(steps, season).first()
    assert out["MAPE"] is None and out["sMAPE"] is None and out["MASE"] is None and out["ND"] is None


def test_weighted_median(spark, rows):
    df = spark.createDataFrame([("r", 1.0, 1.0), ("r", 2.0, 1.0), ("r", 3.0, 3.0)], "region string, v double, w double")
    assert rows(zonal.zonal_median(df, ["region"], "v", "w")) == [("r", 3.0)]
    assert rows(zonal.zonal_mean(df, ["region"], "v", "w")) == [("r", 2.4)]


def test_histogram_text(spark, rows):
    df = spark.createDataFrame([("[[0, 30.0], [1, 10.0]]",), ("[[1, 10.0], [8, 30]]",)], "h string")
    by_band = df.select(*arrays.cover_fractions(F.col("h"))).collect()
    assert (by_band[0]["water"], by_band[0]["trees"], by_band[0]["snow_ice"]) == (0.75, 0.25, 0.0)
    assert (by_band[1]["water"], by_band[1]["trees"], by_band[1]["snow_ice"]) == (0.0, 0.25, 0.75)
    in_order = df.select(*arrays.cover_fractions(F.col("h"), positional=True)).collect()
    assert (in_order[0]["water"], in_order[0]["trees"], in_order[0]["grass"]) == (0.75, 0.25, None)
    assert in_order[1]["water"] == 1.0  # whole numbers are not seen, the first decimal takes the first name


def test_parameter_grid(spark):
    options = {"a": [1, 2], "b": ["x"], "c": ["p", "q"], "d": 5}
    points = sweeps.grid_points(options)
    assert points == [{"a": 1, "c": "p"}, {"a": 1, "c": "q"}, {"a": 2, "c": "p"}, {"a": 2, "c": "q"}]
    assert sweeps.explode_grid(spark.range(3), options).count() == 12


def test_expanding_folds(spark, rows):
    df = panel(spark, range(1, 6))
    out = rows(splits.expanding_folds(df, 4), "fold", "role", "x")
    for fold in range(1, 5):
        assert [x for f, role, x in out if f == fold and role == "train"] == [float(i) for i in range(1, fold + 1)]
        assert [x for f, role, x in out if f == fold and role == "test"] == [float(fold + 1)]


def test_expanding_folds_put_the_remainder_in_front(spark, rows):
    out = rows(splits.expanding_folds(panel(spark, range(1, 13)), 4), "fold", "role", "x")
    assert [x for f, role, x in out if f == 1 and role == "train"] == [1.0, 2.0, 3.0, 4.0]
    assert [x for f, role, x in out if f == 4 and role == "test"] == [11.0, 12.0]


def test_try_parse_and_strict_parse(spark, rows):
    df = spark.createDataFrame([("20200131",), ("2020-01",), (None,)], "s string")
    assert rows(df.select(text.try_parse_date(F.col("s")))) == [(None,), (None,), (day("2020-01-31"),)]


def test_units_between(spark):
    df = spark.createDataFrame([(day("2021-03-20"), day("2019-01-01"))], "e date, s date")
    out = df.select(
        dates.units_between(F.col("e"), F.col("s"), "month").alias("m"),
        dates.units_between(F.col("e"), F.col("s"), "week", approximate=True).alias("w"),
    ).first()
    assert out["m"] == 26
    assert out["w"] == 2 * 52 + 2 * 4 + 2


def test_null_rules(spark, rows):
    from panelkit.operators.schema import drop_any_null, fill_null

    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert drop_any_null(df).count() == 2
    filled = [r[0] for r in fill_null(df, -999.0).collect()]
    assert sorted(str(x) for x in filled) == ["-999.0", "1.0", "nan"]


def test_reconcile(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(1,), (3,)], "k int")
    assert tuple(joins.reconcile(a, b, ["k"]).first()) == (3, 2, 2, False)


def test_join_variables_suffixes_collisions(spark):
    a = spark.createDataFrame([(1, "s", 1.0)], "k int, start string, EVI double")
    b = spark.createDataFrame([(1, "t", 2.0)], "k int, start string, temp double")
    assert joins.join_variables({"EVI": a, "temp": b}, ["k"]).columns == ["k", "start", "EVI", "start_temp", "temp"]


def test_rank_quantile_cut(spark, rows):
    df = spark.createDataFrame([(i,) for i in range(1, 11)], "rank int")
    out = ranking.quantile_cut_ranks(df, "rank", [0.1, 0.3, 0.5], ["low", "medium", "high", "very_high"], "cut")
    assert [r[1] for r in sorted(rows(out))] == ["low"] + ["medium"] * 2 + ["high"] * 2 + ["very_high"] * 5


def test_instance_windows(spark):
    lists = series.collect_series(panel(spark, [1, 2, 3, 4, 5]), ["x"])
    out = series.instance_windows(lists, "x", F.lit(3), 4, 2, ["entity"]).first()
    assert (out["past"], out["is_pad"], out["future"]) == ([0.0, 1.0, 2.0, 3.0], [1, 0, 0, 0], [4.0, 5.0])


def test_step_features(spark):
    out = series.step_features(panel(spark, [5, 6]), 2, dynamic=["x"]).orderBy("start_date").collect()
    assert [r["start_date"].month for r in out] == [1, 2, 3, 4]
    assert out[0]["step_vector"] == [-0.5, pytest.approx(0.30103), 5.0]
    assert [r["is_future"] for r in out] == [False, False, True, True]


def test_mean_abs_scale(spark):
    df = spark.createDataFrame([([1.0, -3.0],), ([0.0, 0.0],)], "c array<double>")
    out = df.select(arrays.scale_context(F.col("c")).alias("s")).collect()
    assert out[0]["s"] == [0.5, -1.5] and out[1]["s"] == [0.0, 0.0]


def test_chunks_and_units(spark, rows):
    df = spark.createDataFrame([(day("2001-01-01"), day("2003-03-01"))], "a date, b date")
    chunks = rows(periods.chunk_ranges(df, "a", "b", 12), "chunk_start", "chunk_end")
    assert chunks == [(day("2001-01-01"), day("2002-01-01")), (day("2002-01-01"), day("2003-01-01")), (day("2003-01-01"), day("2003-03-01"))]
    assert periods.explode_units(df, "a", "b").count() == 26


def test_lookback_window_is_half_open(spark, rows):
    record = spark.createDataFrame([("A", day("2020-01-11"))], "entity string, date date")
    data = [("A", day("2020-01-01"), 1.0), ("A", day("2020-01-10"), 1.5), ("A", day("2020-01-11"), 1.0), ("A", day("2019-12-31"), 1.0)]
    values = spark.createDataFrame(data, "entity string, d date, v double")
    out = zonal.lookback_histogram(record, values, ["entity"], "date", "d", "v", 10, 0, 2, 2)
    assert rows(out, "1", "2") == [(0, 2)]


def test_evaluation_cut_and_bypass(spark, rows):
    cut = splits.evaluation_cut(panel(spark, [1, 2, 3, 4, 5]), 2)
    assert rows(cut.filter("part = 'truth'"), "x") == [(4.0,), (5.0,)]
    zero = splits.zero_entities(spark.createDataFrame([("A", 0), ("A", 0), ("B", 1)], "entity string, target int"))
    row = splits.bypass_rows(zero, classes=3).first()
    assert (row["entity"], row["predictions"], str(row["date"]), row["cat_style"]) == ("A", -999.0, "1900-01-01", "NA")
    assert row["probabilities"] == [-999.0] * 3


def test_units_and_scaling(spark):
    df = spark.createDataFrame([(0.0, 5), (21171.0, 1), (42342.0, 12)], "v double, m int")
    out = df.select(numeric.unit_scale(F.col("v"), 0, 21171).alias("u"), numeric.scaled_month(F.col("m")).alias("s")).collect()
    assert [r["u"] for r in out] == [0.0, 1.0, 2.0]
    assert out[1]["s"] == -0.5 and out[2]["s"] == 0.5
