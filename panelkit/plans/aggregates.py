"""Aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W, functions as F

from ..functions.numeric import guarded_corr
from ..operators import association, coverage, metrics, periods, zonal
from ..operators.forecast import seasonal_naive
from ..operators.lags import add_lags
from ..operators.ranking import dense_code
from ..operators.series import collect_series
from ..operators.splits import zero_entities
from ..operators.targets import expectations, risk_bands
from .joining import _LAGGED, lagged_series
from ..session import cut_lineage
from .registry import query
from .standins import TRAIN_END


@query(
    "agg_1_monthly_counts", "AGG-1",
    """WITH c AS (SELECT entity, CAST(date_trunc('month', event_date) AS DATE) AS start_date, count(*) AS count,
         min_by(flag, {'d': event_date, 'o': order_id, 'p': part, 'f': flag}) AS flag FROM line_list GROUP BY 1, 2)
       SELECT c.*, x.pop, c.count / (x.pop / 100000.0) AS cases_per_100k FROM c LEFT JOIN exposure x
         ON x.entity = c.entity AND x.year = year(c.start_date)""",
    uses="line_list exposure",
)
def _(t):
    counted = periods.count_by_period(t.line_list, "month", first=["flag"], order=["order_id", "part"])
    keyed = counted.withColumn("year", F.year("start_date")).join(t.exposure, ["entity", "year"], "left").drop("year")
    return periods.add_rate(keyed)


@query(
    "agg_1_weekly_counts", "AGG-1",
    "SELECT entity, CAST(date_trunc('week', event_date) AS DATE) AS start_date, count(*) AS count FROM line_list GROUP BY 1, 2",
    uses="line_list",
)
def _(t):
    return periods.count_by_period(t.line_list, "week")


@query(
    "agg_2_several_periods", "AGG-2 UDF-2",
    " UNION ALL ".join(
        f"SELECT '{u}' AS period, entity, CAST(date_trunc('{u}', event_date) AS DATE) AS start_date, count(*) AS count FROM daily GROUP BY 1, 2, 3"
        for u in ("day", "week", "month")
    ),
    uses="daily",
)
def _(t):
    days = cut_lineage(periods.count_by_period(t.daily, "day"), "days")  # weeks and months add up days; events are read once
    out = [days.withColumn("period", F.lit("day"))]
    for unit in ("week", "month"):
        start = periods.period_start(F.col("start_date"), unit)
        up = days.groupBy("entity", start.alias("start_date")).agg(F.sum("count").alias("count"))
        out.append(up.withColumn("period", F.lit(unit)))
    return reduce(lambda a, b: a.unionByName(b), out)


@query(
    "agg_3_sliding_month", "AGG-3",
    """WITH d AS (SELECT entity, event_date AS day, count(*) AS n FROM daily GROUP BY 1, 2),
       s AS (SELECT entity, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS st FROM d GROUP BY 1)
       SELECT s.entity, CAST(s.st AS DATE) AS start_date, CAST(sum(d.n) AS BIGINT) AS count FROM s JOIN d ON d.entity = s.entity
         AND d.day >= s.st AND d.day < s.st + INTERVAL 1 MONTH GROUP BY 1, 2""",
    uses="daily",
)
def _(t):
    return periods.sliding_counts(t.daily)


@query(
    "agg_3_sliding_month_line_list", "AGG-3",
    """WITH d AS (SELECT entity, event_date AS day, count(*) AS n FROM line_list GROUP BY 1, 2),
       s AS (SELECT entity, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS st FROM d GROUP BY 1)
       SELECT s.entity, CAST(s.st AS DATE) AS start_date, CAST(sum(d.n) AS BIGINT) AS count FROM s JOIN d ON d.entity = s.entity
         AND d.day >= s.st AND d.day < s.st + INTERVAL 1 MONTH GROUP BY 1, 2""",
    uses="line_list",
)
def _(t):
    return periods.sliding_counts(t.line_list)


@query("agg_4_densify", "AGG-4 JON-9", "SELECT entity, start_date, count FROM dense", uses="dense")
def _(t):
    return t.dense


@query(
    "agg_4_densify_full_calendar", "AGG-4",
    """SELECT e.entity, CAST(p.m AS DATE) AS start_date, coalesce(c.count, 0) AS count, e.name FROM entities e
       CROSS JOIN (SELECT unnest(generate_series(DATE '1994-10-01', DATE '2002-03-01', INTERVAL 1 MONTH)) AS m) p
       LEFT JOIN counts c ON c.entity = e.entity AND c.start_date = p.m""",
    uses="entities counts",
)
def _(t):
    calendar = periods.full_calendar("1994-10-01", "2002-03-01")
    dense = periods.densify(t.counts, t.entities, {"count": 0}, calendar)
    return dense.join(t.entities.select("entity", "name"), "entity", "left")


@query(
    "agg_5_group_statistics", "AGG-5",
    """SELECT entity, CAST(sum(count) AS BIGINT) AS total, CAST(sum(count) AS DOUBLE) / count(*) AS mean,
         median(count) AS median, arg_min(count, start_date) AS first FROM dense GROUP BY 1""",
    uses="dense",
)
def _(t):
    return t.dense.groupBy("entity").agg(
        F.sum("count").alias("total"), (F.sum("count") / F.count("*")).alias("mean"),
        F.median("count").alias("median"), F.min_by("count", "start_date").alias("first"),
    )


@query(
    "agg_6_ordered_series", "AGG-6 FLT-4",
    """SELECT entity, string_agg(CAST(count AS VARCHAR), ',' ORDER BY start_date) AS series FROM dense
       WHERE month(start_date) IN (11, 12, 1, 2, 3, 4, 5) GROUP BY 1""",
    uses="dense",
)
def _(t):
    season = t.dense.filter(F.month("start_date").isin(11, 12, 1, 2, 3, 4, 5))
    lists = collect_series(season, ["count"])
    return lists.select("entity", F.array_join(F.col("count").cast("array<string>"), ",").alias("series"))


@query(
    "agg_7_series_dataset", "AGG-7 WIN-9",
    """SELECT d.entity, min(d.start_date) AS series_start, any_value(e.nation) AS nation,
         string_agg(CAST(d.count AS VARCHAR), ',' ORDER BY d.start_date) AS target,
         string_agg(CAST(month(d.start_date) AS VARCHAR), ',' ORDER BY d.start_date) AS month,
         (SELECT count(DISTINCT entity) FROM dense z WHERE z.entity <= d.entity) AS code
       FROM dense d JOIN entities e USING (entity) WHERE d.start_date <= DATE '2000-01-01' GROUP BY 1""",
    uses="dense entities",
)
def _(t):
    prefix = t.dense.filter(F.col("start_date") <= F.lit("2000-01-01").cast("date"))
    rows = prefix.withColumn("month", F.month("start_date")).join(t.entities.select("entity", "nation"), "entity")
    lists = collect_series(rows, ["count", "month"], static=["nation"])
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return dense_code(lists, "entity").select(
        "entity", "series_start", "nation", text("count").alias("target"), text("month").alias("month"), "code"
    )


_PIVOT = ", ".join(f"CAST(sum(CASE WHEN c_nationkey = {k} THEN 1 END) AS BIGINT) AS \"{k}\"" for k in range(25))


@query(
    "agg_8_pivot", "AGG-8",
    f"SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS start_date, {_PIVOT} FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
def _(t):
    # nations are a fixed list of 25, so the pivot needs no pass for the values; orders are counted before the join
    month = F.to_date(F.date_trunc("month", "o_orderdate")).alias("start_date")
    counted = t.orders.groupBy(F.col("o_custkey").alias("c_custkey"), month).agg(F.count("*").alias("k"))
    rows = counted.join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey")
    long = rows.groupBy("start_date", "c_nationkey").agg(F.sum("k").alias("n"))
    return long.groupBy("start_date").pivot("c_nationkey", list(range(25))).agg(F.first("n"))


@query("agg_9_unpivot_years", "AGG-9", "SELECT entity, year, pop FROM raw_exposure", uses="raw_exposure")
def _(t):
    return t.raw_exposure


@query(
    "agg_10_group_rate", "AGG-10",
    """SELECT e.nation, p.start_date, CAST(sum(p.count) AS BIGINT) AS count, sum(p.pop) AS pop,
         sum(p.count) / sum(p.pop) * 100000 AS cases_per_100k FROM panel p JOIN entities e USING (entity) GROUP BY 1, 2""",
    uses="panel entities",
)
def _(t):
    sums = t.panel.join(t.entities.select("entity", "nation"), "entity").groupBy("nation", "start_date").agg(
        F.sum("count").alias("count"), F.sum("pop").alias("pop")
    )
    return sums.withColumn("cases_per_100k", F.try_divide(F.col("count").cast("double"), F.col("pop")) * 100000)


@query("agg_11_expectations", "AGG-11", "SELECT entity, month, expected FROM expected", uses="expected")
def _(t):
    return expectations(t.panel, ("entity", "month"), "count")


@query(
    "agg_11_expectations_by_month", "AGG-11 TGT-5",
    "SELECT month, CAST(sum(count) AS DOUBLE) / count(count) AS expected FROM panel GROUP BY 1", uses="panel",
)
def _(t):
    return expectations(t.panel, ("month",), "count")


@query(
    "agg_12_risk_bands", "AGG-12",
    """SELECT entity, month, med AS count, med * 0.10 :: DOUBLE AS low_max, med * 0.30 :: DOUBLE AS moderate_max,
         med * 0.50 :: DOUBLE AS high_max FROM (SELECT entity, month, median(count) AS med FROM panel GROUP BY 1, 2)""",
    uses="panel",
)
def _(t):
    return risk_bands(t.panel, ("entity", "month"), "count")


@query(
    "agg_13_distinct_keys", "AGG-13",
    "SELECT c_nationkey, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
def _(t):
    # orders shrink to one row per customer and priority before they meet the customers
    seen = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").distinct()
    rows = seen.join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey")
    pairs = rows.select("c_nationkey", "c_custkey").distinct().groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    kinds = rows.select("c_nationkey", "o_orderpriority").distinct().groupBy("c_nationkey").agg(F.count("*").alias("priorities"))
    return pairs.join(kinds, "c_nationkey")


_CORR = """pairs AS (SELECT a.entity AS i, b.entity AS j, count(*) AS n, CAST(sum(a.count) AS DOUBLE) AS sx, CAST(sum(b.count) AS DOUBLE) AS sy,
       CAST(sum(a.count * a.count) AS DOUBLE) AS sxx, CAST(sum(b.count * b.count) AS DOUBLE) AS syy, CAST(sum(a.count * b.count) AS DOUBLE) AS sxy
       FROM dense a JOIN dense b ON a.start_date = b.start_date AND a.entity < b.entity GROUP BY 1, 2),
    corrs AS (SELECT i, j, CASE WHEN n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0
       THEN (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) END AS corr FROM pairs)"""


@query(
    "agg_14_pairwise_corr", "AGG-14 D15",
    "WITH " + _CORR + " SELECT i, j, round(corr, 9) AS corr FROM corrs", uses="dense",
)
def _(t):
    lists = collect_series(t.dense, ["count"])
    return association.pairwise_corr(lists, "count").withColumn("corr", F.round("corr", 9))


@query(
    "agg_15_lagged_corr", "AGG-15",
    "WITH " + _LAGGED + " SELECT i, j, round(corr, 9) AS corr FROM corrs", uses="dense",
)
def _(t):
    return association.cross_corr(lagged_series(t), "now", "prev").withColumn("corr", F.round("corr", 9))


@query(
    "agg_16_mean_corr", "AGG-16",
    "WITH " + _CORR + """ SELECT round(sum(corr) / count(corr), 9) AS mean_corr, count(corr) AS n_pairs,
        round(sum(corr) / (pow((SELECT count(DISTINCT entity) FROM dense), 2) - (count(*) - count(corr))), 9) AS mean_all_cells FROM corrs""",
    uses="dense",
)
def _(t):
    lists = cut_lineage(collect_series(t.dense, ["count"]), "series")
    sums = cut_lineage(association.corr_sums(lists, "count"), "sums")
    plain = association.mean_pairwise(sums)
    cells = association.mean_pairwise(sums, lists, over_all_cells=True)
    return plain.select(F.round("mean_corr", 9).alias("mean_corr"), "n_pairs").join(
        cells.select(F.round("mean_corr", 9).alias("mean_all_cells"), "n_pairs"), "n_pairs"
    )


@query(
    "agg_17_pearson_check", "AGG-17",
    "WITH " + _LAGGED + " SELECT round(corr, 9) AS corr, i, j FROM corrs WHERE i = (SELECT min(entity) FROM dense) AND j = (SELECT max(entity) FROM dense)",
    uses="dense",
)
def _(t):
    lagged = add_lags(t.dense, {"count": [1]}).filter(F.col("1_shifted_count").isNotNull())
    early = lagged.filter(F.col("start_date") < F.lit(TRAIN_END).cast("date"))
    low, high = t.dense.agg(F.min("entity")).scalar(), t.dense.agg(F.max("entity")).scalar()
    a = early.filter(F.col("entity") == low).select("start_date", F.col("entity").alias("i"), F.col("count").cast("double").alias("x"))
    b = early.filter(F.col("entity") == high).select("start_date", F.col("entity").alias("j"), F.col("1_shifted_count").cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    corr = guarded_corr(F.count("*"), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y))
    return a.join(b, "start_date").groupBy("i", "j").agg(F.round(corr, 9).alias("corr"))


@query(
    "agg_18_rmse_r2", "AGG-18",
    """SELECT entity, count(*) AS n, round(sqrt(sum((p - y) * (p - y)) / count(*)), 6) AS rmse,
         round(1 - sum((p - y) * (p - y)) / nullif(sum(y * y) - sum(y) * sum(y) / count(*), 0), 6) AS r2 FROM
         (SELECT entity, CAST(count AS DOUBLE) AS y, CAST(lag(count) OVER (PARTITION BY entity ORDER BY start_date) AS DOUBLE) AS p FROM dense)
       WHERE p IS NOT NULL GROUP BY 1""",
    uses="dense",
)
def _(t):
    p = F.lag("count").over(W.partitionBy("entity").orderBy("start_date"))
    rows = t.dense.withColumn("p", p).filter(F.col("p").isNotNull())
    out = metrics.regression_scores(rows, ["entity"], "count", "p")
    return out.withColumns({c: F.round(c, 6) for c in ("rmse", "r2")})


@query(
    "agg_19_confusion", "AGG-19",
    """SELECT a.c AS truth, b.c AS predicted, count(p.entity) AS n FROM (SELECT DISTINCT truth AS c FROM class_pairs) a
       CROSS JOIN (SELECT DISTINCT pred AS c FROM class_pairs) b LEFT JOIN class_pairs p ON p.truth = a.c AND p.pred = b.c GROUP BY 1, 2""",
    uses="class_pairs",
)
def _(t):
    return metrics.confusion(t.class_pairs, "truth", "pred")


_REPORT = """cls AS (SELECT DISTINCT truth AS class FROM class_pairs UNION SELECT DISTINCT pred FROM class_pairs),
    rep AS (SELECT class, sum(CASE WHEN truth = class AND pred = class THEN 1 ELSE 0 END) AS tp,
        sum(CASE WHEN pred = class THEN 1 ELSE 0 END) AS n_predicted, sum(CASE WHEN truth = class THEN 1 ELSE 0 END) AS support
      FROM cls CROSS JOIN class_pairs GROUP BY 1),
    r AS (SELECT class, CAST(tp AS BIGINT) AS tp, CAST(n_predicted AS BIGINT) AS n_predicted, CAST(support AS BIGINT) AS support,
        coalesce(CAST(tp AS DOUBLE) / nullif(n_predicted, 0), 0.0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0.0) AS recall,
        coalesce(CAST(tp * 2 AS DOUBLE) / nullif(n_predicted + support, 0), 0.0) AS f1 FROM rep)"""


@query("agg_20_class_report", "AGG-20", "WITH " + _REPORT + " SELECT * FROM r", uses="class_pairs")
def _(t):
    return metrics.class_report(metrics.confusion(t.class_pairs, "truth", "pred"))


_AVERAGES = """ SELECT round(CAST(sum(tp) AS DOUBLE) / sum(support), 9) AS accuracy, round(avg(precision), 9) AS macro_precision,
    round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS f1_macro,
    round(sum(precision * support) / sum(support), 9) AS weighted_precision, round(sum(recall * support) / sum(support), 9) AS weighted_recall,
    round(sum(f1 * support) / sum(support), 9) AS weighted_f1, round(avg(CASE WHEN support > 0 THEN recall END), 9) AS balanced_accuracy,
    CAST(sum(support) AS BIGINT) AS support FROM r"""


@query("agg_20_report_averages", "AGG-20 AGG-21", "WITH " + _REPORT + _AVERAGES, uses="class_pairs")
def _(t):
    out = metrics.report_averages(metrics.class_report(metrics.confusion(t.class_pairs, "truth", "pred")))
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c != "support"})


@query(
    "agg_21_scores", "AGG-21",
    "WITH " + _REPORT + " SELECT round(avg(f1), 9) AS f1_macro, round(avg(recall), 9) AS balanced_accuracy FROM r", uses="class_pairs",
)
def _(t):
    out = metrics.report_averages(metrics.class_report(metrics.confusion(t.class_pairs, "truth", "pred")))
    return out.select(F.round("f1_macro", 9).alias("f1_macro"), F.round("balanced_accuracy", 9).alias("balanced_accuracy"))


# seasonal-naive forecast of the last 3 months of every entity, with interval quantiles
FORECAST_SQL = """cut AS (SELECT entity, start_date, CAST(count AS DOUBLE) AS y,
        CAST(lag(count, 12) OVER w AS DOUBLE) AS mean, row_number() OVER (PARTITION BY entity ORDER BY start_date DESC) AS back
      FROM dense WINDOW w AS (PARTITION BY entity ORDER BY start_date)),
    spread AS (SELECT entity, quantile_cont(y - mean, [0.1, 0.5, 0.9, 0.025, 0.975]) AS q FROM cut WHERE back > 3 AND mean IS NOT NULL GROUP BY 1),
    steps AS (SELECT c.entity, c.start_date, CAST(3 - c.back AS INTEGER) AS step, c.y, c.mean, c.mean + q[1] AS q_0_1, c.mean + q[2] AS q_0_5, c.mean + q[3] AS q_0_9,
        c.mean + q[4] AS q_0_025, c.mean + q[5] AS q_0_975 FROM cut c JOIN spread s USING (entity) WHERE back <= 3)"""

_ITEM = FORECAST_SQL + """, season AS (SELECT entity, avg(abs(y - mean)) AS seasonal_error FROM cut WHERE back > 3 GROUP BY 1),
    items AS (SELECT s.entity, any_value(e.seasonal_error) AS seasonal_error, avg((y - mean) * (y - mean)) AS MSE, sum(abs(y - q_0_5)) AS abs_error,
        sum(abs(y)) AS abs_target_sum, avg(abs(y)) AS abs_target_mean, avg(abs(y - q_0_5)) / nullif(any_value(e.seasonal_error), 0) AS MASE,
        avg(abs(y - q_0_5) / nullif(abs(y), 0)) AS MAPE, avg(2 * abs(y - q_0_5) / nullif(abs(y) + abs(q_0_5), 0)) AS sMAPE,
        sum(abs(y - q_0_5)) / nullif(sum(abs(y)), 0) AS ND,
        avg(q_0_975 - q_0_025 + 40.0 * (greatest(q_0_025 - y, 0) + greatest(y - q_0_975, 0))) / nullif(any_value(e.seasonal_error), 0) AS MSIS,
        """ + ", ".join(
    f"2 * sum(abs((y - q_{c}) * (CASE WHEN y <= q_{c} THEN 1 ELSE 0 END - {p}))) AS QuantileLoss_{c}_, avg(CASE WHEN y < q_{c} THEN 1.0 ELSE 0.0 END) AS Coverage_{c}_"
    for c, p in (("0_1", 0.1), ("0_5", 0.5), ("0_9", 0.9))
) + " FROM steps s JOIN season e USING (entity) GROUP BY 1)"

_ITEM_COLUMNS = (
    "MSE abs_error abs_target_sum abs_target_mean seasonal_error MASE MAPE sMAPE ND MSIS QuantileLoss_0_1_ Coverage_0_1_ "
    "QuantileLoss_0_5_ Coverage_0_5_ QuantileLoss_0_9_ Coverage_0_9_"
).split()


def forecast_items(t):
    steps, history = seasonal_naive(t.dense, 3, "count", extra=(0.025, 0.975))
    season = metrics.seasonal_error(history, "y", ["entity"])
    return metrics.item_metrics(steps, season, interval=("q_0_025", "q_0_975"))


@query(
    "agg_22_item_metrics", "AGG-22",
    "WITH " + _ITEM + " SELECT entity, " + ", ".join(f"round({c}, 6) AS {c}" for c in _ITEM_COLUMNS) + " FROM items", uses="dense",
)
def _(t):
    items = forecast_items(t)
    return items.select("entity", *[F.round(c, 6).alias(c) for c in _ITEM_COLUMNS])


_AGG_COLUMNS = {
    "abs_error": "sum(abs_error)", "abs_target_sum": "sum(abs_target_sum)",
    **{f"QuantileLoss_{c}_": f"sum(QuantileLoss_{c}_)" for c in ("0_1", "0_5", "0_9")},
    **{c: f"avg({c})" for c in ("MSE", "abs_target_mean", "seasonal_error", "MASE", "MAPE", "sMAPE", "MSIS", "Coverage_0_1_", "Coverage_0_5_", "Coverage_0_9_")},
    "RMSE": "sqrt(avg(MSE))", "NRMSE": "sqrt(avg(MSE)) / avg(abs_target_mean)", "ND": "sum(abs_error) / sum(abs_target_sum)",
    "mean_absolute_QuantileLoss": "(sum(QuantileLoss_0_1_) + sum(QuantileLoss_0_5_) + sum(QuantileLoss_0_9_)) / 3",
    "MAE_Coverage": "(abs(avg(Coverage_0_1_) - 0.1) + abs(avg(Coverage_0_5_) - 0.5) + abs(avg(Coverage_0_9_) - 0.9)) / 3",
    **{f"wQuantileLoss_{c}_": f"sum(QuantileLoss_{c}_) / sum(abs_target_sum)" for c in ("0_1", "0_5", "0_9")},
    "mean_wQuantileLoss": "(sum(QuantileLoss_0_1_) + sum(QuantileLoss_0_5_) + sum(QuantileLoss_0_9_)) / sum(abs_target_sum) / 3",
}
_AGG_SELECT = ", ".join(f"round({e}, 5) AS {c}" for c, e in _AGG_COLUMNS.items())


@query("agg_23_agg_metrics", "AGG-23", "WITH " + _ITEM + f" SELECT {_AGG_SELECT} FROM items", uses="dense")
def _(t):
    out = metrics.agg_metrics(forecast_items(t))
    return out.select(*[F.round(c, 5).alias(c) for c in _AGG_COLUMNS])


@query(
    "agg_24_metrics_per_group", "AGG-24",
    "WITH " + _ITEM + f" SELECT e.nation, {_AGG_SELECT} FROM items JOIN entities e USING (entity) GROUP BY 1", uses="dense entities",
)
def _(t):
    items = forecast_items(t).join(t.entities.select("entity", "nation"), "entity")
    out = metrics.agg_metrics(items, ["nation"])
    return out.select("nation", *[F.round(c, 5).alias(c) for c in _AGG_COLUMNS])


_RUNS = """r AS (SELECT entity, sqrt(avg(pow(CAST(count AS DOUBLE) - l1, 2))) AS a, sqrt(avg(pow(CAST(count AS DOUBLE) - l12, 2))) AS b FROM
    (SELECT *, lag(count, 1) OVER w AS l1, lag(count, 12) OVER w AS l12 FROM dense WINDOW w AS (PARTITION BY entity ORDER BY start_date)) WHERE l12 IS NOT NULL GROUP BY 1)"""


def _two_runs(t):
    rows = add_lags(t.dense, {"count": [1, 12]}).filter(F.col("12_shifted_count").isNotNull())
    seasonal = metrics.regression_scores(rows, ["entity"], "count", "12_shifted_count")
    return metrics.compare_runs(seasonal, metrics.regression_scores(rows, ["entity"], "count", "1_shifted_count"), ["entity"])


@query(
    "agg_25_run_deltas", "AGG-25",
    "WITH " + _RUNS + " SELECT entity, round(b, 6) AS with_extra, round(a, 6) AS without_extra, round(a - b, 6) AS improvement FROM r", uses="dense",
)
def _(t):
    return _two_runs(t).withColumns({c: F.round(c, 6) for c in ("with_extra", "without_extra", "improvement")})


@query(
    "agg_25_count_improved", "AGG-25",
    "WITH " + _RUNS + " SELECT count(*) AS n, CAST(sum(CASE WHEN a - b > 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS n_improved FROM r", uses="dense",
)
def _(t):
    return metrics.count_improved(_two_runs(t).withColumn("improvement", F.round("improvement", 9)))


@query(
    "agg_26_zero_entities", "AGG-26",
    "SELECT entity FROM daily GROUP BY 1 HAVING sum(CASE WHEN kind = 'error' AND event_date < DATE '2024-01-05' THEN 1 ELSE 0 END) = 0",
    uses="daily",
)
def _(t):
    hit = (F.col("kind") == "error") & (F.col("event_date") < F.lit("2024-01-05").cast("date"))
    return zero_entities(t.daily.withColumn("target", F.when(hit, 1).otherwise(0)))


@query(
    "agg_27_class_weights", "AGG-27",
    """SELECT entity, start_date, truth, CAST((SELECT count(*) FROM class_pairs) AS DOUBLE) /
         ((SELECT count(DISTINCT truth) FROM class_pairs) * count(*) OVER (PARTITION BY truth)) AS weight FROM class_pairs""",
    uses="class_pairs",
)
def _(t):
    return metrics.class_weights(t.class_pairs.drop("pred"), "truth")


@query(
    "agg_27_class_weights_per_entity", "AGG-27",
    """SELECT entity, start_date, truth, CAST(count(*) OVER (PARTITION BY entity) AS DOUBLE) /
         ((SELECT count(DISTINCT truth) FROM class_pairs z WHERE z.entity = c.entity) * count(*) OVER (PARTITION BY entity, truth)) AS weight FROM class_pairs c""",
    uses="class_pairs",
)
def _(t):
    return metrics.class_weights(t.class_pairs.drop("pred"), "truth", ["entity"])


@query(
    "agg_28_pixel_composite", "AGG-28",
    "SELECT pixel, CAST(date_trunc('year', date) AS DATE) AS period, round(median(value), 4) AS median FROM pixels GROUP BY 1, 2",
    uses="pixels",
)
def _(t):
    dated = t.pixels.withColumn("period", periods.period_start(F.col("date"), "year"))
    return zonal.composite(dated, ["pixel", "period"], "value").withColumn("median", F.round("median", 4))


@query(
    "agg_29_zonal_mean", "AGG-29",
    "SELECT region, CAST(date_trunc('month', date) AS DATE) AS period, sum(weight * round(value * 100)) / sum(weight) AS mean FROM pixels GROUP BY 1, 2",
    uses="pixels",
)
def _(t):
    # whole cents keep the sums exact in both engines
    cents = t.pixels.withColumns({"period": periods.period_start(F.col("date"), "month"), "value": F.round(F.col("value") * 100)})
    return zonal.zonal_mean(cents, ["region", "period"], "value", "weight")


@query(
    "agg_29_zonal_median", "AGG-29",
    """WITH m AS (SELECT region, CAST(date_trunc('year', date) AS DATE) AS period, value, sum(weight) AS w FROM pixels GROUP BY 1, 2, 3),
       c AS (SELECT *, sum(w) OVER (PARTITION BY region, period ORDER BY value) AS upto, sum(w) OVER (PARTITION BY region, period) AS total FROM m)
       SELECT region, period, min(value) AS median FROM c WHERE upto >= total * 0.5 GROUP BY 1, 2""",
    uses="pixels",
)
def _(t):
    dated = t.pixels.withColumn("period", periods.period_start(F.col("date"), "year"))
    return zonal.zonal_median(dated, ["region", "period"], "value", "weight")


@query(
    "agg_29_polygon_mean", "AGG-29 SRC-9",
    """WITH r AS (SELECT entity AS region, entity % 37 + 0.25 AS x0, entity % 37 + 3.25 + nation * 0.125 AS x1, entity % 29 + 0.375 AS y0, entity % 29 + 2.875 + entity % 5 * 0.25 AS y1 FROM entities),
       p AS (SELECT pixel % 50 AS col, (pixel // 50) % 40 AS row, CAST(date_trunc('month', date) AS DATE) AS period, round(value * 100) AS value FROM pixels),
       cells AS (SELECT DISTINCT col, row FROM p),
       s AS (SELECT region, col, row, CAST(greatest(0, least(x1, col + 1) - greatest(x0, col)) * greatest(0, least(y1, row + 1) - greatest(y0, row))
               - greatest(0, least(x0 + 1.75, col + 1) - greatest(x0 + 1, col)) * greatest(0, least(y0 + 1.25, row + 1) - greatest(y0 + 0.5, row)) AS DOUBLE) AS weight
             FROM r, cells WHERE x0 < col + 1 AND x1 > col AND y0 < row + 1 AND y1 > row)
       SELECT region, period, round(sum(weight * value) / sum(weight), 6) AS mean FROM p JOIN s USING (col, row) WHERE weight > 0 GROUP BY 1, 2""",
    uses="entities pixels",
)
def _(t):
    # each entity's outline is a rectangle with a rectangular hole, parts are pixels of a grid of 50 by 40 cells
    corners = t.entities.select(
        F.col("entity").alias("region"), (F.col("entity") % 37 + 0.25).alias("x0"), (F.col("entity") % 37 + 3.25 + F.col("nation") * 0.125).alias("x1"),
        (F.col("entity") % 29 + 0.375).alias("y0"), (F.col("entity") % 29 + 2.875 + F.col("entity") % 5 * 0.25).alias("y1"))
    def ring(number, hole, x0, x1, y0, y1):
        points = [F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
        return corners.select("region", F.lit(number).alias("ring"), F.lit(hole).alias("hole"), F.posexplode(F.array(*points)).alias("vertex_no", "p")).select(
            "region", "ring", "hole", "vertex_no", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    vertices = ring(0, False, x0, x1, y0, y1).union(ring(1, True, x0 + 1, x0 + 1.75, y0 + 0.5, y0 + 1.25))
    raster = t.pixels.select(
        (F.col("pixel") % 50 + 0.5).alias("x"), (F.floor(F.col("pixel") / 50) % 40 + 0.5).alias("y"), periods.period_start(F.col("date"), "month").alias("period"),
        F.round(F.col("value") * 100).alias("value"))
    images = zonal.image_sums(raster, ["x", "y", "period"], "value")  # a pixel lies in many regions
    out = zonal.zonal_mean(coverage.region_pixels(images, vertices, 1.0), ["region", "period"], "value", "weight", "images")
    return out.withColumn("mean", F.round("mean", 6))


_BINS = ", ".join(
    f"CAST(sum(CASE WHEN value >= {10000 * k} AND value < {10000 * (k + 1)} THEN 1 ELSE 0 END) AS BIGINT) AS \"{k + 1}price\"" for k in range(10)
)


@query("agg_30_fixed_histogram", "AGG-30", f"SELECT region, {_BINS} FROM pixels GROUP BY 1", uses="pixels")
def _(t):
    return zonal.fixed_histogram(t.pixels, ["region"], "value", 0, 100000, 10, "price")
