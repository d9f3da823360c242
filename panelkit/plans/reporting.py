"""Result and reporting tables."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import forecast, metrics, results
from ..operators.series import collect_series
from ..session import scratch_path
from ..sources.readers import read_runs
from ..sources.writers import write_metrics_csv
from .aggregates import FORECAST_SQL
from .labels_splits import class_results
from .registry import query
from .scalars import _PROBS


@query(
    "res_1_result_frame", "RES-1",
    "WITH " + _PROBS + """ SELECT predictions, ground_truth, start_date AS date, entity, 'relative_ternary' AS cat_style, 1 AS case_lag, 'volume,tax' AS env_vars,
        CASE WHEN predictions = 0 THEN '0.5,0.25,0.25' WHEN predictions = 1 THEN '0.25,0.5,0.25' ELSE '0.25,0.25,0.5' END AS probabilities FROM pr""",
    uses="class_pairs",
)
def _(t):
    named = class_results(t).withColumnsRenamed({"predictions": "prediction", "ground_truth": "label", "date": "start_date"})
    out = results.result_frame(named, "relative_ternary", {"env_vars": ["volume", "tax"], "case_lag": 1})
    text = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("env_vars", "probabilities")}
    return out.withColumns(text)


@query(
    "res_2_forecast_rows", "RES-2",
    """SELECT 'run1' AS model_id, 'task1' AS task_id, CAST(entity AS VARCHAR) AS muni_id, min(start_date) OVER (PARTITION BY entity) AS start_date,
         CAST(min(start_date) OVER (PARTITION BY entity) + to_months(CAST(row_number() OVER (PARTITION BY entity ORDER BY start_date) - 1 AS INTEGER)) AS DATE) AS predict_date,
         CAST(row_number() OVER (PARTITION BY entity ORDER BY start_date) - 1 AS SMALLINT) AS step, 'M' AS time_unit, CAST(count AS DOUBLE) AS mean FROM dense""",
    uses="dense",
)
def _(t):
    lists = collect_series(t.dense.withColumn("m", F.col("count").cast("double")), ["m"])
    return forecast.forecast_rows(lists, "entity", "series_start", "m", "run1", "task1")


@query(
    "res_3_sample_means", "RES-3",
    "WITH " + FORECAST_SQL + """, ch AS (SELECT entity, avg(y - mean) AS d FROM cut WHERE back > 3 AND mean IS NOT NULL GROUP BY 1)
      SELECT s.entity, s.step, round(s.mean + ch.d, 6) AS mean FROM steps s JOIN ch USING (entity)""",
    uses="dense",
)
def _(t):
    steps, history = forecast.seasonal_naive(t.dense, 3, "count")
    samples = forecast.residual_samples(steps, history)
    means = forecast.sample_means(samples, ["entity"])
    return means.select("entity", F.posexplode("mean").alias("step", "mean")).withColumn("mean", F.round("mean", 6))


_CONFIG = {
    "base": {"model": "seasonal"},
    "general_model": {"train_batch_size": 1024, "prediction_length": 3, "epochs": 10},
    "seasonal": {"context_length": 24},
}


@query(
    "res_4_run_table", "RES-4",
    """SELECT 'nation' || e.nation AS model_id, 'task1' AS task_id, 'seasonal' AS model_type, CAST(max(c.start_date) - INTERVAL 24 MONTH AS TIMESTAMP) AS train_limit,
         CAST(max(c.start_date) - INTERVAL 12 MONTH AS TIMESTAMP) AS valid_limit, CAST(max(c.start_date) AS TIMESTAMP) AS test_limit, 1024 AS batch_size, 3::SMALLINT AS prediction_length, 10::SMALLINT AS train_epochs,
         '1M' AS frequency, 'x,y' AS static_features, 'volume' AS dynamic_features, '{''context_length'': 24}' AS model_args
       FROM counts c JOIN entities e USING (entity) GROUP BY e.nation""",
    uses="counts entities",
)
def _(t):
    # one run per nation, its time limits taken from its data
    runs = t.counts.join(t.entities.select("entity", "nation"), "entity").groupBy("nation").agg(F.max("start_date").alias("last"))
    last = F.col("last")
    shape = {
        "train_time_limit": F.add_months(last, -24), "valid_time_limit": F.add_months(last, -12), "test_time_limit": last,
        "frequency": "1M", "static_features": ["x", "y"], "dynamic_features": ["volume"],
    }
    out = results.run_row(runs, {**_CONFIG, "reshape": shape}, F.concat(F.lit("nation"), "nation"), "task1")
    return out.withColumns({c: F.array_join(c, ",") for c in ("static_features", "dynamic_features")})


@query(
    "res_5_metric_tables", "RES-5 PRJ-19",
    "SELECT entity AS item_id, CAST(sum(count) AS DOUBLE) / count(*) AS wQuantileLoss_0_5_, 'run1' AS model_id, 'task1' AS task_id FROM dense GROUP BY 1", uses="dense",
)
def _(t):
    items = t.dense.groupBy(F.col("entity").alias("item_id")).agg((F.sum("count") / F.count("*")).alias("wQuantileLoss[0.5]"))
    return results.tag_run(items, "run1", "task1")


@query(
    "res_6_map_table", "RES-6 JON-13",
    """SELECT CAST(1000000 + c_custkey * 10 AS VARCHAR) AS region_id, c_name, CAST(100000 + c_custkey AS VARCHAR) AS item_id, least(greatest(o.m, 50000.0), 200000.0) AS metric FROM customer
       JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey""",
)
def _(t):
    regions = t.customer.select((F.lit(1000000) + F.col("c_custkey") * 10).cast("string").alias("region_id"), "c_name")
    items = t.orders.groupBy((F.lit(100000) + F.col("o_custkey")).alias("item_id")).agg(F.max("o_totalprice").alias("metric"))
    return results.map_table(regions, items, "region_id", "item_id", "metric", 50000.0, 200000.0)


@query(
    "res_7_equal_breaks", "RES-7",
    """WITH m AS (SELECT entity, CAST(sum(count) AS DOUBLE) AS metric FROM counts GROUP BY 1), l AS (SELECT min(metric) AS lo, max(metric) AS hi FROM m)
       SELECT entity, metric, CAST(least(floor((metric - lo) / (hi - lo) * 5) + 1, 5) AS INTEGER) AS class FROM m, l""",
    uses="counts",
)
def _(t):
    return results.equal_breaks(t.counts.groupBy("entity").agg(F.sum("count").cast("double").alias("metric")), "metric")


_LEVELS = ",\n       ".join(
    f"""r{k} AS MATERIALIZED (SELECT c.hi, round(p.total + c.cost, 6) AS total, c.lo, p.ends FROM r{k - 1}b p JOIN c ON c.lo = p.hi),
       r{k}b AS MATERIALIZED (SELECT hi, arg_min(total, (total, lo)) AS total, arg_min(list_append(ends, hi), (total, lo)) AS ends FROM r{k} GROUP BY 1)"""
    for k in range(2, 6)
)


@query(
    "res_7_natural_breaks", "RES-7",
    f"""WITH m AS (SELECT entity, CAST(sum(count) AS DOUBLE) AS metric FROM counts GROUP BY 1), v AS (SELECT metric, CAST(count(*) AS DOUBLE) AS n FROM m GROUP BY 1),
       z AS MATERIALIZED (SELECT row_number() OVER o AS i, metric, sum(n) OVER o AS n, sum(n * metric) OVER o AS s, sum(n * metric * metric) OVER o AS q FROM v
             WINDOW o AS (ORDER BY metric) UNION ALL SELECT 0, NULL, 0, 0, 0),
       c AS MATERIALIZED (SELECT a.i AS lo, b.i AS hi, b.q - a.q - (b.s - a.s) * (b.s - a.s) / (b.n - a.n) AS cost FROM z a JOIN z b ON a.i < b.i),
       r1b AS MATERIALIZED (SELECT hi, round(cost, 6) AS total, [hi] AS ends FROM c WHERE lo = 0),
       {_LEVELS},
       e AS (SELECT unnest(ends) AS hi FROM r5b WHERE hi = (SELECT max(i) FROM z)), u AS (SELECT z.metric FROM e JOIN z ON z.i = e.hi)
       SELECT entity, metric, CAST(1 + (SELECT count(*) FROM u WHERE u.metric < m.metric) AS INTEGER) AS class FROM m""",
    uses="counts",
)
def _(t):
    rows = t.counts.groupBy("entity").agg(F.sum("count").cast("double").alias("metric"))
    return results.natural_breaks(rows, "metric")


@query(
    "res_8_month_slice", "RES-8 SCL-15 SCL-16 SCL-18",
    "WITH " + _PROBS + """ SELECT entity, start_date AS date, CASE WHEN predictions = 2 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS high_p,
        CASE WHEN predictions = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS low_p, CASE WHEN predictions = ground_truth THEN 'Correct Prediction' ELSE 'Incorrect Prediction' END AS correct
      FROM pr WHERE start_date = DATE '1999-03-01'""",
    uses="class_pairs",
)
def _(t):
    out = results.month_slice(class_results(t), "1999-03-01", ternary=True)
    return out.select("entity", "date", "high_p", "low_p", "correct")


@query(
    "res_8_month_slice_binary", "RES-8 SCL-16 SCL-18",
    "WITH " + _PROBS + """ SELECT entity, start_date AS date, CASE WHEN predictions > 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS high_p,
        CASE WHEN predictions > 0 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END AS low_p, CASE WHEN ground_truth > 0 THEN 'High Case Rate' ELSE 'Low Case Rate' END AS truth_label
      FROM pr WHERE start_date = DATE '1999-03-01'""",
    uses="class_pairs",
)
def _(t):
    two = lambda c: F.when(F.col(c) > 0, 1.0).otherwise(0.0)
    rows = class_results(t).withColumns({"predictions": two("predictions"), "ground_truth": two("ground_truth")})
    high = F.when(F.col("predictions") == 1.0, 0.75).otherwise(0.25)
    rows = rows.withColumn("probabilities", F.array(F.lit(1.0) - high, high))
    out = results.month_slice(rows, "1999-03-01", ternary=False)
    return out.select("entity", "date", "high_p", "low_p", "truth_label")


_RUN_SQL = """p AS (SELECT 'first' AS run, truth, pred FROM class_pairs WHERE entity <> 7 UNION ALL SELECT 'second', truth, truth FROM class_pairs WHERE entity <> 7),
    cls AS (SELECT DISTINCT truth AS class FROM p UNION SELECT DISTINCT pred FROM p)
    SELECT run, CAST(class AS DOUBLE) AS class, CAST(sum(CASE WHEN truth = class AND pred = class THEN 1 ELSE 0 END) AS BIGINT) AS tp,
      CAST(sum(CASE WHEN pred = class THEN 1 ELSE 0 END) AS BIGINT) AS n_predicted, CAST(sum(CASE WHEN truth = class THEN 1 ELSE 0 END) AS BIGINT) AS support
    FROM p CROSS JOIN cls GROUP BY 1, 2"""


@query("res_9_run_comparison", "RES-9 AGG-20", "WITH " + _RUN_SQL, uses="class_pairs")
def _(t):
    folder = scratch_path(t.spark, "runs")
    # rows of entity 7 carry an error, as a failed fit would leave them
    error = F.when(F.col("entity") == 7, "failed").otherwise("NONE")
    base = class_results(t).select("predictions", "ground_truth", error.alias("error"))
    write_metrics_csv(base, f"{folder}/first")
    write_metrics_csv(base.withColumn("predictions", F.col("ground_truth")), f"{folder}/second")
    runs = read_runs(t.spark, f"{folder}/*", "predictions double, ground_truth double, error string")
    return results.run_reports(runs).select("run", "class", "tp", "n_predicted", "support")


@query(
    "res_10_delta_histogram", "RES-10",
    """WITH d AS (SELECT entity, start_date, count - lag(count) OVER (PARTITION BY entity ORDER BY start_date) AS delta FROM dense), f AS (SELECT delta FROM d WHERE delta < 5),
       l AS (SELECT CAST(min(delta) AS DOUBLE) AS lo, CAST(max(delta) AS DOUBLE) AS hi FROM f)
       SELECT CAST(least(floor((delta - lo) / (hi - lo) * 40) + 1, 40) AS INTEGER) AS bin, count(*) AS n FROM f, l GROUP BY 1""",
    uses="dense",
)
def _(t):
    w = W.partitionBy("entity").orderBy("start_date")
    deltas = t.dense.withColumn("delta", F.col("count") - F.lag("count").over(w)).filter(F.col("delta") < 5)
    return metrics.histogram(deltas, "delta", 40)
