"""Whole runs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import flows
from .aggregates import _AGG_COLUMNS, _AGG_SELECT, _ITEM
from .registry import query
from .standins import TEST_END, TRAIN_END, TRAIN_START


@query(
    "run_case_panel_weekly", "SRC-2 JON-4 AGG-1 AGG-4 PRJ-9 SET-2",
    """WITH r AS (SELECT l.entity, l.event_date, x.year, x.pop, e.name FROM line_list l JOIN raw_exposure x ON x.entity = l.entity AND x.year = year(l.event_date)
           JOIN entities e ON e.entity = l.entity WHERE x.pop IS NOT NULL),
       w AS (SELECT entity, CAST(date_trunc('week', event_date) AS DATE) AS start_date, count(*) AS count, CAST(min(year) AS INTEGER) AS year, arg_min(pop, year) AS pop, any_value(name) AS name FROM r GROUP BY 1, 2),
       s AS (SELECT e.entity, p.start_date FROM (SELECT DISTINCT entity FROM raw_exposure) e CROSS JOIN (SELECT DISTINCT start_date FROM w) p)
       SELECT s.entity, s.start_date, coalesce(w.year, CAST(year(s.start_date) AS INTEGER)) AS year, coalesce(w.count, 0) AS count, coalesce(w.pop, x.pop) AS pop,
         CASE WHEN w.entity IS NULL THEN 0.0::DOUBLE ELSE w.count / (w.pop / 100000.0) END AS cases_per_100k, coalesce(w.name, n.name) AS name
       FROM s LEFT JOIN w ON w.entity = s.entity AND w.start_date = s.start_date
       LEFT JOIN raw_exposure x ON x.entity = s.entity AND x.year = coalesce(w.year, year(s.start_date)) LEFT JOIN entities n ON n.entity = s.entity""",
    uses="line_list raw_exposure entities",
)
def _(t):
    events = t.line_list.select("entity", "event_date")
    return flows.case_panel(events, t.raw_exposure, t.entities.select("entity", "name"), "week")


@query(
    "run_merge_panels", "PRJ-4 PRJ-5 JON-1 JON-16",
    "SELECT q.entity, q.start_date, q.volume, q.top_price, d.count FROM parameters q JOIN dense d USING (entity, start_date)",
    uses="parameters dense",
)
def _(t):
    text = t.parameters.select(
        F.col("entity").cast("string").alias("muni_id"), F.col("start_date").cast("string").alias("start_date"), "volume", "top_price"
    )
    return flows.merge_panels(text, t.dense, renames={"muni_id": "entity"})[0]


@query("run_classifier_trees", "ML-1 ML-2 RES-1")
def _(t):
    return flows.run_classifier(
        t.panel, TRAIN_START, TRAIN_END, TEST_END, "relative_binary", "trees", target="count", dense=True
    )


@query("run_classifier_local_report", "ML-4 SPL-5 AGG-20")
def _(t):
    run = flows.run_classifier(t.panel, TRAIN_START, TRAIN_END, TEST_END, "relative_ternary", "local", target="count", dense=True)
    return flows.classify_report(run)[1]


CONFIG = {
    "base": {"model": "seasonal"},
    "reshape": {
        "item_id": "entity", "time_stamp": "start_date", "target": "count", "frequency": "1M", "train_time_limit": "1999-01-01",
        "valid_time_limit": "2000-01-01", "test_time_limit": "2002-01-01",
    },
    "general_model": {"train_batch_size": 1024, "prediction_length": 3, "epochs": 10},
}


@query(
    "run_forecast_metrics", "ML-9 AGG-22 AGG-23 RES-5",
    "WITH " + _ITEM + f" SELECT 'run1' AS model_id, 'task1' AS task_id, {_AGG_SELECT} FROM items", uses="dense",
)
def _(t):
    out = flows.run_forecast(t.dense, CONFIG, "run1", "task1")["agg_metrics"]
    return out.select("model_id", "task_id", *[F.round(c, 5).alias(c) for c in _AGG_COLUMNS])
