"""Sources and sinks: each query writes its input to the shared folder where the operator needs files."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators.forecast import forecast_rows

from ..operators.results import tag_run
from ..session import scratch_path
from ..sources import readers, tables, writers
from ..sources.geometry import region_centroids
from .registry import query




@query("src_1_read_parquet", "SRC-1", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(t):
    return readers.read_parquet(t.spark, t.path("supplier"))


@query(
    "src_2_read_line_list", "SRC-2 SCL-3",
    """SELECT l_suppkey, CAST(l_shipdate AS DATE) AS shipped, l_returnflag FROM lineitem
       WHERE l_shipdate >= DATE '1996-01-01'""",
)
def _(t):
    path = scratch_path(t.spark, "parts")
    t.lineitem.withColumn("shipped", F.date_format("l_shipdate", "yyyyMMdd")).write.parquet(path)
    return readers.read_line_list(
        t.spark, f"{path}/*.parquet", ["l_suppkey", "shipped", "l_returnflag"], "shipped", 1996
    )


@query(
    "src_3_consolidate_years", "SRC-3",
    "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1",
)
def _(t):
    path = scratch_path(t.spark, "years")
    parts = t.lineitem.withColumn("year", F.year("l_shipdate"))
    early = parts.filter(F.col("year") < 1998)
    writers.consolidate_years(early, path)
    writers.consolidate_years(parts, path)  # the years already written are skipped
    return t.spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("src_4_read_csv", "SRC-4", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    path = scratch_path(t.spark, "csv")
    t.customer.write.option("header", True).csv(path)
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return readers.read_csv(t.spark, path, schema)


@query(
    "src_5_parameter_csvs", "SRC-5 FLT-1 FLT-6 PRJ-4 SCL-2",
    """SELECT entity AS muni_id, coalesce(CASE WHEN low_tax > 0 THEN low_tax END, -999.0) AS low_tax, start_date, end_date
       FROM parameters WHERE entity <> 7""",
    uses="parameters",
)
def _(t):
    path = scratch_path(t.spark, "exports")
    t.parameters.select(
        F.col("entity").alias("CD_MUN"), F.when(F.col("low_tax") > 0, F.col("low_tax")).alias("median"),
        F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"),
    ).write.option("header", True).csv(f"{path}/low_tax_1995.csv")
    return readers.read_parameter_csvs(t.spark, path, "low_tax", excluded=[7])


def _write_variables(t) -> tuple[str, str, str]:
    path = scratch_path(t.spark, "variables")
    start, end = "1995-01-01", "2002-01-01"
    for name in ("volume", "top_price", "low_tax"):
        t.parameters.select("entity", "end_date", "start_date", name).write.parquet(f"{path}/{name}_{start}_{end}.parquet")
    return path, start, end


@query(
    "src_6_discover_variables", "SRC-6 SCL-5",
    "SELECT * FROM (VALUES ('volume'), ('top_price'), ('low_tax')) v(variable)",
)
def _(t):
    path, _, _ = _write_variables(t)
    return readers.variables_in(t.spark, path).select("variable")


@query(
    "src_6_join_discovered", "SRC-6 JON-6",
    """SELECT entity, end_date, start_date, low_tax, start_date AS start_date_top_price, top_price,
         start_date AS start_date_volume, volume FROM parameters""",
    uses="parameters",
)
def _(t):
    path, start, end = _write_variables(t)
    names = sorted(r["variable"] for r in readers.variables_in(t.spark, path).collect())  # one row per dataset
    return readers.read_variables(t.spark, path, names, start, end, ["entity", "end_date"])


@query(
    "src_7_wide_null_token", "SRC-7",
    """SELECT CAST(entity AS VARCHAR) AS entity, year, CAST(pop AS BIGINT) AS pop FROM raw_exposure""",
    uses="raw_exposure",
)
def _(t):
    path = scratch_path(t.spark, "wide")
    years = [str(y) for y in range(1995, 2002)]
    t.wide_exposure.select("entity", *[F.col(y).cast("long").alias(y) for y in years]).write.option(
        "header", True
    ).option("nullValue", "...").csv(path)
    wide = readers.read_wide_years(t.spark, path, "entity", range(1995, 2002))
    return wide.unpivot("entity", years, "year", "pop").withColumn("year", F.col("year").cast("int"))


@query(
    "src_8_load_complete", "SRC-8 FLT-5 PRJ-2",
    "SELECT entity, start_date, count, pop, cases_per_100k FROM panel WHERE pop IS NOT NULL AND cases_per_100k IS NOT NULL",
    uses="panel",
)
def _(t):
    path = scratch_path(t.spark, "panel")
    writers.write_parquet(t.panel, path, ["year"])
    return readers.read_complete(t.spark, path, ["month", "year"])


@query(
    "src_9_region_centroids", "SRC-9",
    """WITH v AS (SELECT entity AS region, row_number() OVER (PARTITION BY entity ORDER BY start_date) - 1 AS no,
           CAST(month AS DOUBLE) AS x, CAST(count AS DOUBLE) AS y FROM panel),
       n AS (SELECT *, lead(x) OVER w AS bx, lead(y) OVER w AS by_, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy
             FROM v WINDOW w AS (PARTITION BY region ORDER BY no)),
       c AS (SELECT region, x AS ax, y AS ay, coalesce(bx, fx) AS bx, coalesce(by_, fy) AS byy FROM n),
       s AS (SELECT region, sum(ax * byy - bx * ay) AS a2, sum((ax + bx) * (ax * byy - bx * ay)) AS cx,
             sum((ay + byy) * (ax * byy - bx * ay)) AS cy FROM c GROUP BY 1)
       SELECT region, a2 / 2.0 AS area, round(CASE WHEN a2 <> 0 THEN cx / (a2 * 3) END, 6) AS x_centroid,
         round(CASE WHEN a2 <> 0 THEN cy / (a2 * 3) END, 6) AS y_centroid FROM s""",
    uses="panel",
)
def _(t):
    # each entity's (month, count) points in date order, closed by the last edge, serve as its outline
    number = F.row_number().over(W.partitionBy("entity").orderBy("start_date")) - 1
    vertices = t.panel.select(
        F.col("entity").alias("region"), number.alias("vertex_no"), F.col("month").cast("double").alias("x"),
        F.col("count").cast("double").alias("y"),
    )
    out = region_centroids(vertices)
    return out.withColumns({c: F.round(c, 6) for c in ("x_centroid", "y_centroid")})


def _forecasts(t):
    series = t.counts.groupBy("entity").agg(
        F.min("start_date").alias("start_date"),
        F.transform(F.array_sort(F.collect_list(F.struct("start_date", "count"))), lambda x: x["count"].cast("double")).alias("means"),
    )
    return forecast_rows(series, "entity", "start_date", "means", "run1", "task1")


_FORECAST_SQL = """SELECT 'run1' AS model_id, 'task1' AS task_id, CAST(entity AS VARCHAR) AS muni_id,
    CAST(first AS TIMESTAMP) AS start_date, CAST(first + to_months(CAST(n AS INTEGER)) AS TIMESTAMP) AS predict_date,
    CAST(n AS SMALLINT) AS step, 'M' AS time_unit, CAST(count AS DOUBLE) AS mean
    FROM (SELECT *, min(start_date) OVER (PARTITION BY entity) AS first,
            row_number() OVER (PARTITION BY entity ORDER BY start_date) - 1 AS n FROM counts)"""


def _result_table(t, kind: str):
    path = scratch_path(t.spark, kind)
    table = f"panelkit_{kind}_{path.rsplit('-', 1)[1]}"
    return tables.create_table(t.spark, kind, table, path)


@query("src_10_read_result_table", "SRC-10 SNK-3 SNK-4", _FORECAST_SQL, uses="counts")
def _(t):
    name = _result_table(t, "predictions")
    tables.append_by_name(_forecasts(t), name)
    return t.spark.table(name)


@query("snk_1_write_parquet", "SNK-1", "SELECT entity, start_date, count FROM dense", uses="dense")
def _(t):
    path = scratch_path(t.spark, "dense")
    writers.write_parquet(t.dense, path)
    return t.spark.read.parquet(path)


@query("snk_2_csv_per_entity", "SNK-2", "SELECT entity, start_date, count FROM dense", uses="dense")
def _(t):
    path = scratch_path(t.spark, "per-entity")
    writers.write_csv_per_entity(t.dense, path)
    return readers.read_csv(t.spark, path, "start_date date, count long, entity long")


@query(
    "snk_4_append_by_name", "SNK-3 SNK-4 RES-5 PRJ-19",
    """SELECT CAST(entity AS VARCHAR) AS item_id, CAST(avg(count * count) AS DOUBLE) AS MSE,
         CAST(sum(count) AS DOUBLE) AS QuantileLoss_0_5_, 'run1' AS model_id, 'task1' AS task_id FROM counts GROUP BY 1""",
    uses="counts",
)
def _(t):
    name = _result_table(t, "item_metrics")
    items = t.counts.groupBy(F.col("entity").alias("item_id")).agg(
        F.sum("count").alias("QuantileLoss[0.5]"), F.avg(F.col("count") * F.col("count")).alias("MSE")
    )
    tables.append_by_name(tag_run(items, "run1", "task1"), name)
    return t.spark.table(name).select("item_id", "MSE", "QuantileLoss_0_5_", "model_id", "task_id")


@query(
    "snk_4_retried_append", "SNK-3 SNK-4",
    f"WITH f AS ({_FORECAST_SQL}) SELECT *, 'run1' AS run_key FROM f UNION ALL SELECT *, 'run2' FROM f WHERE step > 0",
    uses="counts",
)
def _(t):
    path = scratch_path(t.spark, "runs")
    forecasts = _forecasts(t)
    for key, rows in (("run1", forecasts), ("run2", forecasts.filter("step > 0")), ("run1", forecasts)):  # the last one is a retry
        tables.append_once(rows, "predictions", path, key)
    return tables.read_runs(t.spark, "predictions", path)


@query("snk_5_export_table", "SNK-5", _FORECAST_SQL, uses="counts")
def _(t):
    name = _result_table(t, "predictions")
    tables.append_by_name(_forecasts(t), name)
    path = scratch_path(t.spark, "export")
    tables.export_table(t.spark, name, path)
    return t.spark.read.parquet(path)


@query(
    "snk_6_manifest", "SNK-6",
    """SELECT DISTINCT 'lineitem/' || l_returnflag AS collection, l_linestatus AS parameter, DATE '1995-01-01' AS start_date,
         DATE '2002-01-01' AS end_date, 'months' AS time_units, true AS population_weighted,
         'median' AS time_aggregation, 'median' AS space_aggregation FROM lineitem""",
)
def _(t):
    path = scratch_path(t.spark, "manifest")
    sets = t.lineitem.select(
        F.concat(F.lit("lineitem/"), "l_returnflag").alias("collection"), F.col("l_linestatus").alias("parameter")
    ).distinct()
    writers.append_manifest(sets, path, "1995-01-01", "2002-01-01", "months", "median")
    return t.spark.read.parquet(path).drop("date_written")


@query(
    "snk_7_metrics_csv", "SNK-7",
    "SELECT l_suppkey AS item_id, count(*) AS n, max(l_quantity) AS top FROM lineitem GROUP BY 1",
)
def _(t):
    path = scratch_path(t.spark, "metrics")
    writers.write_metrics_csv(
        t.lineitem.groupBy(F.col("l_suppkey").alias("item_id")).agg(F.count("*").alias("n"), F.max("l_quantity").alias("top")), path
    )
    return readers.read_csv(t.spark, path, "item_id long, n long, top double")


@query(
    "snk_3_result_tables", "SNK-3",
    """SELECT CAST(count(*) AS BIGINT) AS rows, 'predictions' AS name FROM counts
       UNION ALL SELECT count(DISTINCT entity), 'item_metrics' FROM counts
       UNION ALL SELECT 1, 'agg_metrics' UNION ALL SELECT 0, 'model_runs'""",
    uses="counts",
)
def _(t):
    names = {kind: _result_table(t, kind) for kind in tables.SCHEMAS}
    tables.append_by_name(_forecasts(t), names["predictions"])
    items = t.counts.groupBy(F.col("entity").alias("item_id")).agg(F.avg("count").alias("MSE"))
    tables.append_by_name(tag_run(items, "run1", "task1"), names["item_metrics"])
    tables.append_by_name(tag_run(items.agg(F.avg("MSE").alias("MSE")), "run1", "task1"), names["agg_metrics"])
    out = None
    for kind, name in names.items():
        one = t.spark.table(name).agg(F.count("*").alias("rows")).withColumn("name", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out
