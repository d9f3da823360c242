"""The driver's tables in the shapes the operators expect, in Spark and as oracle sub-selects.

Cases are line items per supplier, exposure is the quantity per supplier and year, parameters are
monthly aggregates per supplier, the global index is made from orders per month.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.dates import shift
from ..operators.fills import fill_exposure
from ..operators.periods import add_rate, count_by_period, densify, unpivot_years
from ..operators.schema import blank_columns
from ..operators.targets import relative_ternary

UNKNOWN_YEARS = ["1997", "1999"]
TRAIN_START, TRAIN_END, TEST_END = "1997-01-01", "2000-01-01", "2002-01-01"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


class Tables:
    """Lazy access to the tables of one data folder and to the shapes derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(self.path(name))
        raise AttributeError(name)

    @cached_property
    def line_list(self) -> DataFrame:
        """One row per case."""
        return self.lineitem.select(
            F.col("l_suppkey").alias("entity"),
            F.to_date("l_shipdate").alias("event_date"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_partkey").alias("part"),
            F.col("l_orderkey").alias("order_id"),
        )

    @cached_property
    def entities(self) -> DataFrame:
        return self.supplier.select(
            F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"),
            F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"),
        )

    @cached_property
    def counts(self) -> DataFrame:
        """Cases per entity and month, present months only."""
        return count_by_period(self.line_list, "month")

    @cached_property
    def dense(self) -> DataFrame:
        """``counts`` with a zero row for every entity without cases in a month."""
        return densify(self.counts, self.entities, {"count": 0})

    @cached_property
    def years(self) -> list[int]:
        """Years that the line list has, a few rows."""
        found = self.line_list.select(F.year("event_date").alias("y")).filter("y is not null").distinct().collect()
        return sorted(r["y"] for r in found)

    @cached_property
    def wide_exposure(self) -> DataFrame:
        """Exposure per entity with one column per year; two years unknown, some first years too."""
        dated = self.line_list.withColumn("_y", F.year("event_date"))
        yearly = dated.groupBy("entity").pivot("_y", self.years).agg(F.sum("quantity"))
        known = blank_columns(yearly, UNKNOWN_YEARS, "double")
        first = str(self.years[0])
        return known.join(self.entities.select("entity", "balance"), "entity").select(
            "entity",
            F.when(F.col("balance") >= 0, F.col(first)).alias(first),
            *[F.col(str(y)) for y in self.years[1:]],
        )

    @cached_property
    def raw_exposure(self) -> DataFrame:
        return unpivot_years(self.wide_exposure, "entity", self.years)

    @cached_property
    def exposure(self) -> DataFrame:
        return fill_exposure(self.raw_exposure)

    @cached_property
    def panel(self) -> DataFrame:
        """Dense panel with exposure and rate."""
        keyed = self.dense.withColumns({"year": F.year("start_date"), "month": F.month("start_date")})
        return add_rate(keyed.join(self.exposure, ["entity", "year"], "left")).select(
            "entity", "start_date", "year", "month", "count", "pop", "cases_per_100k"
        )

    @cached_property
    def parameters(self) -> DataFrame:
        """One row per entity and month end, labelled with the end of the period."""
        return self._parameters()

    @cached_property
    def wide_parameters(self) -> DataFrame:
        """The same with two more aggregates of the line list."""
        return self._parameters("mean_price", "low_quantity")

    def _parameters(self, *extra: str) -> DataFrame:
        monthly = count_by_period(
            self.line_list, "month",
            aggs={
                "volume": F.sum("quantity"), "top_price": F.max("price"), "low_tax": F.min("tax"), "mean_price": F.avg("price"),
                "low_quantity": F.min("quantity"),
            },
        )
        return monthly.select(
            "entity", "start_date", shift(F.col("start_date"), 1, "month").alias("end_date"), "volume", "top_price",
            "low_tax", *extra,
        )

    @cached_property
    def index(self) -> DataFrame:
        """Global monthly index."""
        return self.orders.groupBy(
            F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
        ).agg(F.count("*").alias("anomaly"), F.max("o_totalprice").alias("peak"))

    @cached_property
    def pixels(self) -> DataFrame:
        """Raster values: pixel, region, date, value and weight."""
        return self.lineitem.select(
            F.col("l_partkey").alias("pixel"), F.col("l_suppkey").alias("region"),
            F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("value"),
            F.col("l_quantity").alias("weight"),
        )

    @cached_property
    def daily(self) -> DataFrame:
        """Second line list: one row per event."""
        return self.events.select(
            F.col("user_id").alias("entity"), F.to_date("ts").alias("event_date"), F.col("event_type").alias("kind"),
            F.col("value"), F.col("event_id"), F.col("ts"),
        )

    @cached_property
    def class_pairs(self) -> DataFrame:
        """Predicted and true class per entity and month: last month's relative class predicts this one."""
        labelled = self.relative
        w = W.partitionBy("entity").orderBy("start_date")
        return (
            labelled.select(
                "entity", "start_date", F.col("cat_target").alias("truth"), F.lag("cat_target").over(w).alias("pred")
            )
            .filter(F.col("pred").isNotNull())
        )

    @cached_property
    def relative(self) -> DataFrame:
        return relative_ternary(self.panel, None, ("entity", "month"), "count")[0]


# name -> (sub-selects needed, SQL)
CTES: dict[str, tuple[str, str]] = {
    "line_list": (
        "",
        """SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS event_date, l_quantity AS quantity,
           l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_returnflag AS flag, l_partkey AS part,
           l_orderkey AS order_id FROM lineitem""",
    ),
    "entities": (
        "",
        "SELECT s_suppkey AS entity, s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier",
    ),
    "counts": (
        "line_list",
        """SELECT entity, CAST(date_trunc('month', event_date) AS DATE) AS start_date, count(*) AS count
           FROM line_list GROUP BY 1, 2""",
    ),
    "dense": (
        "counts entities",
        """SELECT e.entity, p.start_date, coalesce(c.count, 0) AS count
           FROM entities e CROSS JOIN (SELECT DISTINCT start_date FROM counts) p
           LEFT JOIN counts c ON c.entity = e.entity AND c.start_date = p.start_date""",
    ),
    "raw_exposure": (
        "line_list entities",
        """SELECT e.entity, y.year,
             CASE WHEN y.year IN (1997, 1999) THEN NULL WHEN y.year = 1995 AND e.balance < 0 THEN NULL ELSE q.pop END AS pop
           FROM (SELECT DISTINCT entity FROM line_list) l JOIN entities e USING (entity)
           CROSS JOIN (SELECT CAST(range AS INTEGER) AS year FROM range(1995, 2002)) y
           LEFT JOIN (SELECT entity, CAST(year(event_date) AS INTEGER) AS year, sum(quantity) AS pop
                      FROM line_list GROUP BY 1, 2) q ON q.entity = e.entity AND q.year = y.year""",
    ),
    "interpolated": (
        "raw_exposure",
        """SELECT entity, year, pop AS raw,
             CASE WHEN pop IS NOT NULL THEN pop
                  ELSE lv + (rv - lv) * (pos - lp) / (rp - lp) END AS pop
           FROM (SELECT *,
               last_value(pop IGNORE NULLS) OVER b AS lv,
               last_value(CASE WHEN pop IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS lp,
               first_value(pop IGNORE NULLS) OVER a AS rv,
               first_value(CASE WHEN pop IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS rp
             FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year) AS pos FROM raw_exposure)
             WINDOW b AS (PARTITION BY entity ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    a AS (PARTITION BY entity ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    ),
    "exposure": (
        "interpolated",
        """SELECT entity, year, first_value(pop IGNORE NULLS) OVER (PARTITION BY entity ORDER BY year
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pop FROM interpolated""",
    ),
    "panel": (
        "dense exposure",
        """SELECT d.entity, d.start_date, CAST(year(d.start_date) AS INTEGER) AS year,
             CAST(month(d.start_date) AS INTEGER) AS month, d.count, x.pop,
             CASE WHEN x.pop = 0 THEN NULL ELSE d.count / (x.pop / 100000.0) END AS cases_per_100k
           FROM dense d LEFT JOIN exposure x ON x.entity = d.entity AND x.year = year(d.start_date)""",
    ),
    "parameters": (
        "line_list",
        """SELECT entity, CAST(date_trunc('month', event_date) AS DATE) AS start_date,
             CAST(date_trunc('month', event_date) + INTERVAL 1 MONTH AS DATE) AS end_date,
             sum(quantity) AS volume, max(price) AS top_price, min(tax) AS low_tax FROM line_list GROUP BY 1, 2, 3""",
    ),
    "idx": (
        "",
        """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
             count(*) AS anomaly, max(o_totalprice) AS peak FROM orders GROUP BY 1, 2""",
    ),
    "pixels": (
        "",
        """SELECT l_partkey AS pixel, l_suppkey AS region, CAST(l_shipdate AS DATE) AS date,
             l_extendedprice AS value, l_quantity AS weight FROM lineitem""",
    ),
    "daily": (
        "",
        """SELECT user_id AS entity, CAST(ts AS DATE) AS event_date, event_type AS kind, value, event_id, ts
           FROM events""",
    ),
    "expected": (
        "panel",
        "SELECT entity, month, CAST(sum(count) AS DOUBLE) / count(count) AS expected FROM panel GROUP BY 1, 2",
    ),
    "relative": (
        "panel expected",
        """SELECT p.*, CASE WHEN p.count <= x.expected * 0.5 THEN '0' WHEN p.count <= x.expected THEN '1'
             ELSE '2' END AS cat_target FROM panel p JOIN expected x USING (entity, month)""",
    ),
    "class_pairs": (
        "relative",
        """SELECT * FROM (SELECT entity, start_date, cat_target AS truth,
             lag(cat_target) OVER (PARTITION BY entity ORDER BY start_date) AS pred FROM relative) WHERE pred IS NOT NULL""",
    ),
}
