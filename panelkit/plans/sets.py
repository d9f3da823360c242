"""Set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.zonal import presence_records
from .registry import query


@query(
    "set_1_vertical_concat", "SET-1",
    "SELECT 'cases' AS run, entity, count(*) AS n FROM line_list GROUP BY 2 UNION ALL SELECT 'events', entity, count(*) FROM daily GROUP BY 2",
    uses="line_list daily",
)
def _(t):
    a = t.line_list.groupBy("entity").agg(F.count("*").alias("n")).withColumn("run", F.lit("cases"))
    b = t.daily.groupBy("entity").agg(F.count("*").alias("n")).withColumn("run", F.lit("events"))
    return a.unionByName(b)


@query(
    "set_2_append_fixed_order", "SET-2",
    "SELECT entity, start_date, count FROM dense", uses="dense",
)
def _(t):
    blanks = t.dense.select("entity", "start_date").join(t.counts, ["entity", "start_date"], "left_anti")
    extra = blanks.withColumn("count", F.lit(0).cast("long")).select("count", "start_date", "entity")
    return t.counts.unionByName(extra).select(t.counts.columns)


@query(
    "set_3_difference", "SET-3",
    "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
)
def _(t):
    return t.customer.select("c_custkey").subtract(
        t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    )


@query(
    "set_4_presence_absence", "SET-4",
    """SELECT event_id, entity, event_date AS date, CASE WHEN kind = 'error' THEN 1 ELSE 0 END AS presence,
         CAST(event_date - INTERVAL 10 DAY AS DATE) AS back_date FROM daily""",
    uses="daily",
)
def _(t):
    rows = t.daily.select("event_id", "entity", F.col("event_date").alias("date"), "kind")
    here, away = rows.filter(F.col("kind") == "error"), rows.filter(F.col("kind") != "error")
    return presence_records(here.drop("kind"), away.drop("kind"), 10)


@query(
    "set_5_distinct_in_order", "SET-5",
    "SELECT entity, min(event_id) AS first_seen FROM daily GROUP BY 1 ORDER BY 2", uses="daily",
)
def _(t):
    return t.daily.groupBy("entity").agg(F.min("event_id").alias("first_seen")).orderBy("first_seen")
