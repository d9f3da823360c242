"""Calendar spines and range joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import shift
from ..operators import periods, zonal
from .registry import query
from .windows import _DAILY_C, _UPSAMPLED, _daily_counts


@query("cal_1_upsample_daily", "CAL-1", f"WITH {_DAILY_C}, {_UPSAMPLED} SELECT * FROM up", uses="daily")
def _(t):
    return periods.upsample_daily(_daily_counts(t))


def _ranges(t):
    return t.counts.groupBy("entity").agg(F.min("start_date").alias("start"), F.add_months(F.max("start_date"), 1).alias("end"))


_RANGES = "r AS (SELECT entity, min(start_date) AS a, CAST(max(start_date) + INTERVAL 1 MONTH AS DATE) AS b FROM counts GROUP BY 1)"


@query(
    "cal_2_chunk_ranges", "CAL-2",
    f"""WITH {_RANGES}, c AS (SELECT entity, a AS start, b AS "end", CAST(unnest(generate_series(a, b, INTERVAL 24 MONTH)) AS DATE) AS chunk_start FROM r)
        SELECT entity, start, "end", chunk_start, CAST(least(chunk_start + INTERVAL 24 MONTH, "end") AS DATE) AS chunk_end FROM c WHERE chunk_start < "end" """,
    uses="counts",
)
def _(t):
    return periods.chunk_ranges(_ranges(t), "start", "end", 24)


@query(
    "cal_3_explode_units", "CAL-3 UDF-4",
    f"""WITH {_RANGES}, c AS (SELECT entity, b, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS unit_start FROM r)
        SELECT entity, CAST(row_number() OVER (PARTITION BY entity ORDER BY unit_start) - 1 AS INTEGER) AS unit_no, unit_start, CAST(unit_start + INTERVAL 1 MONTH AS DATE) AS unit_end
        FROM c WHERE unit_start < b""",
    uses="counts",
)
def _(t):
    return periods.explode_units(_ranges(t), "start", "end").select("entity", "unit_no", "unit_start", "unit_end")


@query(
    "cal_4_align_labels", "CAL-4 JON-1",
    "SELECT c.entity, c.start_date, q.end_date, c.count, q.volume FROM counts c JOIN parameters q ON q.entity = c.entity AND q.end_date = c.start_date + INTERVAL 1 MONTH",
    uses="counts parameters",
)
def _(t):
    keyed = t.counts.withColumn("end_date", shift(F.col("start_date"), 1, "month"))
    return keyed.join(t.parameters.select("entity", "end_date", "volume"), ["entity", "end_date"])


@query(
    "cal_5_lookback_histogram", "CAL-5 AGG-30 SET-4",
    """WITH r AS (SELECT DISTINCT entity, event_date AS date FROM daily WHERE kind = 'error')
       SELECT r.entity, r.date, """ + ", ".join(
        f"CAST(count(CASE WHEN d.value >= {20 * k} AND d.value < {20 * (k + 1)} THEN 1 END) AS BIGINT) AS \"{k + 1}value\"" for k in range(5)
    ) + """ FROM r LEFT JOIN daily d ON d.entity = r.entity AND d.event_date >= r.date - INTERVAL 10 DAY AND d.event_date < r.date GROUP BY 1, 2""",
    uses="daily",
)
def _(t):
    records = t.daily.filter(F.col("kind") == "error").select("entity", F.col("event_date").alias("date"))
    return zonal.lookback_histogram(records, t.daily, ["entity"], "date", "event_date", "value", 10, 0, 100, 5, "value")


@query(
    "cal_6_completeness", "CAL-6",
    """SELECT p_brand AS dataset, CASE WHEN p_brand IN (SELECT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity = 50 AND l_discount = 0)
         THEN 'complete' ELSE 'missing' END AS status FROM (SELECT DISTINCT p_brand FROM part)""",
)
def _(t):
    expected = t.part.select(F.col("p_brand").alias("dataset")).distinct()
    hit = t.lineitem.filter((F.col("l_quantity") == 50) & (F.col("l_discount") == 0)).select(F.col("l_partkey").alias("p_partkey"))
    found = t.part.join(hit, "p_partkey", "left_semi").select(F.col("p_brand").alias("dataset"))
    return periods.missing_datasets(expected, found, "dataset")
