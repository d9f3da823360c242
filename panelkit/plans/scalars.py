"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, dates, numeric, text
from ..operators import ranking, results
from .labels_splits import class_results
from .registry import query


@query("scl_1_prefix", "SCL-1", "SELECT c_custkey, substring(c_name, 1, 6) AS head, left(c_name, length(c_name) - 1) AS trimmed FROM customer")
def _(t):
    name = F.col("c_name")
    return t.customer.select("c_custkey", text.prefix(name).alias("head"), text.drop_last(name).alias("trimmed"))


@query(
    "scl_2_parse_date", "SCL-2",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders",
)
def _(t):
    written = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("s"))
    return written.select("o_orderkey", text.parse_date(F.col("s")).alias("day"))


@query(
    "scl_3_try_parse_date", "SCL-3",
    "SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(ts AS DATE) END AS day FROM events",
)
def _(t):
    stamp = F.date_format("ts", "yyyyMMdd")
    broken = F.when(F.col("event_type") == "error", F.concat(F.lit("x"), stamp)).otherwise(stamp)
    return t.events.select("event_id", text.try_parse_date(broken).alias("day"))


@query(
    "scl_4_extract_numbers", "SCL-4 UDF-5",
    """SELECT event_id, CAST(list_sum(list_transform(regexp_extract_all(' ' || printf('%.2f', value) || ' ' || printf('%.2f', value + 1.5), '\\s[0-9]*\\.[0-9]*'),
         lambda x: CAST(round(CAST(trim(x) AS DOUBLE) * 100) AS BIGINT))) AS BIGINT) AS cents FROM events""",
)
def _(t):
    written = F.concat(F.lit(" "), F.format_string("%.2f", "value"), F.lit(" "), F.format_string("%.2f", F.col("value") + 1.5))
    parts = F.transform(text.decimals_in(written), lambda x: F.round(x * 100).cast("long"))
    return t.events.select("event_id", F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x).alias("cents"))


@query(
    "scl_5_names_from_paths", "SCL-5",
    """SELECT page_id, regexp_extract(url, '([^/]+)$', 1) AS base,
         regexp_extract('/d/v' || page_id || '_2001-01-01_2021-01-01.parquet', '([^/]+?)_\\d{4}-\\d{2}-\\d{2}_\\d{4}-\\d{2}-\\d{2}\\.parquet', 1) AS variable FROM pages""",
)
def _(t):
    path = F.concat(F.lit("/d/v"), "page_id", F.lit("_2001-01-01_2021-01-01.parquet"))
    return t.pages.select("page_id", text.basename(F.col("url")).alias("base"), text.variable_from_path(path).alias("variable"))


@query(
    "scl_6_casts", "SCL-6",
    "SELECT c_custkey, CAST(regexp_replace(c_name, '\\D', '', 'g') AS BIGINT) AS number, CAST(c_nationkey AS VARCHAR) AS nation, CAST(CAST(c_nationkey AS VARCHAR) AS DOUBLE) AS label FROM customer",
)
def _(t):
    digits = F.regexp_replace("c_name", r"\D", "")
    nation = F.col("c_nationkey").cast("string")
    return t.customer.select("c_custkey", digits.cast("long").alias("number"), nation.alias("nation"), nation.cast("double").alias("label"))


@query("scl_7_month", "SCL-7", "SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.month("o_orderdate").alias("month"))


@query(
    "scl_8_calendar_offsets", "SCL-8",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS next_month, CAST(CAST(o_orderdate AS DATE) - INTERVAL 2 YEAR AS DATE) AS back_two_years,
         CAST(CAST(o_orderdate AS DATE) - INTERVAL 60 DAY AS DATE) AS back_days FROM orders""",
)
def _(t):
    day = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey", dates.shift(day, 1, "month").alias("next_month"), dates.shift(day, -2, "year").alias("back_two_years"),
        dates.shift(day, -60, "day").alias("back_days"),
    )


@query(
    "scl_9_units_between", "SCL-9",
    """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
       SELECT o_orderkey, CAST(datesub('month', DATE '1992-03-01', d) AS INTEGER) AS months, CAST(floor(datediff('day', DATE '1992-03-01', d) / 7.0) AS INTEGER) AS weeks,
         CAST(datesub('year', DATE '1992-03-01', d) * 52 + (datesub('month', DATE '1992-03-01', d) % 12) * 4
           + floor(datediff('day', CAST(DATE '1992-03-01' + to_months(CAST(datesub('month', DATE '1992-03-01', d) AS INTEGER)) AS DATE), d) / 7.0) AS INTEGER) AS rough_weeks FROM d""",
)
def _(t):
    end, start = F.to_date("o_orderdate"), F.lit("1992-03-01").cast("date")
    return t.orders.select(
        "o_orderkey", dates.units_between(end, start, "month").alias("months"), dates.units_between(end, start, "week").alias("weeks"),
        dates.units_between(end, start, "week", approximate=True).alias("rough_weeks"),
    )


@query("scl_10_from_ymd", "SCL-10", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def _(t):
    return t.events.select("event_id", dates.from_ymd(F.year("ts"), F.month("ts"), F.day("ts")).alias("day"))


@query(
    "scl_11_conditions", "SCL-11",
    "SELECT event_id, CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'medium' ELSE 'high' END AS band FROM events",
)
def _(t):
    v = F.col("value")
    return t.events.select("event_id", F.when(v < 10, "low").when(v < 50, "medium").otherwise("high").alias("band"))


@query(
    "scl_12_cut", "SCL-12 TGT-2",
    "SELECT o_orderkey, CASE WHEN o_totalprice <= 100000 THEN '0' WHEN o_totalprice <= 300000 THEN '1' ELSE '2' END AS cls FROM orders",
)
def _(t):
    return t.orders.select("o_orderkey", numeric.right_closed_bins(F.col("o_totalprice"), [100000, 300000], ["0", "1", "2"]).alias("cls"))


@query(
    "scl_13_rank_quantile_cut", "SCL-13 WIN-8",
    """WITH r AS (SELECT entity, start_date, count, row_number() OVER (PARTITION BY entity, month ORDER BY count, start_date) AS rank FROM panel),
       q AS (SELECT quantile_cont(rank, [0.1, 0.3, 0.5]) AS b FROM r)
       SELECT entity, start_date, count, CAST(rank AS INTEGER) AS rank, CASE WHEN rank <= b[1] THEN 'low' WHEN rank <= b[2] THEN 'medium' WHEN rank <= b[3] THEN 'high' ELSE 'very_high' END AS qcut FROM r, q""",
    uses="panel",
)
def _(t):
    ranked = ranking.ordinal_rank(t.panel.select("entity", "start_date", "month", "count"), ["entity", "month"], ["count", "start_date"])
    return ranking.quantile_cut_ranks(ranked, "rank", [0.1, 0.3, 0.5], ["low", "medium", "high", "very_high"], "qcut").drop("month")


@query(
    "scl_14_math", "SCL-14",
    "SELECT p_partkey, abs(p_retailprice - 1200) AS gap, round(sqrt(p_retailprice), 6) AS root, p_size * p_size AS square, round(p_retailprice / p_size, 6) AS ratio FROM part",
)
def _(t):
    price, size = F.col("p_retailprice"), F.col("p_size")
    return t.part.select(
        "p_partkey", F.abs(price - 1200).alias("gap"), F.round(F.sqrt(price), 6).alias("root"), (size * size).alias("square"),
        F.round(numeric.safe_div(price, size), 6).alias("ratio"),
    )


@query(
    "scl_15_list_functions", "SCL-15",
    """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, CAST(embedding[64] AS DOUBLE) AS first_reversed, CAST(embedding[2] AS DOUBLE) AS second,
         CAST(len(list_concat(embedding[1:3], embedding[1:5])) AS INTEGER) AS joined, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings""",
)
def _(t):
    e = F.col("embedding")
    return t.embeddings.select(
        "vec_id", F.size(e).alias("n"), F.get(F.reverse(e), F.lit(0)).cast("double").alias("first_reversed"),
        F.get(arrays.head(e, 3), F.lit(1)).cast("double").alias("second"),
        F.size(F.concat(arrays.head(e, 3), arrays.head(e, 5))).alias("joined"),
        F.round(arrays.list_sum(F.transform(e, lambda x: x.cast("double"))), 6).alias("total"),
    )


_PROBS = "pr AS (SELECT entity, start_date, CAST(truth AS DOUBLE) AS ground_truth, CAST(pred AS DOUBLE) AS predictions FROM class_pairs)"


@query(
    "scl_16_probability_columns", "SCL-16 SCL-17 RES-8",
    "WITH " + _PROBS + """ SELECT entity, start_date, CASE WHEN predictions = 2 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS high_p, CASE WHEN predictions = 1 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS medium_p,
        CASE WHEN predictions = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS low_p FROM pr""",
    uses="class_pairs",
)
def _(t):
    out = results.probability_columns(class_results(t), ternary=True)
    return out.select("entity", F.col("date").alias("start_date"), "high_p", "medium_p", "low_p")


@query(
    "scl_17_struct_fields", "SCL-17",
    """SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(NULL AS DOUBLE) AS far FROM embeddings""",
)
def _(t):
    wide = F.transform("embedding", lambda x: x.cast("double"))
    named = arrays.named_fields(F.slice(wide, 1, 2), ["a", "b", "far"])
    return t.embeddings.select("vec_id", named.alias("s")).select("vec_id", "s.*")


@query(
    "scl_18_correct_label", "SCL-18",
    "WITH " + _PROBS + """ SELECT entity, start_date, CASE WHEN predictions = ground_truth THEN 'Correct Prediction' ELSE 'Incorrect Prediction' END AS correct,
        CASE WHEN ground_truth = 2 THEN '1.0,0.0,0.0' WHEN ground_truth = 1 THEN '0.0,1.0,0.0' ELSE '0.0,0.0,1.0' END AS truth_color FROM pr""",
    uses="class_pairs",
)
def _(t):
    out = results.truth_columns(class_results(t), ternary=True)
    return out.select("entity", F.col("date").alias("start_date"), "correct", F.array_join(F.col("truth_color").cast("array<string>"), ",").alias("truth_color"))
