"""Projections, filters and schema repair."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions.text import LAND_COVER_BANDS
from ..functions import arrays, numeric
from ..operators import schema, series
from ..operators.lags import lag_frame
from ..operators.zonal import in_box
from .registry import query

KEYS = ["entity", "start_date"]


@query("prj_1_select_list", "PRJ-1", "SELECT entity, start_date, volume, top_price, low_tax FROM parameters", uses="parameters")
def _(t):
    env, extra = ["volume", "top_price"], ["low_tax"]
    return t.parameters.select(*(KEYS + env + extra))


@query("prj_2_select_except", "PRJ-2", "SELECT entity, start_date, end_date, low_tax FROM parameters", uses="parameters")
def _(t):
    return t.parameters.drop("volume", "top_price")


@query(
    "prj_3_with_columns", "PRJ-3",
    "SELECT entity, start_date, count + 1 AS count, CAST(month(start_date) AS INTEGER) AS month FROM counts", uses="counts",
)
def _(t):
    return t.counts.withColumns({"count": F.col("count") + 1, "month": F.month("start_date")})


@query("prj_4_rename_present", "PRJ-4", "SELECT s_suppkey AS muni_id, s_name AS muni_name, s_nationkey, s_acctbal FROM supplier")
def _(t):
    return schema.rename_present(t.supplier, {"s_suppkey": "muni_id", "s_name": "muni_name", "NM_MUN": "absent"})


@query(
    "prj_5_conform_keys", "PRJ-5 JON-1",
    "SELECT p.entity, p.start_date, p.volume, d.count FROM parameters p JOIN dense d USING (entity, start_date)",
    uses="parameters dense",
)
def _(t):
    as_text = t.parameters.select(
        F.col("entity").cast("string").alias("entity"), F.col("start_date").cast("string").alias("start_date"), "volume"
    )
    return schema.conform_keys(as_text, t.dense, KEYS).join(t.dense, KEYS)


@query(
    "prj_6_blank_columns", "PRJ-6",
    """SELECT entity, CAST(NULL AS DOUBLE) AS volume, top_price, low_tax, start_date, end_date,
         CAST(NULL AS BIGINT) AS extra FROM parameters""",
    uses="parameters",
)
def _(t):
    return schema.blank_columns(schema.blank_columns(t.parameters, ["volume"], "double"), ["extra"], "long")


@query("prj_7_columns_by_type", "PRJ-7", "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def _(t):
    return t.lineitem.select(*schema.columns_of_type(t.lineitem, T.DoubleType))


@query(
    "prj_8_downcast", "PRJ-8",
    """SELECT l_suppkey, CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS l_extendedprice,
         CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS l_discount FROM lineitem""",
)
def _(t):
    small = schema.downcast_doubles(t.lineitem.select("l_suppkey", "l_extendedprice", "l_discount"))
    return small.withColumns({c: F.col(c).cast("double") for c in ("l_extendedprice", "l_discount")})


@query("prj_9_rate", "PRJ-9", "SELECT entity, start_date, cases_per_100k FROM panel", uses="panel")
def _(t):
    return t.panel.select("entity", "start_date", numeric.rate_per(F.col("count"), F.col("pop")).alias("cases_per_100k"))


@query("prj_10_log_offset", "PRJ-10", "SELECT entity, start_date, round(ln(count + 0.1), 6) AS log_cases FROM panel", uses="panel")
def _(t):
    return t.panel.select("entity", "start_date", F.round(numeric.log_offset(F.col("count")), 6).alias("log_cases"))


@query("prj_11_unit_scale", "PRJ-11", "SELECT pixel, region, round((value - 0) / 21171.0, 6) AS scaled FROM pixels", uses="pixels")
def _(t):
    return t.pixels.select("pixel", "region", F.round(numeric.unit_scale(F.col("value"), 0, 21171), 6).alias("scaled"))


_STEPS_SQL = """WITH last AS (SELECT entity, max(start_date) AS m FROM dense GROUP BY 1),
    steps AS (SELECT entity, start_date, count, false AS is_future FROM dense UNION ALL
      SELECT entity, CAST(m + to_months(CAST(h AS INTEGER)) AS DATE), NULL, true FROM last, range(1, 4) r(h)),
    f AS (SELECT *, (month(start_date) - 1) / 11.0 - 0.5 AS month_scaled,
      log10(2.0 + row_number() OVER (PARTITION BY entity ORDER BY start_date) - 1) AS age FROM steps)"""


@query(
    "prj_12_age_feature", "PRJ-12",
    _STEPS_SQL + " SELECT entity, start_date, round(age, 6) AS age FROM f WHERE NOT is_future", uses="dense",
)
def _(t):
    steps = series.step_features(t.dense, 3)
    return steps.filter(~F.col("is_future")).select("entity", "start_date", F.round("age", 6).alias("age"))


@query(
    "prj_13_calendar_feature", "PRJ-13 CAL-2",
    _STEPS_SQL + " SELECT entity, start_date, is_future, round(month_scaled, 6) AS month_scaled FROM f", uses="dense",
)
def _(t):
    return series.step_features(t.dense, 3).select(
        "entity", "start_date", "is_future", F.round("month_scaled", 6).alias("month_scaled")
    )


@query(
    "prj_14_observed_flag", "PRJ-14",
    """SELECT entity, year, CASE WHEN pop IS NULL THEN 0 ELSE 1 END AS observed, coalesce(pop, 0) AS pop FROM raw_exposure""",
    uses="raw_exposure",
)
def _(t):
    return series.observed_flag(t.raw_exposure, "pop")


@query(
    "prj_15_stack_features", "PRJ-15",
    _STEPS_SQL + """ SELECT entity, start_date, round(month_scaled, 6) AS f0, round(age, 6) AS f1,
        CAST(coalesce(count, 0) AS DOUBLE) AS f2 FROM f""",
    uses="dense",
)
def _(t):
    steps = series.step_features(t.dense, 3, dynamic=["count"])
    return steps.select(
        "entity", "start_date", F.round(F.get("step_vector", F.lit(0)), 6).alias("f0"),
        F.round(F.get("step_vector", F.lit(1)), 6).alias("f1"), F.get("step_vector", F.lit(2)).alias("f2"),
    )


@query(
    "prj_16_one_hot_months", "PRJ-16",
    "SELECT entity, start_date, count, " + ", ".join(
        f"CAST(month(start_date) = {m} AS INTEGER) AS month_{m}" for m in range(1, 13)
    ) + " FROM counts",
    uses="counts",
)
def _(t):
    return schema.one_hot_months(t.counts, "start_date")


@query(
    "prj_17_mean_abs_scale", "PRJ-17",
    """SELECT entity, start_date, CAST(count AS DOUBLE) / greatest(avg(abs(count)) OVER (PARTITION BY entity), 1e-5) AS scaled
       FROM dense""",
    uses="dense",
)
def _(t):
    lists = series.collect_series(t.dense.withColumn("x", F.col("count").cast("double")), ["start_date", "x"])
    return lists.select("entity", F.explode(F.arrays_zip("start_date", arrays.scale_context(F.col("x")).alias("s"))).alias("z")).select(
        "entity", F.col("z.start_date").alias("start_date"), F.col("z.s").alias("scaled")
    )


def _land_cover(t):
    """Histogram text per region, one entry per return flag that occurs, numbered 0 to 2."""
    band = F.when(F.col("flag") == "A", 0).when(F.col("flag") == "N", 1).otherwise(2)
    cells = t.line_list.groupBy("entity", band.alias("band")).agg(F.sum("quantity").alias("v"))
    entry = F.concat(F.lit("["), F.col("band").cast("string"), F.lit(", "), F.col("v").cast("long").cast("string"), F.lit(".0]"))
    return cells.groupBy("entity").agg(
        F.concat(
            F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("band", entry.alias("e")))), lambda x: x["e"]), ", "),
            F.lit("]"),
        ).alias("histogram")
    )


_COVER_SQL = """SELECT entity, round(sum(CASE WHEN flag = 'A' THEN quantity ELSE 0 END) / sum(quantity), 6) AS water,
    round(sum(CASE WHEN flag = 'N' THEN quantity ELSE 0 END) / sum(quantity), 6) AS trees,
    round(sum(CASE WHEN flag NOT IN ('A', 'N') THEN quantity ELSE 0 END) / sum(quantity), 6) AS grass,
    """ + ", ".join(f"0.0 :: DOUBLE AS {band}" for band in LAND_COVER_BANDS[3:]) + " FROM line_list GROUP BY 1"


@query("prj_18_land_cover_map", "PRJ-18", _COVER_SQL, uses="line_list")
def _(t):
    fractions = arrays.cover_fractions(F.col("histogram"))
    return _land_cover(t).select("entity", *fractions).withColumns({c: F.round(c, 6) for c in ("water", "trees", "grass")})


@query(
    "prj_18_land_cover_positional", "PRJ-18 SCL-4 SCL-17",
    _COVER_SQL.replace("0.0 :: DOUBLE", "CAST(NULL AS DOUBLE)"), uses="line_list",
)
def _(t):
    fractions = arrays.cover_fractions(F.col("histogram"), positional=True)
    return _land_cover(t).select("entity", *fractions).withColumns({c: F.round(c, 6) for c in ("water", "trees", "grass")})


@query(
    "prj_19_safe_columns", "PRJ-19",
    "SELECT l_suppkey AS item_id, max(l_quantity) AS QuantileLoss_0_5_ FROM lineitem GROUP BY 1",
)
def _(t):
    raw = t.lineitem.groupBy(F.col("l_suppkey").alias("item_id")).agg(F.max("l_quantity").alias("QuantileLoss[0.5]"))
    return schema.safe_columns(raw)


@query(
    "prj_20_feature_bundle", "PRJ-20",
    """SELECT entity, start_date, CAST(count AS DOUBLE) AS label, month,
         lag(count, 1) OVER w AS "1_shifted_cases", lag(count, 2) OVER w AS "2_shifted_cases" FROM panel
       WINDOW w AS (PARTITION BY entity ORDER BY start_date) QUALIFY lag(count, 2) OVER w IS NOT NULL
         AND start_date >= DATE '1996-01-01' AND start_date < DATE '2001-01-01'""",
    uses="panel",
)
def _(t):
    frame = lag_frame(t.panel, "1996-01-01", "2001-01-01", "count", case_lookback=2, dense=True)
    return schema.feature_bundle(frame, "target")[0]


@query("flt_1_comparisons", "FLT-1", "SELECT * FROM counts WHERE entity <> 7 AND count >= 5", uses="counts")
def _(t):
    return t.counts.filter((F.col("entity") != 7) & (F.col("count") >= 5))


@query(
    "flt_2_half_open_range", "FLT-2",
    "SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'",
)
def _(t):
    low, high = F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-01-01").cast("timestamp_ntz")
    return t.lineitem.filter((F.col("l_shipdate") >= low) & (F.col("l_shipdate") < high)).select(
        "l_orderkey", "l_suppkey", "l_linenumber"
    )


@query(
    "flt_3_nested_prefixes", "FLT-3",
    """SELECT s.name AS split, count(*) AS n FROM dense JOIN (VALUES ('train', DATE '1998-01-01'), ('valid', DATE '1999-01-01'),
         ('test', DATE '2000-01-01')) s(name, lim) ON start_date <= lim GROUP BY 1""",
    uses="dense",
)
def _(t):
    limits = {"train": "1998-01-01", "valid": "1999-01-01", "test": "2000-01-01"}
    parts = series.nested_prefixes(t.dense, "start_date", limits)
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).withColumn("split", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("flt_4_membership", "FLT-4", "SELECT * FROM counts WHERE month(start_date) IN (11, 12, 1, 2, 3, 4, 5)", uses="counts")
def _(t):
    return t.counts.filter(F.month("start_date").isin(11, 12, 1, 2, 3, 4, 5))


@query("flt_5_drop_any_null", "FLT-5", "SELECT * FROM raw_exposure WHERE pop IS NOT NULL", uses="raw_exposure")
def _(t):
    return schema.drop_any_null(t.raw_exposure)


@query("flt_6_fill_null", "FLT-6", "SELECT entity, year, coalesce(pop, -999) AS pop FROM raw_exposure", uses="raw_exposure")
def _(t):
    return schema.fill_null(t.raw_exposure, -999, ["pop"])


@query(
    "flt_7_complete_lists", "FLT-7 AGG-6",
    """SELECT entity, count(*) AS n, CAST(sum(count) AS BIGINT) AS total FROM counts GROUP BY 1
       HAVING count(*) = (SELECT count(DISTINCT start_date) FROM counts)""",
    uses="counts",
)
def _(t):
    lists = series.collect_series(t.counts, ["count"])
    n = t.counts.agg(F.countDistinct("start_date")).scalar()
    total = F.aggregate("count", F.lit(0).cast("long"), lambda a, x: a + x)
    return lists.filter(F.size("count") == n).select("entity", F.size("count").cast("long").alias("n"), total.alias("total"))


@query(
    "flt_8_bounding_box", "FLT-8",
    "SELECT pixel, region, value, weight FROM pixels WHERE value BETWEEN 1000 AND 30000 AND weight BETWEEN 5 AND 40", uses="pixels",
)
def _(t):
    return in_box(t.pixels, "value", "weight", (1000, 5, 30000, 40)).select("pixel", "region", "value", "weight")
