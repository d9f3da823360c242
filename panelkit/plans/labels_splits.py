"""Targets, splits and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import splits, targets
from ..operators.lags import lag_frame
from .registry import query
from .standins import TEST_END, TRAIN_END, TRAIN_START


def class_results(t):
    """Class pairs as a result frame; the predicted class has probability 0.5, the others 0.25."""
    p = F.col("pred").cast("double")
    probs = F.array(*[F.when(p == k, 0.5).otherwise(0.25) for k in range(3)])
    return t.class_pairs.select(
        "entity", F.col("start_date").alias("date"), p.alias("predictions"), F.col("truth").cast("double").alias("ground_truth"),
        probs.alias("probabilities"),
    )


def _rates(t):
    return t.panel.select("entity", "start_date", "month", F.col("cases_per_100k").alias("target"))


@query(
    "tgt_1_simple_binary", "TGT-1",
    "SELECT entity, start_date, month, cases_per_100k AS target, CASE WHEN cases_per_100k <= 300 THEN '0' WHEN cases_per_100k > 300 THEN '1' END AS cat_target FROM panel",
    uses="panel",
)
def _(t):
    return targets.simple_binary(_rates(t))[0]


@query(
    "tgt_2_simple_ternary", "TGT-2",
    "SELECT entity, start_date, month, cases_per_100k AS target, CASE WHEN cases_per_100k <= 100 THEN '0' WHEN cases_per_100k <= 300 THEN '1' WHEN cases_per_100k > 300 THEN '2' END AS cat_target FROM panel",
    uses="panel",
)
def _(t):
    return targets.simple_ternary(_rates(t))[0]


@query(
    "tgt_3_relative_binary", "TGT-3",
    "SELECT p.entity, p.start_date, p.month, p.count, CASE WHEN p.count > x.expected THEN '1' ELSE '0' END AS cat_target FROM panel p JOIN expected x USING (entity, month)",
    uses="panel expected",
)
def _(t):
    return targets.relative_binary(t.panel.select("entity", "start_date", "month", "count"), target="count")[0]


@query("tgt_4_relative_ternary", "TGT-4", "SELECT entity, start_date, count, cat_target FROM relative", uses="relative")
def _(t):
    return t.relative.select("entity", "start_date", "count", "cat_target")


@query(
    "tgt_5_month_only", "TGT-5",
    """WITH x AS (SELECT month, CAST(sum(count) AS DOUBLE) / count(count) AS e FROM panel GROUP BY 1)
       SELECT entity, start_date, count, CASE WHEN count > e THEN '1' ELSE '0' END AS binary_target,
         CASE WHEN count <= e * 0.5 THEN '0' WHEN count <= e THEN '1' ELSE '2' END AS ternary_target FROM panel JOIN x USING (month)""",
    uses="panel",
)
def _(t):
    cols = t.panel.select("entity", "start_date", "month", "count")
    binary, expected = targets.relative_binary(cols, None, ("month",), "count")
    named = binary.withColumnRenamed("cat_target", "binary_target")
    both = targets.relative_ternary(named, expected, ("month",), "count")[0]
    return both.withColumnRenamed("cat_target", "ternary_target").drop("month")


_HOLDOUT = f"start_date >= DATE '{TRAIN_START}' AND start_date < DATE '{TRAIN_END}'"


@query(
    "tgt_6_train_expectations_on_test", "TGT-6 TGT-7 UDF-1",
    f"""WITH x AS (SELECT entity, month, CAST(sum(count) AS DOUBLE) / count(count) AS e FROM panel WHERE {_HOLDOUT} GROUP BY 1, 2)
       SELECT CASE WHEN {_HOLDOUT} THEN 'train' ELSE 'test' END AS split, entity, start_date, count, CASE WHEN count <= e * 0.5 THEN '0' WHEN count <= e THEN '1' ELSE '2' END AS cat_target
       FROM panel JOIN x USING (entity, month) WHERE start_date >= DATE '{TRAIN_START}' AND start_date < DATE '{TEST_END}'""",
    uses="panel",
)
def _(t):
    cols = t.panel.select("entity", "start_date", "month", "count")
    train, test = splits.temporal_holdout(cols, TRAIN_START, TRAIN_END, TEST_END)
    a, b = targets.label_splits(train, test, "relative_ternary", target="count")
    return a.withColumn("split", F.lit("train")).unionByName(b.withColumn("split", F.lit("test"))).drop("month")


@query(
    "tgt_7_every_target", "TGT-7",
    """SELECT 'relative_binary' AS style, CASE WHEN p.count > e.expected THEN '1' ELSE '0' END AS cat_target, count(*) AS n FROM panel p JOIN expected e USING (entity, month) GROUP BY 2
       UNION ALL SELECT 'relative_ternary', cat_target, count(*) FROM relative GROUP BY 2
       UNION ALL SELECT 'simple_binary', CASE WHEN count <= 300 THEN '0' ELSE '1' END, count(*) FROM panel GROUP BY 2
       UNION ALL SELECT 'simple_ternary', CASE WHEN count <= 100 THEN '0' WHEN count <= 300 THEN '1' ELSE '2' END, count(*) FROM panel GROUP BY 2""",
    uses="panel expected relative",
)
def _(t):
    cols = t.panel.select("entity", "start_date", "month", "count")
    parts = [
        make(cols, None, ("entity", "month"), "count")[0].groupBy("cat_target").agg(F.count("*").alias("n")).withColumn("style", F.lit(name))
        for name, make in targets.target_registry().items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _lagged_sql(lo: str, hi: str, name: str) -> str:
    return (
        f"SELECT '{name}' AS split, entity, start_date, count AS target, month, l1 AS \"1_shifted_cases\", l2 AS \"2_shifted_cases\", l3 AS \"3_shifted_cases\" "
        f"FROM f WHERE l3 IS NOT NULL AND start_date >= DATE '{lo}' AND start_date < DATE '{hi}'"
    )


@query(
    "spl_1_temporal_holdout", "SPL-1 WIN-4",
    "WITH f AS (SELECT *, lag(count, 1) OVER w AS l1, lag(count, 2) OVER w AS l2, lag(count, 3) OVER w AS l3 FROM panel WINDOW w AS (PARTITION BY entity ORDER BY start_date)) "
    + _lagged_sql(TRAIN_START, TRAIN_END, "train") + " UNION ALL " + _lagged_sql(TRAIN_END, TEST_END, "test"),
    uses="panel",
)
def _(t):
    # one lag frame over both ranges, then cut: the window runs once
    frame = lag_frame(t.panel, TRAIN_START, TEST_END, "count", case_lookback=3, dense=True)
    train, test = splits.temporal_holdout(frame, TRAIN_START, TRAIN_END, TEST_END)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query(
    "spl_2_expanding_folds", "SPL-2",
    """WITH r AS (SELECT entity, start_date, count, row_number() OVER (ORDER BY start_date, entity) - 1 AS i, count(*) OVER () AS n FROM dense),
       f AS (SELECT *, CAST(k AS INTEGER) AS fold, n - (5 - k) * (n // 5) AS b FROM r, range(1, 5) g(k))
       SELECT entity, start_date, count, fold, CASE WHEN i < b THEN 'train' ELSE 'test' END AS role FROM f WHERE i < b + n // 5""",
    uses="dense",
)
def _(t):
    return splits.expanding_folds(t.dense)


_DRAW = "(('0x' || substr(md5({} || '|42'), 1, 13)) :: BIGINT / 4503599627370496.0)"


@query(
    "spl_3_entity_split", "SPL-3",
    "WITH r AS (SELECT entity, row_number() OVER (ORDER BY " + _DRAW.format("CAST(entity AS VARCHAR)")
    + """, entity) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT entity FROM dense))
      SELECT d.*, CASE WHEN i <= floor(n * 0.6) THEN 'train' WHEN i <= floor(n * 0.6) + floor(n * 0.2) THEN 'valid' ELSE 'test' END AS split FROM dense d JOIN r USING (entity)""",
    uses="dense",
)
def _(t):
    return splits.entity_split(t.dense)


@query(
    "spl_3_entity_split_sizes", "SPL-3",
    """WITH n AS (SELECT count(DISTINCT entity) AS n FROM dense) SELECT 'train' AS split, CAST(floor(n * 0.6) AS BIGINT) AS entities FROM n
       UNION ALL SELECT 'valid', CAST(floor(n * 0.2) AS BIGINT) FROM n UNION ALL SELECT 'test', CAST(n - floor(n * 0.6) - floor(n * 0.2) AS BIGINT) FROM n""",
    uses="dense",
)
def _(t):
    return splits.entity_split(t.dense).select("split", "entity").distinct().groupBy("split").agg(F.count("*").alias("entities"))


@query(
    "spl_4_fraction_sample", "SPL-4",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE " + _DRAW.format("concat_ws('|', l_orderkey, l_linenumber, l_partkey)") + " <= 0.1",
)
def _(t):
    return splits.hashed_sample(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), 0.1, ["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "spl_4_random_rows", "SPL-4",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem ORDER BY " + _DRAW.format("concat_ws('|', l_orderkey, l_linenumber, l_partkey)")
    + ", l_orderkey, l_linenumber, l_partkey LIMIT 500",
)
def _(t):
    return splits.sample_rows(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), 500, ["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "spl_5_zero_bypass", "SPL-5 SET-1",
    """WITH z AS (SELECT entity FROM daily GROUP BY 1 HAVING sum(CASE WHEN kind = 'error' AND event_date < DATE '2024-01-05' THEN 1 ELSE 0 END) = 0)
       SELECT -999.0 :: DOUBLE AS predictions, -999.0 :: DOUBLE AS ground_truth, DATE '1900-01-01' AS date, entity, 'NA' AS cat_style, 'Only zeros in training data' AS error, 0 AS n FROM z
       UNION ALL SELECT CAST(count(*) AS DOUBLE), CAST(count(*) AS DOUBLE), max(event_date), entity, 'daily', 'NONE', count(*) FROM daily WHERE entity NOT IN (SELECT entity FROM z) GROUP BY entity""",
    uses="daily",
)
def _(t):
    hit = (F.col("kind") == "error") & (F.col("event_date") < F.lit("2024-01-05").cast("date"))
    zero = splits.zero_entities(t.daily.withColumn("target", F.when(hit, 1).otherwise(0)))
    fitted = t.daily.groupBy("entity").agg(  # one row an entity before the join
        F.count("*").cast("double").alias("predictions"), F.count("*").cast("double").alias("ground_truth"),
        F.max("event_date").alias("date"), F.count("*").alias("n"),
    ).join(zero, "entity", "left_anti").withColumns({"cat_style": F.lit("daily"), "error": F.lit("NONE")})
    bypass = splits.bypass_rows(zero).drop("probabilities").withColumn("n", F.lit(0).cast("long"))
    return bypass.unionByName(fitted)


@query(
    "spl_6_evaluation_cut", "SPL-6",
    """SELECT entity, start_date, count, CASE WHEN row_number() OVER (PARTITION BY entity ORDER BY start_date DESC) <= 3 THEN 'truth' ELSE 'history' END AS part FROM dense""",
    uses="dense",
)
def _(t):
    return splits.evaluation_cut(t.dense, 3)
