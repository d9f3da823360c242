"""Model jobs, grids and sweeps."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Window as W, functions as F

from ..functions.numeric import log_offset
from ..operators import boosting, linear, metrics, models, splits, sweeps, targets, zonal
from ..operators.forecast import seasonal_naive
from ..operators.joins import salted_join
from ..operators.lags import add_lags, lag_frame, lag_name
from ..operators.metrics import quantile_column
from ..operators.results import result_frame
from ..operators.schema import drop_any_null
from ..operators.series import collect_series
from ..session import cut_lineage
from .aggregates import FORECAST_SQL
from .registry import query
from .standins import TEST_END, TRAIN_END, TRAIN_START

CASE_LAGS = [lag_name(i, "cases") for i in range(1, 7)]


def _frame(t, lookback: int = 6):
    return lag_frame(t.panel, TRAIN_START, TEST_END, "count", case_lookback=lookback, dense=True)


LAGS_24 = [lag_name(i, "cases") for i in range(1, 25)]
#: Lags of a sweep: windows of 24 months that begin at each of them.
SWEPT = (1, 2, 3, 4)


def window_of(column: str, lag: int, size: int = 24) -> list[str]:
    """Names of ``size`` lags of a column from ``lag`` on: a larger lag moves the window, it does not shorten it."""
    return [lag_name(i, column) for i in range(lag, lag + size)]


def _labelled(t, style: str, lookback: int = 24):
    """Training and test frames with ``label`` as double, expectations from training only."""
    train, test = splits.temporal_holdout(cut_lineage(_frame(t, lookback)), TRAIN_START, TRAIN_END, TEST_END)
    a, b = targets.label_splits(train, test, style)
    label = lambda df: df.withColumn("label", F.col("cat_target").cast("double"))
    return label(a), label(b)


@query(
    "ml_1_robust_scaling", "ML-1",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS p, quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01')
       SELECT l_orderkey, l_linenumber, l_suppkey, round((l_extendedprice - p[2]) / (p[3] - p[1]), 5) AS l_extendedprice, round((l_quantity - v[2]) / (v[3] - v[1]), 5) AS l_quantity FROM lineitem, q""",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    train = rows.filter(F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    scaled = models.robust_scale(train, [rows], ["l_extendedprice", "l_quantity"])[1]
    return scaled.drop("l_shipdate").withColumns({c: F.round(c, 5) for c in ("l_extendedprice", "l_quantity")})


@query("ml_2_global_binary_classifier", "ML-2 RES-1")
def _(t):
    train, test = _labelled(t, "relative_binary")
    scored = models.tree_classifier(train, test, [*LAGS_24, "month"], 2, iterations=20)
    settings = {"env_vars": ["none"], "additional_vars": ["month"], "case_lag": 1, "env_lag": 0, "specific_cases": list(range(1, 25))}
    return result_frame(scored, "relative_binary", settings)


@query("ml_2_global_ternary_classifier", "ML-2 RES-1")
def _(t):
    train, test = _labelled(t, "relative_ternary")
    scored = models.tree_classifier(train, test, [*LAGS_24, "month"], 3, iterations=20)
    return result_frame(scored, "relative_ternary", {"case_lag": 1})


_SPLIT_AT = ["month", lag_name(1, "cases"), lag_name(12, "cases")]


@query(
    "ml_2_first_split", "ML-2",
    f"""WITH g AS (SELECT *, least(lag(count, 1) OVER w, 50) AS a, least(lag(count, 12) OVER w, 50) AS b FROM panel WINDOW w AS (PARTITION BY entity ORDER BY start_date)),
      fr AS (SELECT * FROM g WHERE b IS NOT NULL AND start_date >= DATE '{TRAIN_START}' AND start_date < DATE '{TRAIN_END}'),
      ex AS (SELECT entity, month, CAST(sum(count) AS DOUBLE) / count(*) AS e FROM fr GROUP BY 1, 2),
      lab AS (SELECT month, a, b, CASE WHEN count > e THEN 1.0 ELSE 0.0 END AS y FROM fr JOIN ex USING (entity, month)), s AS (SELECT avg(y) AS p FROM lab),
      long AS (SELECT 0 AS f, month AS x, y FROM lab UNION ALL SELECT 1, a, y FROM lab UNION ALL SELECT 2, b, y FROM lab),
      c AS (SELECT f, x, sum(p - y) AS g, sum(p * (1 - p)) AS h, count(*) AS n FROM long, s GROUP BY 1, 2),
      r AS (SELECT f, x, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(n) OVER u AS nl, sum(g) OVER v AS g, sum(h) OVER v AS h, sum(n) OVER v AS n FROM c
            WINDOW u AS (PARTITION BY f ORDER BY x), v AS (PARTITION BY f)),
      k AS (SELECT f, x, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain FROM r WHERE nl >= 20 AND n - nl >= 20)
      SELECT ['month', '{_SPLIT_AT[1]}', '{_SPLIT_AT[2]}'][f + 1] AS feature, CAST(x AS DOUBLE) AS threshold, round(gain, 5) AS gain FROM k ORDER BY gain DESC, f, x LIMIT 1""",
    uses="panel",
)
def _(t):
    # lags over 50 count as 50, so that every value has a bin of its own
    train, _ = splits.temporal_holdout(_frame(t, 12), TRAIN_START, TRAIN_END, TEST_END)
    labelled, _ = targets.relative_binary(train)
    rows = labelled.select(F.col("cat_target").cast("int").alias("label"), *[F.least(F.col(c), F.lit(50)).alias(c) for c in _SPLIT_AT])
    bins = boosting.fit_bins(rows, _SPLIT_AT)
    model = boosting.Boosted("model", boosting.Setting(leaves=2, l2=1.0), 2)
    job = boosting.Boosting(boosting.binned(rows, bins, "label"), bins, [model])
    best = job.splits_of([model], {"model": [boosting.Tree()]}, {("model", 0): [0]})
    value = F.array(*[F.array(*[F.lit(float(v)) for v in e]) for e in bins.edges])[F.col("feature")][F.col("bin") - 1]
    return best.select(F.array(*[F.lit(c) for c in _SPLIT_AT])[F.col("feature")].alias("feature"), value.alias("threshold"), F.round("gain", 5).alias("gain"))


@query("ml_3_ridge_classifier", "ML-3")
def _(t):
    train, test = _labelled(t, "relative_ternary")
    scored = models.ridge_classifier(train, test, [*LAGS_24, "month"], 3)
    return result_frame(scored, "relative_ternary", {"case_lag": 1}, probabilities=None)


@query(
    "ml_4_local_lag_regression", "ML-4",
    """WITH l AS (SELECT entity, CAST(count AS DOUBLE) AS y, CAST(lag(count) OVER (PARTITION BY entity ORDER BY start_date) AS DOUBLE) AS x FROM dense)
       SELECT entity, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM l WHERE x IS NOT NULL GROUP BY 1""",
    uses="dense",
)
def _(t):
    lagged = add_lags(t.dense, {"count": [1]})
    fit = linear.lag_regression(lagged, "count", lag_name(1, "count"))
    return fit.select("entity", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


_LAG_FRAME = f"""f AS (SELECT entity, start_date, month, count AS target, {", ".join(f"lag(count, {i}) OVER w AS l{i}" for i in range(1, 7))} FROM panel
      WINDOW w AS (PARTITION BY entity ORDER BY start_date)),
    fr AS (SELECT * FROM f WHERE l6 IS NOT NULL AND start_date >= DATE '{TRAIN_START}' AND start_date < DATE '{TEST_END}'),
    ex AS (SELECT entity, month, CAST(sum(target) AS DOUBLE) / count(*) AS e FROM fr WHERE start_date < DATE '{TRAIN_END}' GROUP BY 1, 2),
    lab AS (SELECT fr.*, CASE WHEN target > e THEN 1 ELSE 0 END AS label, start_date < DATE '{TRAIN_END}' AS is_train FROM fr JOIN ex USING (entity, month)),
    long AS (UNPIVOT lab ON l1, l2, l3, l4, l5, l6 INTO NAME lag VALUE x),
    fit AS (SELECT lag, (sum(x * (2 * label - 1)) - sum(x) * sum(2 * label - 1) / count(*)) / (sum(x * x) - sum(x) * sum(x) / count(*) + 1.0) AS coef,
        avg(x) AS mx, avg(2 * label - 1) AS my FROM long WHERE is_train GROUP BY 1),
    scored AS (SELECT l.entity, l.start_date, l.lag, l.label, CASE WHEN my + coef * (x - mx) > 0 THEN 1 ELSE 0 END AS predicted FROM long l JOIN fit USING (lag) WHERE NOT is_train)"""


@query(
    "ml_3_ridge_one_lag", "ML-3 TGT-6",
    "WITH " + _LAG_FRAME + " SELECT entity, start_date, CAST(label AS DOUBLE) AS ground_truth, CAST(predicted AS DOUBLE) AS predictions FROM scored WHERE lag = 'l1'",
    uses="panel",
)
def _(t):
    train, test = _labelled(t, "relative_binary", 6)
    scored = models.ridge_classifier(train, test, CASE_LAGS[:1], 2)
    return scored.select("entity", "start_date", F.col("label").alias("ground_truth"), F.col("prediction").alias("predictions"))


@query("ml_4_local_classifiers", "ML-4 SPL-5")
def _(t):
    train, test = _labelled(t, "relative_binary")
    zero = splits.zero_entities(train)
    rows = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    fitted = linear.local_ridge_classes(rows.join(zero, "entity", "left_anti"), [*LAGS_24, "month"], "relative_binary_local")
    return fitted.unionByName(splits.bypass_rows(zero).drop("probabilities"))


@query("ml_5_poisson_regression", "ML-5")
def _(t):
    logged = _frame(t, 24).withColumns({c: log_offset(F.col(c)) for c in LAGS_24})
    train, test = splits.temporal_holdout(logged, TRAIN_START, TRAIN_END, TEST_END)
    out = models.poisson_regression(train, test, LAGS_24, "target")
    return out.select("entity", "start_date", "target", "prediction")


def _season_series(t):
    season = t.dense.filter(F.month("start_date").isin(11, 12, 1, 2, 3, 4, 5))
    return collect_series(season, ["count"])


@query("ml_6_flat_clusters", "ML-6 FLT-4")
def _(t):
    return models.flat_clusters(_season_series(t), "count", 10)


@query("ml_6_cluster_tree", "ML-6 D16")
def _(t):
    return models.cluster_tree(_season_series(t), "count")


def _node_rows(panel, members, level: int):
    """Rate per node and month with 24 lags, marked train or test."""
    here = members.filter(F.col("level") == level).select("entity", "node", "parent")
    sums = panel.join(here, "entity").groupBy("node", "parent", "start_date").agg(
        F.sum("count").alias("count"), F.sum("pop").alias("pop")
    )
    rate = sums.withColumn("rate", F.try_divide(F.col("count").cast("double"), F.col("pop")) * 100000)
    lagged = drop_any_null(add_lags(rate, {"rate": range(1, 25)}, "node"), ["rate", *[lag_name(i, "rate") for i in range(1, 25)]])
    split = F.when(F.col("start_date") < F.lit(TRAIN_END).cast("date"), "train").otherwise("test")
    return lagged.withColumns({"split": split, "label": F.col("rate")})


@query("ml_7_hierarchical_refinement", "ML-7 AGG-10 AGG-18 AGG-25 SRT-7")
def _(t):
    members = cut_lineage(models.cluster_tree(_season_series(t), "count"), "tree")
    panel = cut_lineage(t.panel.select("entity", "start_date", "count", "pop"), "panel")  # read by every level
    lags = [lag_name(i, "rate") for i in range(1, 25)]
    above, scores = None, []
    for level in range(4):  # one job graph per level, all nodes of the level together
        rows = cut_lineage(_node_rows(panel, members, level), "nodes")
        plain = linear.local_ridge(rows, lags, entity="node")
        best = plain
        if above is not None:
            parent = above.select(F.col("node").alias("parent"), "start_date", F.col("prediction").alias("parent_prediction"))
            both = rows.join(parent, ["parent", "start_date"])
            best = linear.local_ridge(both, [*lags, "parent_prediction"], entity="node")
        above = cut_lineage(best)
        marks = lambda df: metrics.regression_scores(df.filter(F.col("split") == "test"), ["node"], "label", "prediction")
        scores.append(metrics.compare_runs(marks(above), marks(plain), ["node"]).withColumn("level", F.lit(level)))
    return reduce(lambda a, b: a.unionByName(b), scores)


def _cluster_forecast(t, lags: int = 24):
    """One ridge per cluster (nation) on the history, rolled 3 months past its end on its own forecasts, with quantiles."""
    lagged = add_lags(t.dense, {"count": range(1, lags + 1)})
    names = [lag_name(i, "count") for i in range(1, lags + 1)]
    rows = cut_lineage(splits.evaluation_cut(lagged, 3).join(t.entities.select("entity", "nation"), "entity"), "cut")
    history, truth = drop_any_null(rows.filter(F.col("part") == "history"), names), rows.filter(F.col("part") == "truth")
    fitted = linear.grouped_ridge(history, ["nation"], names, "count")
    newest = F.array(*[F.col(c).cast("double") for c in ["count", *names][:lags]])
    state = history.groupBy("nation", "entity").agg(F.max_by(newest, "start_date").alias("recent"))
    state = salted_join(state, fitted, ["nation"], ["entity"])
    for step in (1, 2, 3):
        dot = F.aggregate(F.zip_with("recent", "coef", lambda x, c: x * c), F.lit(0.0), lambda total, x: total + x)
        state = state.withColumn(f"p{step}", F.col("intercept") + dot)
        state = state.withColumn("recent", F.concat(F.array(f"p{step}"), F.slice("recent", 1, lags - 1)))
    steps = truth.withColumn("step", F.row_number().over(W.partitionBy("entity").orderBy("start_date")))
    steps = steps.join(state.select("entity", "sigma", F.array("p1", "p2", "p3").alias("path")), "entity")
    steps = steps.withColumns({"mean": F.get("path", F.col("step") - 1), "y": F.col("count").cast("double")})
    normal = {0.1: -1.2815515655446004, 0.5: 0.0, 0.9: 1.2815515655446004}  # fixed values: normal quantiles
    steps = steps.withColumns({quantile_column(p): F.col("mean") + F.col("sigma") * F.lit(z) for p, z in normal.items()})
    return steps.select("nation", "entity", "start_date", "step", "y", "mean", "q_0_1", "q_0_5", "q_0_9"), history


@query(
    "ml_8_rolled_one_lag", "ML-8 SPL-6",
    """WITH l AS (SELECT e.nation, d.entity, d.start_date, CAST(d.count AS DOUBLE) AS y, CAST(lag(d.count) OVER w AS DOUBLE) AS x,
           row_number() OVER (PARTITION BY d.entity ORDER BY d.start_date DESC) AS back FROM dense d JOIN entities e USING (entity) WINDOW w AS (PARTITION BY d.entity ORDER BY d.start_date)),
       s AS (SELECT nation, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) - sum(x) * sum(x) / count(*) AS sxx, sum(x * y) - sum(x) * sum(y) / count(*) AS sxy
         FROM l WHERE x IS NOT NULL AND back > 3 GROUP BY 1),
       f AS (SELECT nation, sxy / (sxx + 1.0) AS b, (sy - sxy / (sxx + 1.0) * sx) / n AS a FROM s),
       p AS (SELECT l.nation, l.entity, a, b, a + b * y AS p1 FROM l JOIN f USING (nation) WHERE back = 4),
       q AS (SELECT *, a + b * p1 AS p2, a + b * (a + b * p1) AS p3 FROM p)
       SELECT q.nation, q.entity, l.start_date, CAST(4 - l.back AS INTEGER) AS step, l.y, round(CASE l.back WHEN 3 THEN p1 WHEN 2 THEN p2 ELSE p3 END, 6) AS mean
       FROM q JOIN l ON l.entity = q.entity AND l.back <= 3""",
    uses="dense entities",
)
def _(t):
    steps, _ = _cluster_forecast(t, 1)
    return steps.select("nation", "entity", "start_date", "step", "y", F.round("mean", 6).alias("mean"))


@query(
    "ml_8_one_lag_per_cluster", "ML-8",
    """WITH l AS (SELECT e.nation, CAST(d.count AS DOUBLE) AS y, CAST(lag(d.count) OVER (PARTITION BY d.entity ORDER BY d.start_date) AS DOUBLE) AS x FROM dense d JOIN entities e USING (entity)),
       s AS (SELECT nation, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) - sum(x) * sum(x) / count(*) AS sxx, sum(x * y) - sum(x) * sum(y) / count(*) AS sxy,
           sum(y * y) - sum(y) * sum(y) / count(*) AS syy FROM l WHERE x IS NOT NULL GROUP BY 1),
       f AS (SELECT *, sxy / (sxx + 1.0) AS b FROM s)
       SELECT nation, n, round(b, 6) AS slope, round((sy - b * sx) / n, 6) AS intercept, round(sqrt((syy - 2 * b * sxy + b * b * sxx) / n), 6) AS sigma FROM f""",
    uses="dense entities",
)
def _(t):
    lagged = add_lags(t.dense, {"count": [1]}).filter(F.col("1_shifted_count").isNotNull())
    rows = lagged.join(t.entities.select("entity", "nation"), "entity")
    fit = linear.grouped_ridge(rows, ["nation"], ["1_shifted_count"], "count")
    slope = F.get("coef", F.lit(0))
    return fit.select("nation", "n", F.round(slope, 6).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("sigma", 6).alias("sigma"))


@query("ml_8_model_per_cluster", "ML-8 AGG-24")
def _(t):
    steps, history = _cluster_forecast(t)
    season = metrics.seasonal_error(history, "count", ["nation", "entity"])
    return metrics.agg_metrics(metrics.item_metrics(steps, season, ["nation", "entity"]), ["nation"])


@query(
    "ml_9_seasonal_forecast", "ML-9 SPL-6",
    "WITH " + FORECAST_SQL + " SELECT entity, start_date, step, y, mean, round(q_0_1, 6) AS q_0_1, round(q_0_5, 6) AS q_0_5, round(q_0_9, 6) AS q_0_9 FROM steps",
    uses="dense",
)
def _(t):
    steps, _ = seasonal_naive(t.dense, 3, "count")
    return steps.withColumns({c: F.round(c, 6) for c in ("q_0_1", "q_0_5", "q_0_9")})


@query(
    "ml_10_partial_pooling", "ML-10 PRJ-10 WIN-6",
    """WITH l AS (SELECT entity, ln(count + 0.1) AS y, ln(lag(count) OVER (PARTITION BY entity ORDER BY start_date) + 0.1) AS x FROM dense),
       f AS (SELECT entity, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
           (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) AS s2, regr_sxx(y, x) AS sxx, regr_avgx(y, x) AS mx FROM l WHERE x IS NOT NULL GROUP BY 1),
       v AS (SELECT *, s2 / sxx AS slope_var, s2 * (1.0 / n + mx * mx / sxx) AS intercept_var FROM f),
       b AS (SELECT avg(slope) AS ms, avg(intercept) AS mi, greatest(var_pop(slope) - avg(slope_var), 0) AS ts, greatest(var_pop(intercept) - avg(intercept_var), 0) AS ti FROM v)
       SELECT entity, n, round(slope, 5) AS slope, round(intercept, 5) AS intercept, round(ms + ts / (ts + slope_var) * (slope - ms), 5) AS slope_shrunk,
         round(mi + ti / (ti + intercept_var) * (intercept - mi), 5) AS intercept_shrunk FROM v, b""",
    uses="dense",
)
def _(t):
    logged = add_lags(t.dense, {"count": [1]}).withColumns(
        {"y": log_offset(F.col("count")), "x": log_offset(F.col(lag_name(1, "count")))}
    )
    out = linear.shrink(linear.lag_regression(logged, "y", "x"))
    return out.withColumns({c: F.round(c, 5) for c in out.columns if c not in ("entity", "n")})


def _presence_points(t):
    rows = t.daily.select("event_id", "entity", F.col("event_date").alias("date"), "kind")
    here, away = rows.filter(F.col("kind") == "error"), rows.filter(F.col("kind") != "error")
    points = zonal.presence_records(here.drop("kind"), away.drop("kind"), 10)
    bins = zonal.lookback_histogram(points, t.daily, ["entity"], "date", "event_date", "value", 10, 0, 100, 5, "value")
    return points.join(bins, ["entity", "date"]), [f"{k}value" for k in range(1, 6)]


@query("ml_11_presence_model", "ML-11 CAL-5 AGG-30 SET-4")
def _(t):
    joined, features = _presence_points(t)
    return models.presence_model(joined, features).select("event_id", "presence", "probability")


@query("ml_11_presence_out_of_block", "ML-11")
def _(t):
    joined, features = _presence_points(t)
    rows = joined.withColumn("month", F.trunc("date", "month"))
    return models.presence_out_of_block(rows, features, ["entity", "month"]).select("event_id", "presence", "fold", "probability")


_EM_ROUNDS = 8
_EM = ",\n       ".join(
    f"""k{k} AS MATERIALIZED (SELECT p.*, vbb / (vaa * vbb - vab * vab) AS iaa, -vab / (vaa * vbb - vab * vab) AS iab, vaa / (vaa * vbb - vab * vab) AS ibb FROM p{k} p),
       q{k} AS MATERIALIZED (SELECT s.*, n / noise + iaa AS qaa, sx / noise + iab AS qab, sxx / noise + ibb AS qbb, sy / noise + iaa * ma + iab * mb AS ra,
             sxy / noise + iab * ma + ibb * mb AS rb FROM sums s, k{k}),
       e{k} AS MATERIALIZED (SELECT *, (qbb * ra - qab * rb) / (qaa * qbb - qab * qab) AS a, (qaa * rb - qab * ra) / (qaa * qbb - qab * qab) AS b,
             qbb / (qaa * qbb - qab * qab) AS paa, -qab / (qaa * qbb - qab * qab) AS pab, qaa / (qaa * qbb - qab * qab) AS pbb FROM q{k}),
       p{k + 1} AS MATERIALIZED (SELECT avg(a) AS ma, avg(b) AS mb, avg(paa + a * a) - avg(a) * avg(a) AS vaa, avg(pab + a * b) - avg(a) * avg(b) AS vab, avg(pbb + b * b) - avg(b) * avg(b) AS vbb,
             sum(syy - 2 * a * sy - 2 * b * sxy + a * a * n + 2 * a * b * sx + b * b * sxx + n * paa + 2 * sx * pab + sxx * pbb) / sum(n) AS noise FROM e{k})"""
    for k in range(_EM_ROUNDS + 1)
)


@query(
    "ml_10_correlated_pooling", "ML-10",
    f"""WITH l AS (SELECT entity, ln(count + 0.1) AS y, ln(lag(count) OVER (PARTITION BY entity ORDER BY start_date) + 0.1) AS x FROM dense),
       sums AS MATERIALIZED (SELECT entity, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM l WHERE x IS NOT NULL GROUP BY 1),
       p0 AS MATERIALIZED (SELECT regr_intercept(y, x) AS ma, regr_slope(y, x) AS mb, 1.0::DOUBLE AS vaa, 0.0::DOUBLE AS vab, 1.0::DOUBLE AS vbb,
             (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / count(*) AS noise FROM l WHERE x IS NOT NULL),
       {_EM}
       SELECT entity, n, round(a, 6) AS intercept, round(b, 6) AS slope FROM e{_EM_ROUNDS}""",
    uses="dense",
)
def _(t):
    logged = add_lags(t.dense, {"count": [1]}).withColumns(
        {"y": log_offset(F.col("count")), "x": log_offset(F.col(lag_name(1, "count")))}
    )
    out = linear.pool_correlated(logged, "y", "x", rounds=_EM_ROUNDS)
    return out.withColumns({c: F.round(c, 6) for c in ("intercept", "slope")})


_GRID = {"style": ["threshold"], "lag": [1, 2, 12], "factor": [0.5, 1.0]}


@query(
    "ml_12_parameter_grid", "ML-12",
    """WITH f AS (SELECT p.*, x.expected, lag(p.count, 1) OVER w AS l1, lag(p.count, 2) OVER w AS l2, lag(p.count, 12) OVER w AS l12
           FROM panel p JOIN expected x USING (entity, month) WINDOW w AS (PARTITION BY entity ORDER BY start_date)),
       g AS (SELECT * FROM (VALUES (1), (2), (12)) a(lag) CROSS JOIN (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) b(factor)),
       r AS (SELECT g.lag, g.factor, CASE WHEN f.count > f.expected THEN 1 ELSE 0 END AS truth,
           CASE WHEN (CASE g.lag WHEN 1 THEN l1 WHEN 2 THEN l2 ELSE l12 END) > f.expected * g.factor THEN 1 ELSE 0 END AS pred FROM f, g WHERE l12 IS NOT NULL)
       SELECT lag, factor, count(*) AS n, CAST(sum(CASE WHEN truth = pred THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM r GROUP BY 1, 2""",
    uses="panel expected",
)
def _(t):
    # every grid point scores the rule "the lagged count exceeds factor times the seasonal mean"
    lagged = add_lags(t.panel, {"count": [1, 2, 12]}).filter(F.col("12_shifted_count").isNotNull())
    expected = targets.expectations(t.panel, ("entity", "month"), "count")
    rows = sweeps.explode_grid(lagged.join(expected, ["entity", "month"]), _GRID)
    past = F.when(F.col("lag") == 1, F.col("1_shifted_count")).when(F.col("lag") == 2, F.col("2_shifted_count")).otherwise(F.col("12_shifted_count"))
    hit = (F.col("count") > F.col("expected")) == (past > F.col("expected") * F.col("factor"))
    return rows.groupBy("lag", "factor").agg(F.count("*").alias("n"), F.sum(F.when(hit, 1).otherwise(0)).alias("hits"))


_FITTED = {"lag": [1, 2, 3], "alpha": [0.1, 1.0, 10.0]}


@query(
    "ml_12_fitted_grid", "ML-12 ML-16",
    "WITH " + _LAG_FRAME.split(",\n    fit AS")[0] + """,
       a AS (SELECT * FROM (VALUES (0.1::DOUBLE), (1.0::DOUBLE), (10.0::DOUBLE)) v(alpha)),
       sums AS (SELECT lag, sum(x * (2 * label - 1)) - sum(x) * sum(2 * label - 1) / count(*) AS sxy, sum(x * x) - sum(x) * sum(x) / count(*) AS sxx,
         avg(x) AS mx, avg(2 * label - 1) AS my FROM long WHERE is_train AND lag IN ('l1', 'l2', 'l3') GROUP BY 1)
       SELECT CAST(lag[2:] AS INTEGER) AS lag, alpha, label AS truth, CASE WHEN my + sxy / (sxx + alpha) * (x - mx) > 0 THEN 1 ELSE 0 END AS predicted, count(*) AS n
       FROM long JOIN sums USING (lag) CROSS JOIN a WHERE NOT is_train GROUP BY 1, 2, 3, 4""",
    uses="panel",
)
def _(t):
    # every grid point fits a ridge of its own; the point's columns stand on every row of its result
    train, test = splits.temporal_holdout(cut_lineage(_frame(t)), TRAIN_START, TRAIN_END, TEST_END)
    a, b = targets.label_splits(train, test, "relative_binary")
    coded = [df.withColumn("label", F.col("cat_target").cast("int")) for df in (a, b)]
    sweep = sweeps.RidgeSweep(coded[0], CASE_LAGS, {"label": 2})
    points = sweeps.grid_points(_FITTED)
    grid = [sweeps.Model(f"{p['lag']}/{p['alpha']}", (CASE_LAGS[p["lag"] - 1],), "label", alpha=p["alpha"]) for p in points]
    parts = F.split("model", "/")
    out = sweep.confusion(coded[1], grid)
    return out.select(parts[0].cast("int").alias("lag"), parts[1].cast("double").alias("alpha"), "truth", "predicted", "n")


STYLES = {"relative_ternary": 3, "relative_binary": 2, "simple_binary": 2, "simple_ternary": 3}


def _sweep_frames(t, lookback: int):
    """Widest lag frame, written once, with one label column per target style, cut into training and test."""
    frame = cut_lineage(_frame(t, lookback))
    train, test = splits.temporal_holdout(frame, TRAIN_START, TRAIN_END, TEST_END)
    for style in STYLES:
        train, test = targets.label_splits(train, test, style)
        train, test = (df.withColumnRenamed("cat_target", style).withColumn(style, F.col(style).cast("int")) for df in (train, test))
    return train, test


def lag_target_grid() -> list[sweeps.Model]:
    """Target styles by lags: 24 case lags from the lag on, and the month."""
    return [sweeps.Model(f"{style}/lag{lag}", (*window_of("cases", lag), "month"), style) for style in STYLES for lag in SWEPT]


@query("ml_13_lag_target_sweep", "ML-13")
def _(t):
    train, test = _sweep_frames(t, 23 + max(SWEPT))
    sweep = sweeps.RidgeSweep(train, [*window_of("cases", 1, 23 + max(SWEPT)), "month"], STYLES)
    return sweep.scores(test, lag_target_grid())


@query(
    "ml_13_single_lag_sweep", "ML-13 AGG-19",
    "WITH " + _LAG_FRAME + """ SELECT 'lag' || lag[2:] AS model, label AS truth, predicted, count(*) AS n FROM scored GROUP BY 1, 2, 3""",
    uses="panel",
)
def _(t):
    train, test = splits.temporal_holdout(cut_lineage(_frame(t)), TRAIN_START, TRAIN_END, TEST_END)
    a, b = targets.label_splits(train, test, "relative_binary")
    coded = [df.withColumn("label", F.col("cat_target").cast("int")) for df in (a, b)]
    sweep = sweeps.RidgeSweep(coded[0], CASE_LAGS, {"label": 2})
    return sweep.confusion(coded[1], [sweeps.Model(f"lag{i}", (CASE_LAGS[i - 1],), "label") for i in range(1, 7)])


@query("ml_13_lookback_sweep", "ML-13")
def _(t):
    train, test = _sweep_frames(t, 48)
    names = [lag_name(i, "cases") for i in range(1, 49)]
    sweep = sweeps.RidgeSweep(train, [*names, "month"], STYLES)
    grid = [sweeps.Model(f"{style}/lookback{k}", (*names[:k], "month"), style) for style in STYLES for k in range(1, 49)]
    return sweep.scores(test, grid)


COVARIATES = ["volume", "top_price", "low_tax"]
ALL_COVARIATES = [*COVARIATES, "mean_price", "low_quantity"]


def _covariate_rows(t, covariates=COVARIATES, parameters=None, lookback: int = 6):
    """Counts with lags of counts and of covariates, labelled relative to the training mean."""
    table = t.parameters if parameters is None else parameters
    joined = t.panel.join(table.select("entity", "start_date", *covariates), ["entity", "start_date"], "left")
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in covariates})
    frame = lag_frame(
        filled, TRAIN_START, TEST_END, "count", case_lookback=lookback, env_list=covariates, env_lookback=lookback, env_lag=1, dense=True
    )
    train, test = splits.temporal_holdout(cut_lineage(frame), TRAIN_START, TRAIN_END, TEST_END)
    a, b = targets.label_splits(train, test, "relative_binary")
    return a.withColumn("label", F.col("cat_target").cast("int")), b.withColumn("label", F.col("cat_target").cast("int"))


def covariate_grid() -> list[sweeps.Model]:
    """All 32 sets of covariates by lags: 24 lags of cases and of each covariate from the lag on, and the month."""
    sets = [s for k in range(len(ALL_COVARIATES) + 1) for s in combinations(ALL_COVARIATES, k)]
    return [
        sweeps.Model(f"{'+'.join(s) or 'none'}/lag{lag}", (*[x for c in ("cases", *s) for x in window_of(c, lag)], "month"), "label")
        for s in sets for lag in SWEPT
    ]


@query("ml_13_covariate_sweep", "ML-13")
def _(t):
    widest = 23 + max(SWEPT)
    train, test = _covariate_rows(t, ALL_COVARIATES, t.wide_parameters, widest)
    sweep = sweeps.RidgeSweep(train, [*[x for c in ("cases", *ALL_COVARIATES) for x in window_of(c, 1, widest)], "month"], {"label": 2})
    return sweep.scores(test, covariate_grid())


@query("ml_14_forward_selection", "ML-14 SPL-2 AGG-21")
def _(t):
    frame = cut_lineage(_frame(t, 48), "frame")  # each style's expectations read it too
    for style in STYLES:
        labelled, _ = getattr(targets, style)(frame)
        frame = labelled.withColumnRenamed("cat_target", style).withColumn(style, F.col(style).cast("int"))
    blocks = cut_lineage(splits.fold_blocks(frame, 4))
    names = [*[lag_name(i, "cases") for i in range(1, 49)], "month"]
    sweep = sweeps.RidgeSweep(blocks, names, STYLES, block="block")
    rows = []
    for style in STYLES:
        chosen = sweeps.forward_selection(sweep, blocks.filter(F.col("block") > 0), style, (1, 2, 3, 4))
        rows += [(style, i + 1, name, score) for i, (name, score) in enumerate(chosen)]
    return t.spark.createDataFrame(rows, "style string, step int, feature string, f1_macro double")


#: Candidates of the first rung, and trees of the first and of the last rung.
HALVING = {"candidates": 8, "start": 1, "most": 8}


@query("ml_15_successive_halving", "ML-15 SPL-2 AGG-27")
def _(t):
    labelled, _ = targets.relative_binary(cut_lineage(_frame(t, 48), "frame"))  # expectations and class weights read it too
    coded = metrics.class_weights(labelled.withColumn("label", F.col("cat_target").cast("int")).drop("cat_target"), "label")
    blocks = cut_lineage(splits.fold_blocks(coded, 4))
    names = [*[lag_name(i, "cases") for i in range(1, 49)], "month"]
    bins = boosting.fit_bins(blocks, names)
    rows = boosting.binned(blocks, bins, "label", "weight", "block")
    schedule = sweeps.halving_schedule(HALVING["candidates"], HALVING["start"], HALVING["most"])
    history = boosting.halving_search(rows, bins, sweeps.random_candidates(HALVING["candidates"]), (1, 2, 3, 4), schedule)
    out = [(h["rung"], h["candidate"], h["resource"], h["setting"].step, h["setting"].leaves, h["setting"].least, h["setting"].l2, h["score"]) for h in history]
    return t.spark.createDataFrame(out, "rung int, candidate int, resource int, step double, leaves int, least int, l2 double, balanced_accuracy double")


@query(
    "ml_16_one_feature_models", "ML-16",
    f"""WITH j AS (SELECT p.entity, p.start_date, p.month, p.count, coalesce(q.volume, 0) AS volume, coalesce(q.top_price, 0) AS top_price, coalesce(q.low_tax, 0) AS low_tax
           FROM panel p LEFT JOIN parameters q USING (entity, start_date)),
      g AS (SELECT *, lag(volume) OVER w AS volume1, lag(top_price) OVER w AS top_price1, lag(low_tax) OVER w AS low_tax1, lag(count, 6) OVER w AS l6 FROM j WINDOW w AS (PARTITION BY entity ORDER BY start_date)),
      fr AS (SELECT * FROM g WHERE l6 IS NOT NULL AND start_date >= DATE '{TRAIN_START}' AND start_date < DATE '{TEST_END}'),
      ex AS (SELECT entity, month, CAST(sum(count) AS DOUBLE) / count(*) AS e FROM fr WHERE start_date < DATE '{TRAIN_END}' GROUP BY 1, 2),
      lab AS (SELECT volume1, top_price1, low_tax1, CASE WHEN count > e THEN 1 ELSE 0 END AS label, start_date < DATE '{TRAIN_END}' AS is_train FROM fr JOIN ex USING (entity, month)),
      long AS (UNPIVOT lab ON volume1, top_price1, low_tax1 INTO NAME model VALUE x),
      fit AS (SELECT model, (sum(x * (2 * label - 1)) - sum(x) * sum(2 * label - 1) / count(*)) / (sum(x * x) - sum(x) * sum(x) / count(*) + 1.0) AS coef, avg(x) AS mx, avg(2 * label - 1) AS my
        FROM long WHERE is_train GROUP BY 1)
      SELECT left(model, length(model) - 1) AS model, label AS truth, CASE WHEN my + coef * (x - mx) > 0 THEN 1 ELSE 0 END AS predicted, count(*) AS n
      FROM long JOIN fit USING (model) WHERE NOT is_train GROUP BY 1, 2, 3""",
    uses="panel parameters",
)
def _(t):
    train, test = _covariate_rows(t)
    names = [lag_name(1, c) for c in COVARIATES]
    sweep = sweeps.RidgeSweep(train, names, {"label": 2})
    return sweep.confusion(test, [sweeps.Model(c, (lag_name(1, c),), "label") for c in COVARIATES])


def feature_grid() -> list[sweeps.Model]:
    """A model for each covariate: 24 lags of cases and of the covariate, and the month."""
    return [sweeps.Model(c, (*window_of("cases", 1), *window_of(c, 1), "month"), "label") for c in COVARIATES]


@query("ml_16_model_per_feature", "ML-16")
def _(t):
    train, test = _covariate_rows(t, lookback=24)
    sweep = sweeps.RidgeSweep(train, [*[x for c in ("cases", *COVARIATES) for x in window_of(c, 1)], "month"], {"label": 2})
    return sweep.scores(test, feature_grid())
