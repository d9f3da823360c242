"""Distributed operators against plain computations on small inputs, with hot groups, ties and gaps."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from panelkit.operators import association, joins, linear, models, ranking, sweeps
from panelkit.operators.metrics import quantile_column
from panelkit.sources.geometry import region_centroids


def hot_values(seed=0):
    """One group with most rows, ties, a far outlier and a constant group."""
    rng = random.Random(seed)
    data = [("hot", float(rng.randint(0, 400)) / 4, float(rng.randint(1, 5))) for _ in range(900)]
    data += [("hot", 1e12, 2.0), ("hot", -1e12, 1.0), ("flat", 3.0, 1.0), ("flat", 3.0, 2.0), ("one", 7.5, 4.0)]
    data += [("cold", rng.gauss(0, 1), float(rng.randint(1, 3))) for _ in range(37)]
    return data


@pytest.mark.parametrize("large", [True, False])
def test_exact_quantiles(spark, large):
    data = hot_values()
    df = spark.createDataFrame(data, "g string, v double, w double").repartition(5)
    probs = {"a": 0.25, "b": 0.5, "c": 0.9}
    got = {r["g"]: r for r in ranking.exact_quantiles(df, ["g"], "v", probs, large=large).collect()}
    frame = pd.DataFrame(data, columns=["g", "v", "w"])
    for g, part in frame.groupby("g"):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(part["v"], p), rel=1e-12), (g, name)


@pytest.mark.parametrize("large", [True, False])
def test_weighted_quantiles(spark, large):
    data = hot_values(1)
    df = spark.createDataFrame(data, "g string, v double, w double").repartition(3)
    got = {r["g"]: r["m"] for r in ranking.exact_quantiles(df, ["g"], "v", {"m": 0.5}, "w", large=large).collect()}
    for g, part in pd.DataFrame(data, columns=["g", "v", "w"]).groupby("g"):
        part = part.sort_values("v")
        upto = part["w"].cumsum()
        assert got[g] == part["v"][upto >= part["w"].sum() * 0.5].iloc[0]


def test_quantiles_without_keys(spark):
    data = hot_values(2)
    df = spark.createDataFrame(data, "g string, v double, w double")
    got = ranking.exact_quantiles(df, [], "v", {"m": 0.5, "q": 0.1}).first()
    values = [v for _, v, _ in data]
    assert got["m"] == np.quantile(values, 0.5) and got["q"] == pytest.approx(np.quantile(values, 0.1))


def series_frame(spark, n=23, length=17, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 4, size=(n, length)).astype(float)
    x[4] = 2.0  # constant series
    x[9] = x[8]  # exact copy
    x[11, 3] = np.nan
    data = [(i * 10, [None if math.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)]
    return x, spark.createDataFrame(data, "entity long, v array<double>").repartition(4)


def plain_corr(a, b):
    ok = ~(np.isnan(a) | np.isnan(b))
    a, b = a[ok], b[ok]
    if a.std() == 0 or b.std() == 0:
        return None
    return np.corrcoef(a, b)[0, 1]


@pytest.mark.parametrize("block", [4, 2048])
def test_pairwise_corr(spark, block):
    x, df = series_frame(spark)
    got = {(r["i"] // 10, r["j"] // 10): r["corr"] for r in association.pairwise_corr(df, "v", block=block).collect()}
    assert len(got) == 23 * 22 // 2
    for (i, j), value in got.items():
        want = plain_corr(x[i], x[j])
        assert i < j and (value is None) == (want is None)
        assert want is None or value == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("block", [5, 2048])
def test_cross_corr_and_top(spark, block):
    x, df = series_frame(spark)
    both = df.select("entity", F.slice("v", 2, 16).alias("now"), F.slice("v", 1, 16).alias("before"))
    got = {(r["i"] // 10, r["j"] // 10): r["corr"] for r in association.cross_corr(both, "now", "before", block=block).collect()}
    assert len(got) == 23 * 23
    want = {(i, j): plain_corr(x[i, 1:], x[j, :-1]) for i in range(23) for j in range(23)}
    for key, value in got.items():
        assert (value is None) == (want[key] is None) and (value is None or value == pytest.approx(want[key], abs=1e-12))
    top = {(r["i"] // 10, r["rank"]): r["j"] // 10 for r in association.top_correlated(both, "now", "before", 2, block=block).collect()}
    for i in range(23):
        known = sorted((-round(want[i, j], 12), j) for j in range(23) if j != i and want[i, j] is not None)
        if known:
            assert top[i, 1] == known[0][1]
        else:
            assert (i, 1) not in top


def test_most_like_equals_top_of_all(spark):
    _, df = series_frame(spark)
    every = association.top_correlated(df, "v", k=5, block=6).filter("i = 70").orderBy("rank").collect()
    one = association.most_like(df, F.col("entity") == 70, "v", 5, block=6).orderBy("rank").collect()
    assert [(r["j"], round(r["corr"], 12)) for r in every] == [(r["j"], round(r["corr"], 12)) for r in one]


@pytest.mark.parametrize("block", [4, 2048])
def test_nearest_with_copies(spark, block):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, size=(40, 3)).astype(float)
    x[:14] = x[0]  # a third of the vectors are copies
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "entity long, v array<double>")
    got = {(r["i"], r["rank"]): (r["j"], r["distance"]) for r in association.nearest(df, "v", 6, block=block).collect()}
    for i in range(40):
        order = sorted((float(np.linalg.norm(x[i] - x[j])), j) for j in range(40))[:6]
        assert [got[i, r + 1][0] for r in range(6)] == [j for _, j in order]
        assert [got[i, r + 1][1] for r in range(6)] == pytest.approx([d for d, _ in order])


@pytest.mark.parametrize("kind", ["prefix", "outlier", "timestamp_ntz"])
def test_positions_use_even_ranges(spark, kind):
    """Ids with one prefix, ids beside a far outlier and local timestamps: no task numbers more than a few shares."""
    ids = spark.range(100_000).withColumn("r", F.xxhash64("id"))
    value = {
        "prefix": F.format_string("Customer#%09d", "id"), "outlier": F.when(F.col("id") == 5, 1e15).otherwise(F.col("id") / 7),
        "timestamp_ntz": F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id)"),
    }[kind]
    placed = ranking.global_position(ids.select("id", value.alias("v")).orderBy("r"), "v", ["id"])
    wrong = placed.withColumn("expected", F.row_number().over(W.orderBy("v", "id"))).filter("expected <> position").count()
    assert wrong == 0
    sizes = [r["count"] for r in ids.select(value.alias("v"), "id").repartitionByRange(4, "v", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2.5 * 100_000 / 4


def test_global_position_and_dense_code(spark):
    rng = random.Random(1)
    values = [rng.choice([1, 5, 5, 5, 10**12, -7]) for _ in range(200)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i int").repartition(6)
    placed = ranking.global_position(df, "v", ["i"]).orderBy("position").collect()
    assert [r["position"] for r in placed] == list(range(1, 201))
    assert [(r["v"], r["i"]) for r in placed] == sorted((v, i) for i, v in enumerate(values))
    codes = {r["v"]: r["code"] for r in ranking.dense_code(df, "v").collect()}
    assert codes == {v: k + 1 for k, v in enumerate(sorted(set(values)))}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, rows, how):
    big = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k int, i int")
    small = spark.createDataFrame([(1, "x"), (3, "y"), (500, "z")], "k int, name string")
    assert rows(joins.salted_join(big, small, ["k"], ["i"], 7, how)) == rows(big.join(small, "k", how))


def regression_rows(spark, n=240, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 3, 0.5, 2]
    label = np.clip(np.round(x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=n) + 1), 0, 2).astype(int)
    block = np.minimum(np.arange(n) * 5 // n, 4)
    data = [(*map(float, r), int(y), int(b)) for r, y, b in zip(x, label, block)]
    return x, label, block, spark.createDataFrame(data, "a double, b double, c double, d double, label int, block int").repartition(7)


def ridge(x, y, alpha):
    m, t = x.mean(0), y.mean(0)
    coef = np.linalg.solve((x - m).T @ (x - m) + alpha * np.eye(x.shape[1]), (x - m).T @ (y - t))
    return coef, t - m @ coef


def test_ridge_sweep_equals_normal_equations(spark):
    x, label, block, df = regression_rows(spark)
    sweep = sweeps.RidgeSweep(df, ["a", "b", "c", "d"], {"label": 3}, block="block", alpha=2.0)
    y = np.where(label[:, None] == np.arange(3), 1.0, -1.0)
    for model, used, train in (
        (sweeps.Model("all", ("a", "b", "c", "d"), "label"), [0, 1, 2, 3], np.full(len(x), True)),
        (sweeps.Model("two", ("d", "a"), "label", fold=3), [3, 0], block < 3),
    ):
        coef, intercept = ridge(x[train][:, used], y[train], 2.0)
        got, at = sweep.fit(model)
        assert got[used] == pytest.approx(coef) and at == pytest.approx(intercept)
        assert not got[[i for i in range(4) if i not in used]].any()


def macro_f1(truth, pred):
    scores = []
    for c in np.unique(np.concatenate([truth, pred])):
        tp = ((truth == c) & (pred == c)).sum()
        scores.append(2 * tp / ((truth == c).sum() + (pred == c).sum()))
    return np.mean(scores)


def test_forward_selection_equals_greedy_search(spark):
    x, label, block, df = regression_rows(spark)
    names = ["a", "b", "c", "d"]
    sweep = sweeps.RidgeSweep(df, names, {"label": 3}, block="block")
    got = sweeps.forward_selection(sweep, df.filter("block > 0"), "label", (1, 2, 3, 4))

    def score(used):
        marks = []
        for k in (1, 2, 3, 4):
            train, test = block < k, block == k
            coef, at = ridge(x[train][:, used], np.where(label[train][:, None] == np.arange(3), 1.0, -1.0), 1.0)
            marks.append(macro_f1(label[test], np.argmax(x[test][:, used] @ coef + at, axis=1)))
        return np.mean(marks)

    chosen, best = [], -np.inf
    while len(chosen) < 4:
        top = max(((score([*chosen, i]), -i) for i in range(4) if i not in chosen))
        if top[0] - best < 0.001:
            break
        best = top[0]
        chosen.append(-top[1])
    assert [name for name, _ in got] == [names[i] for i in chosen]
    assert got[-1][1] == pytest.approx(best)


def test_mllib_ridge_classifier_equals_normal_equations(spark):
    x, label, _, df = regression_rows(spark)
    out = models.ridge_classifier(df, df, ["a", "b", "c", "d"], 3, alpha=5.0).collect()
    coef, at = ridge(x, np.where(label[:, None] == np.arange(3), 1.0, -1.0), 5.0)
    for r in out:
        scores = np.array([r["a"], r["b"], r["c"], r["d"]]) @ coef + at
        assert [r[f"score_{k}"] for k in range(3)] == pytest.approx(scores, abs=1e-6)
        assert r["prediction"] == np.argmax(scores)


def test_grouped_ridge_per_key(spark):
    x, label, block, df = regression_rows(spark)
    got = {r["block"]: r for r in linear.grouped_ridge(df, ["block"], ["a", "b"], "c", alpha=1.0).collect()}
    for b in range(5):
        used = block == b
        coef, at = ridge(x[used][:, [0, 1]], x[used][:, 2], 1.0)
        resid = x[used][:, 2] - x[used][:, [0, 1]] @ coef - at
        assert got[b]["coef"] == pytest.approx(coef) and got[b]["intercept"] == pytest.approx(at)
        assert got[b]["sigma"] == pytest.approx(np.sqrt(np.mean(resid**2))) and got[b]["n"] == used.sum()


def test_local_classifier_reports_failed_fits(spark):
    import datetime as dt

    data = [("A", dt.date(2020, m, 1), "train" if m < 9 else "test", float(m % 2), float(m % 2 + 0.01 * m)) for m in range(1, 13)]
    data += [("B", dt.date(2020, m, 1), "train" if m < 9 else "test", 0.0, float(m)) for m in range(1, 13)]
    df = spark.createDataFrame(data, "entity string, start_date date, split string, label double, x double")
    out = linear.local_ridge_classes(df, ["x"], "style").collect()
    assert {(r["entity"], r["error"] == "NONE") for r in out} == {("A", True), ("B", False)}
    assert [r["predictions"] for r in out if r["entity"] == "B"] == [-999.0]
    assert all(r["predictions"] == r["ground_truth"] for r in out if r["entity"] == "A")


def test_lag_regression_and_shrinkage(spark):
    rng = np.random.default_rng(4)
    data, truth = [], {}
    for e in range(6):
        x = rng.normal(size=12)
        y = 1 + e * 0.2 * x + rng.normal(size=12) * 0.5
        truth[e] = np.polyfit(x, y, 1)
        data += [(e, float(a), float(b)) for a, b in zip(x, y)]
    data += [(99, 1.0, 2.0)] * 5  # no variation
    df = spark.createDataFrame(data, "entity int, x double, y double")
    fits = linear.lag_regression(df, "y", "x")
    got = {r["entity"]: r for r in fits.collect()}
    assert got[99]["slope"] is None
    for e, (slope, intercept) in truth.items():
        assert got[e]["slope"] == pytest.approx(slope) and got[e]["intercept"] == pytest.approx(intercept)
    shrunk = {r["entity"]: r for r in linear.shrink(fits).collect()}
    mean = np.mean([s for s, _ in truth.values()])
    for e in truth:
        low, high = sorted([mean, shrunk[e]["slope"]])
        assert low - 1e-12 <= shrunk[e]["slope_shrunk"] <= high + 1e-12


def test_robust_scaling_uses_training_rows_only(spark):
    train = spark.createDataFrame([(float(v), 5.0) for v in (1, 2, 3, 4, 5)], "x double, flat double")
    test = spark.createDataFrame([(100.0, 6.0)], "x double, flat double")
    scaled = models.robust_scale(train, [test], ["x", "flat"])
    assert scaled[1].first()["x"] == pytest.approx((100 - 3) / 2) and scaled[1].first()["flat"] == 1.0
    assert [r["x"] for r in scaled[0].orderBy("x").collect()] == [-1.0, -0.5, 0.0, 0.5, 1.0]


def test_cluster_tree_is_nested(spark):
    rng = np.random.default_rng(6)
    data = [(i, (rng.normal(size=5) + (i % 4) * 10).tolist()) for i in range(40)]
    df = spark.createDataFrame(data, "entity int, v array<double>")
    tree = models.cluster_tree(df, "v", levels=2, rounds=3).toPandas()
    for level in range(3):
        assert sorted(tree[tree.level == level].entity) == list(range(40))
    up = tree[tree.level == 1].set_index("entity").node
    assert all(up[r.entity] == r.parent for r in tree[tree.level == 2].itertuples())
    leaves = tree[tree.level == 2].set_index("entity").node
    groups = {g: {leaves[e] for e in range(40) if e % 4 == g} for g in range(4)}
    assert all(len(nodes) == 1 for nodes in groups.values()) and len(set().union(*groups.values())) == 4


def test_flat_clusters_cover_all(spark):
    df = spark.createDataFrame([(i, [float(i % 3), float(i % 5)]) for i in range(30)], "entity int, v array<double>")
    out = models.flat_clusters(df, "v", 4).collect()
    assert sorted(r["entity"] for r in out) == list(range(30)) and {r["cluster"] for r in out} <= set(range(4))


def test_halving_schedule():
    assert sweeps.halving_schedule(8, 100, 5000) == [(8, 100), (4, 200), (2, 400), (1, 800)]
    assert sweeps.halving_schedule(8, 100, 250) == [(8, 100), (4, 200)]
    drawn = sweeps.random_candidates(50)
    assert drawn == sweeps.random_candidates(50)
    assert all(1e-4 <= c.step <= 0.1 and 2 <= c.leaves <= 99 and 20 <= c.least <= 249 and 0 <= c.l2 <= 2 for c in drawn)


@pytest.mark.parametrize("closed", [True, False])
def test_region_centroids(spark, closed):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)] + ([(0.0, 0.0)] if closed else [])
    df = spark.createDataFrame([("r", i, x, y) for i, (x, y) in enumerate(square)], "region string, vertex_no int, x double, y double")
    out = region_centroids(df).first()
    assert (out["area"], out["x_centroid"], out["y_centroid"]) == (8.0, 2.0, 1.0)


def test_quantile_column_names():
    assert [quantile_column(p) for p in (0.1, 0.5, 0.025)] == ["q_0_1", "q_0_5", "q_0_025"]
