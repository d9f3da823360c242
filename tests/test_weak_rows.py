"""Polygon coverage, natural breaks and correlated pooling against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import coverage, linear, models, results, zonal
from panelkit.plans import modelling

VERTICES = "region string, ring int, hole boolean, vertex_no int, x double, y double"


def ring(region, number, hole, points):
    return [(region, number, hole, k, float(x), float(y)) for k, (x, y) in enumerate(points)]


def clip(points, x0, y0, x1, y1):
    """Outline inside a box, side by side."""
    for axis, bound, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for a, b in zip(points, points[1:] + points[:1]):
            ina, inb = keep * (a[axis] - bound) >= 0, keep * (b[axis] - bound) >= 0
            if ina != inb:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                cut = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
            if ina and inb:
                out.append(b)
            elif ina:
                out.append(cut)
            elif inb:
                out += [cut, b]
        points = out
        if not points:
            return []
    return points


def area(points):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))) / 2 if points else 0.0


def plain_shares(rings, size, x0, y0):
    out = {}
    for row, col in itertools.product(range(-8, 20), repeat=2):
        box = (x0 + col * size, y0 + row * size, x0 + (col + 1) * size, y0 + (row + 1) * size)
        for region, parts in rings.items():
            share = sum((-1 if hole else 1) * area(clip(points, *box)) for hole, points in parts) / size**2
            if abs(share) > 1e-9:
                out[region, row, col] = share
    return out


def star(rng, cx, cy, n, r):
    """A simple outline around a center."""
    angles = sorted(rng.uniform(0, 2 * np.pi) for _ in range(n))
    return [(cx + r * rng.uniform(0.4, 1) * np.cos(a), cy + r * rng.uniform(0.4, 1) * np.sin(a)) for a in angles]


@pytest.mark.parametrize(("size", "x0", "y0"), [(1.0, 0.0, 0.0), (0.7, -0.3, 0.45)])
def test_cell_shares(spark, size, x0, y0):
    """Holes, both directions, closed rings, edges on cell borders, regions inside one cell, parts apart."""
    rng = random.Random(3)
    rings = {
        "square": [(False, [(1, 1), (5, 1), (5, 4), (1, 4)])],
        "holed": [(False, [(0, 0), (0, 6), (6, 6), (6, 0)]), (True, [(1.5, 1.5), (4.25, 1.75), (3, 4.5)])],
        "small": [(False, [(2.2, 2.3), (2.4, 2.3), (2.3, 2.6)])],
        "parts": [(False, [(-2, -2), (-1, -2), (-1.5, 0.5)]), (False, [(7, 7), (8.5, 7.25), (7.5, 9)])],
        "star": [(False, star(rng, 3, 3, 14, 3.0))],
    }
    rows = [r for region, parts in rings.items() for k, (hole, points) in enumerate(parts) for r in ring(region, k, hole, points)]
    rows.append(("square", 0, False, 4, 1.0, 1.0))  # closed by a repeated vertex
    got = {(r["region"], r["row"], r["col"]): r["share"] for r in coverage.cell_shares(spark.createDataFrame(rows, VERTICES), size, x0, y0).collect()}
    want = plain_shares({k: [(h, [tuple(map(float, p)) for p in points]) for h, points in parts] for k, parts in rings.items()}, size, x0, y0)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_shared_edges_add_up(spark):
    """Neighbours that share slanted edges cover each cell once."""
    rng = random.Random(8)
    bends = [(3 + rng.uniform(-1, 1), y) for y in np.linspace(0, 6, 9)]
    left = [(0, 0), *bends, (0, 6)]
    right = [(6, 6), *bends[::-1], (6, 0)]
    df = spark.createDataFrame(ring("l", 0, False, left) + ring("r", 0, False, right), VERTICES)
    total = {(r["row"], r["col"]): r["s"] for r in coverage.cell_shares(df, 0.5).groupBy("row", "col").agg(F.sum("share").alias("s")).collect()}
    assert set(total) == set(itertools.product(range(12), repeat=2))
    assert all(s == pytest.approx(1.0) for s in total.values())


def test_zonal_mean_over_polygons(spark):
    df = spark.createDataFrame(ring("a", 0, False, [(0, 0), (2, 0), (0, 2)]), VERTICES)
    pixels = spark.createDataFrame([(c + 0.5, r + 0.5, float(10 * r + c)) for r in range(3) for c in range(3)], "x double, y double, value double")
    out = zonal.zonal_mean(coverage.region_pixels(pixels, df, 1.0), ["region"], "value", "weight").first()
    assert out["mean"] == pytest.approx((0 * 1 + 1 * 0.5 + 10 * 0.5) / 2)


def plain_spread(values, classes):
    """Least sum of squares over all ways to break the sorted distinct values."""
    distinct, best = sorted(set(values)), None
    for cuts in itertools.combinations(range(1, len(distinct)), classes - 1):
        total = 0.0
        for a, b in zip((0, *cuts), (*cuts, len(distinct))):
            part = np.array([v for v in values if distinct[a] <= v <= distinct[b - 1]])
            total += ((part - part.mean()) ** 2).sum()
        best = total if best is None else min(best, total)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_natural_breaks_are_least(spark, seed):
    rng = random.Random(seed)
    values = [float(rng.choice([rng.randrange(9), 40 + rng.randrange(6), 200 + rng.randrange(30)])) for _ in range(40)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "m double")
    got = results.natural_breaks(df, "m", 4).collect()
    assert [r["class"] for r in got if r["m"] is None] == [None]
    classes = {}
    for r in got:
        if r["m"] is not None:
            classes.setdefault(r["class"], []).append(r["m"])
    assert sorted(classes) == [1, 2, 3, 4]
    assert all(max(classes[k]) < min(classes[k + 1]) for k in (1, 2, 3))
    assert sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in classes.values()) == pytest.approx(plain_spread(values, 4))


def test_natural_breaks_few_and_many_values(spark):
    few = spark.createDataFrame([(3.0,), (1.0,), (3.0,)], "m double")
    assert sorted(r["class"] for r in results.natural_breaks(few, "m", 5).collect()) == [1, 2, 2]
    assert results.natural_breaks(few.filter("m > 9"), "m").count() == 0
    many = spark.range(3_000).select((F.col("id") % 3 * 100_000 + F.col("id")).cast("double").alias("m"))
    got = results.natural_breaks(many, "m", 3, cells=60).groupBy("class").agg(F.count("*").alias("n"), F.min("m").alias("low")).orderBy("class").collect()
    assert [(r["class"], r["n"]) for r in got] == [(1, 1000), (2, 1000), (3, 1000)]


def plain_pooling(groups, rounds):
    """EM with matrices over the rows themselves."""
    x, y = (np.concatenate([np.array(g)[:, k] for g in groups.values()]) for k in (0, 1))
    line = np.polyfit(x, y, 1)
    mean, cov = np.array([line[1], line[0]]), np.eye(2)
    noise = ((y - np.polyval(line, x)) ** 2).mean()
    design = {k: (np.column_stack([np.ones(len(g)), np.array(g)[:, 0]]), np.array(g)[:, 1]) for k, g in groups.items()}

    def estimates():
        out = {}
        for k, (m, t) in design.items():
            left = np.linalg.inv(m.T @ m / noise + np.linalg.inv(cov))
            out[k] = left @ (m.T @ t / noise + np.linalg.solve(cov, mean)), left
        return out

    for _ in range(rounds):
        e = estimates()
        mean_next = np.mean([w for w, _ in e.values()], 0)
        cov_next = np.mean([left + np.outer(w, w) for w, left in e.values()], 0) - np.outer(mean_next, mean_next)
        noise_next = sum(((t - m @ e[k][0]) ** 2).sum() + np.trace(m.T @ m @ e[k][1]) for k, (m, t) in design.items()) / len(x)
        mean, cov, noise = mean_next, cov_next, noise_next
    return {k: tuple(w) for k, (w, _) in estimates().items()}


def test_correlated_pooling(spark):
    rng = np.random.default_rng(2)
    groups = {}
    for k in range(25):
        a, b = rng.multivariate_normal([1, 0.5], [[0.5, -0.3], [-0.3, 0.4]])
        x = rng.normal(size=2 + k % 7)
        groups[k] = list(zip(x, a + b * x + rng.normal(scale=0.4, size=len(x))))
    groups[25] = [(2.0, 1.0)]  # one row, no variation
    rows = [(k, float(x), float(y)) for k, g in groups.items() for x, y in g] + [(0, None, 1.0)]
    got = linear.pool_correlated(spark.createDataFrame(rows, "entity int, x double, y double"), "y", "x", rounds=12).collect()
    want = plain_pooling(groups, 12)
    assert {r["entity"]: r["n"] for r in got} == {k: len(g) for k, g in groups.items()}
    for r in got:
        assert (r["intercept"], r["slope"]) == pytest.approx(want[r["entity"]], abs=1e-6)


def test_sweeps_move_their_windows():
    """Every grid point has whole windows of 24 lags from its own lag on, and the month."""
    lags = lambda column, lag: [f"{i}_shifted_{column}" for i in range(lag, lag + 24)]
    by_target = {m.name: m for m in modelling.lag_target_grid()}
    assert len(by_target) == 16
    for name, model in by_target.items():
        style, lag = name.split("/lag")
        assert model.label == style and list(model.features) == [*lags("cases", int(lag)), "month"]
    by_set = {m.name: list(m.features) for m in modelling.covariate_grid()}
    assert len(by_set) == 128
    for name, features in by_set.items():
        names, lag = name.split("/lag")
        picked = [] if names == "none" else names.split("+")
        assert features == [*[x for c in ("cases", *picked) for x in lags(c, int(lag))], "month"]
    assert {m.name: list(m.features) for m in modelling.feature_grid()} == {
        c: [*lags("cases", 1), *lags(c, 1), "month"] for c in modelling.COVARIATES}


def test_presence_out_of_block(spark):
    """Every row has the score of a model fitted without its fold; blocks stay whole."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        x = rng.random()
        rows.append((i, f"e{i % 20}", int(rng.random() < x), x))
    df = spark.createDataFrame(rows, "id int, entity string, presence int, x double")
    got = models.presence_out_of_block(df, ["x"], ["entity"], folds=3)
    assert got.count() == 400
    assert got.groupBy("entity").agg(F.countDistinct("fold").alias("k")).filter("k > 1").count() == 0
    folds = [r["fold"] for r in got.select("fold").distinct().collect()]
    assert len(folds) == 3
    held = got.filter(F.col("fold") == folds[0])
    others = got.filter(F.col("fold") != folds[0]).select("x", "presence")
    both = models.presence_model(others.unionByName(held.select("x", "presence").limit(0)), ["x"])
    low, high = both.agg(F.min_by("probability", "x"), F.max_by("probability", "x")).first()
    near = held.agg(F.min("probability"), F.max("probability")).first()
    assert low < high and abs(near[0] - low) < 0.1 and abs(near[1] - high) < 0.1
