"""Histogram boosting against a plain best-first booster in numpy."""

import numpy as np
import pytest

from panelkit.operators import boosting
from panelkit.operators.boosting import Boosted, Setting


def plain_tree(codes, g, h, setting):
    """Best split first; returns values by row."""
    def best(rows):
        top = None
        for f in range(codes.shape[1]):
            for b in sorted(set(codes[rows, f]))[:-1]:
                low = rows[codes[rows, f] <= b]
                high = rows[codes[rows, f] > b]
                if len(low) < setting.least or len(high) < setting.least or h[low].sum() < 1e-3 or h[high].sum() < 1e-3:
                    continue
                loss = lambda r: g[r].sum() ** 2 / (h[r].sum() + setting.l2 + 1e-12)
                gain = round(loss(low) + loss(high) - loss(rows), 9)
                if gain > 1e-9 and (top is None or gain > top[0]):
                    top = gain, low, high
        return top

    leaves = [(np.arange(len(codes)), best(np.arange(len(codes))))]
    while len(leaves) < setting.leaves:
        open_ = [k for k, (_, s) in enumerate(leaves) if s]
        if not open_:
            break
        k = max(open_, key=lambda k: leaves[k][1][0])
        _, (_, low, high) = leaves.pop(k)
        leaves += [(low, best(low)), (high, best(high))]
    out = np.zeros(len(codes))
    for rows, _ in leaves:
        out[rows] = -setting.step * g[rows].sum() / (h[rows].sum() + setting.l2 + 1e-12)
    return out


def plain_boost(codes, y, w, classes, setting, iterations):
    p = np.array([w[y == k].sum() for k in range(classes)]) / w.sum()
    outputs = 1 if classes == 2 else classes
    raw = np.zeros((len(y), outputs)) + (np.log(p[1] / p[0]) if classes == 2 else np.log(p))
    model = Boosted("m", setting, classes, base=[0.0] * outputs)
    for _ in range(iterations):
        chance = model.chances(raw)
        step = np.zeros_like(raw)
        for k in range(outputs):
            c, hit = (chance[:, 1], y == 1) if classes == 2 else (chance[:, k], y == k)
            step[:, k] = plain_tree(codes, (c - hit) * w, c * (1 - c) * w, setting)
        raw += step
    return model.chances(raw)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 400
    x = np.stack([rng.integers(0, 12, n), rng.integers(0, 7, n), rng.normal(size=n).round(1)], 1).astype(float)
    y = ((x[:, 0] > 5).astype(int) + (x[:, 1] + x[:, 2] > 3)).astype(int)
    y = np.where(rng.random(n) < 0.15, rng.integers(0, 3, n), y)
    w = rng.uniform(0.5, 2, n).round(2)
    rows = [(i, *map(float, x[i]), int(y[i]), int(y[i] > 0), float(w[i]), 1 + i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, three int, two int, w double, block int").repartition(4), x, y, w


@pytest.mark.parametrize(("label", "classes"), [("two", 2), ("three", 3)])
def test_boosting_equals_plain(table, label, classes):
    df, x, y, w = table
    setting = Setting(0.3, 6, 15, 1.5)
    got = boosting.boosted_classifier(df, df, ["a", "b", "c"], classes, label, "w", 3, setting, 200).orderBy("id").collect()
    cut = boosting.fit_bins(df, ["a", "b", "c"], 200)
    codes = cut.codes([x[:, k] for k in range(3)])
    want = plain_boost(codes.astype(int), np.minimum(y, classes - 1), w, classes, setting, 3)
    assert np.allclose([r["probabilities"] for r in got], want, atol=1e-6)
    assert [int(r["prediction"]) for r in got] == list(want.argmax(1))


def test_warm_start_and_folds(table, monkeypatch):
    """Going on gives the trees of one long run, also with scores written in between; folds see earlier blocks only."""
    df, x, y, _ = table
    cut = boosting.fit_bins(df, ["a", "b", "c"], 30)
    rows = boosting.binned(df, cut, "two", None, "block")
    one = Boosted("one", Setting(leaves=4), 2, 2)
    boosting.Boosting(rows, cut, [one]).fit(4)
    two = Boosted("two", Setting(leaves=4), 2, 2)
    monkeypatch.setattr(boosting, "WRITTEN", 1)
    job = boosting.Boosting(rows, cut, [two, Boosted("other", Setting(leaves=3), 2, 3)])
    job.fit(2)
    job.fit(2, [two])
    assert [t[0].feature for t in two.trees] == [t[0].feature for t in one.trees]
    assert np.allclose([v for t in two.trees for v in t[0].value], [v for t in one.trees for v in t[0].value])
    early = df.filter("block < 2")
    alone = Boosted("alone", Setting(leaves=4), 2)
    boosting.Boosting(boosting.binned(early, cut, "two"), cut, [alone]).fit(4)
    assert np.allclose([v for t in alone.trees for v in t[0].value], [v for t in one.trees for v in t[0].value])


def test_penalty_leaves_and_nulls(spark, table):
    df, *_ = table
    holed = df.selectExpr("id", "IF(id % 5 = 0, NULL, a) AS a", "two")
    cut = boosting.fit_bins(holed, ["a"], 30)
    rows = boosting.binned(holed, cut, "two")
    models = [Boosted(str(k), Setting(leaves=n, least=m, l2=l2), 2) for k, (n, m, l2) in enumerate([(4, 20, 0.0), (4, 20, 50.0), (9, 150, 0.0)])]
    boosting.Boosting(rows, cut, models).fit(1)
    leaves = [sum(x < 0 for x in _reachable(m.trees[0][0])) for m in models]
    assert leaves[0] == 4 and leaves[2] <= 2
    assert max(map(abs, models[1].trees[0][0].value)) < max(map(abs, models[0].trees[0][0].value))


def _reachable(tree):
    out, todo = [], [0]
    while todo:
        node = todo.pop()
        out.append(tree.left[node])
        if tree.left[node] >= 0:
            todo += [tree.left[node], tree.right[node]]
    return out


def test_halving(table):
    df, *_ = table
    cut = boosting.fit_bins(df, ["a", "b", "c"], 30)
    rows = boosting.binned(df, cut, "two", None, "block")
    settings = [Setting(s, 4, 20, l2) for s, l2 in ((0.3, 0.0), (1e-4, 1.0), (0.1, 5.0), (0.2, 0.1))]
    history = boosting.halving_search(rows, cut, settings, (2, 3), [(4, 1), (2, 2), (1, 4)])
    assert [(h["rung"], h["resource"]) for h in history] == [(0, 1)] * 4 + [(1, 2)] * 2 + [(2, 4)]
    first = sorted((h for h in history if h["rung"] == 0), key=lambda h: (-h["score"], h["candidate"]))
    assert [h["candidate"] for h in history if h["rung"] == 1] == [h["candidate"] for h in first[:2]]
