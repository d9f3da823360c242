"""Parameter grids, feature sweeps and searches.

A sweep reads the training rows once for the cross products of the widest frame and the scoring
rows once for all models together.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .boosting import Setting
from .linear import cross_products, solve
from .metrics import class_report, report_averages


def grid_axes(options: dict) -> dict[str, list]:
    """The list-valued options with more than one value."""
    return {k: v for k, v in options.items() if isinstance(v, list) and len(v) > 1}


def grid_points(options: dict) -> list[dict]:
    """Product of the axes, in the order of their names."""
    axes = dict(sorted(grid_axes(options).items()))
    return [dict(zip(axes, values)) for values in itertools.product(*axes.values())]


def explode_grid(df: DataFrame, options: dict) -> DataFrame:
    """Every row once per grid point, one exploded column per axis."""
    for name, values in sorted(grid_axes(options).items()):
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


@dataclass(frozen=True)
class Model:
    """A ridge classifier: its features, its label column and the classes it knows."""

    name: str
    features: tuple[str, ...]
    label: str
    fold: int = 0
    alpha: float | None = None


class RidgeSweep:
    """Fits many ridge classifiers on subsets of the columns of one frame."""

    def __init__(self, frame: DataFrame, features: Sequence[str], labels: dict[str, int], block: str | None = None,
                 alpha: float = 1.0):
        """``labels`` maps label columns, holding classes 0, 1, .., to their number of classes."""
        self.features, self.labels, self.alpha = list(features), dict(labels), alpha
        self._indicator = {(c, k): f"_{c}_{k}" for c, n in labels.items() for k in range(n)}
        coded = frame.withColumns(
            {name: F.when(F.col(c) == k, 1.0).otherwise(-1.0) for (c, k), name in self._indicator.items()}
        )
        self._columns = [*self.features, *self._indicator.values()]
        keys = [block] if block else []
        grams = cross_products(coded, self._columns, keys).collect()  # one small matrix per block
        size = len(self._columns) + 1
        self._gram = {(r[block] if block else 0): np.asarray(r["g"]).reshape(size, size) for r in grams}
        self._at = {c: i + 1 for i, c in enumerate(self._columns)}

    def fit(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients over all features (0 where unused) and intercepts; fold k uses the blocks before k."""
        g = sum(m for b, m in self._gram.items() if model.fold == 0 or b < model.fold)
        used = [self._at[c] for c in model.features]
        outputs = [self._at[self._indicator[model.label, k]] for k in range(self.labels[model.label])]
        coef, intercept = solve(g, used, outputs, self.alpha if model.alpha is None else model.alpha)
        full = np.zeros((len(self.features), len(outputs)))
        full[[i - 1 for i in used]] = coef
        return full, intercept

    def confusion(self, rows: DataFrame, models: Sequence[Model], block: str | None = None) -> DataFrame:
        """Counts per (model, truth, predicted), all models scored in one pass over the rows."""
        fitted = [(m.name, m.label, m.fold, *self.fit(m)) for m in models]
        features, labels = self.features, list(self.labels)

        def score(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts: dict[tuple, int] = {}
            for pdf in batches:
                x_all = pdf[features].to_numpy(dtype="float64")
                blocks = pdf[block].to_numpy() if block else None
                for name, label, fold, coef, intercept in fitted:
                    rows_in = slice(None) if blocks is None else blocks == fold
                    pred = np.argmax(x_all[rows_in] @ coef + intercept, axis=1)
                    truth = pdf[label].to_numpy()[rows_in].astype(int)
                    for (a, b), n in pd.Series(1, index=[truth, pred]).groupby(level=[0, 1]).sum().items():
                        counts[name, int(a), int(b)] = counts.get((name, int(a), int(b)), 0) + int(n)
            if counts:
                yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["model", "truth", "predicted", "n"])

        extra = [block] if block else []
        picked = rows.select(*[F.col(c).cast("double").alias(c) for c in features], *[F.col(c).cast("int").alias(c) for c in labels], *extra)
        partial = picked.mapInPandas(score, "model string, truth int, predicted int, n long")
        return partial.groupBy("model", "truth", "predicted").agg(F.sum("n").alias("n"))

    def scores(self, rows: DataFrame, models: Sequence[Model], block: str | None = None) -> DataFrame:
        """Report averages per model."""
        return report_averages(class_report(self.confusion(rows, models, block), ["model"]), ["model"])


def forward_selection(
    sweep: RidgeSweep, rows: DataFrame, label: str, folds: Sequence[int], block: str = "block", tol: float = 0.001,
    most: int | None = None,
) -> list[tuple[str, float]]:
    """Add the feature that raises the mean macro F1 over the folds most, until it gains less than ``tol``.

    Each step scores all candidates and folds in one job that returns one row per candidate.
    """
    chosen: list[tuple[str, float]] = []
    best = float("-inf")
    limit = most or len(sweep.features)
    while len(chosen) < limit:
        have = tuple(name for name, _ in chosen)
        left = [c for c in sweep.features if c not in have]
        models = [Model(f"{c}|{k}", (*have, c), label, k) for c in left for k in folds]
        scored = sweep.scores(rows, models, block).select(F.split("model", r"\|")[0].alias("feature"), "f1_macro")
        means = scored.groupBy("feature").agg(F.avg("f1_macro").alias("score")).orderBy(F.col("score").desc(), "feature")
        top = means.limit(1).collect()
        if not top or top[0]["score"] - best < tol:
            break
        best = top[0]["score"]
        chosen.append((top[0]["feature"], best))
    return chosen


def halving_schedule(candidates: int, start: int, most: int, factor: int = 2) -> list[tuple[int, int]]:
    """(candidates, resource) per rung."""
    out, n, r = [], candidates, start
    while True:
        out.append((n, r))
        if n <= 1 or r * factor > most:
            return out
        n, r = max(1, -(-n // factor)), r * factor


def random_candidates(n: int, seed: int = 42) -> list[Setting]:
    """Learning rate log-uniform in 0.0001..0.1, penalty uniform in 0..2, leaves in 2..99, rows of a leaf in 20..249 (fixed ranges)."""
    rng = random.Random(seed)
    return [Setting(10 ** rng.uniform(-4, -1), rng.randint(2, 99), rng.randint(20, 249), rng.uniform(0, 2)) for _ in range(n)]

