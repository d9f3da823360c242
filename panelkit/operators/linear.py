"""Least-squares models from summed cross products.

Each task reduces its rows to one small matrix per key, so a key with a third of all rows costs no
more than any other, and one pass over the data serves every subset of features and every label.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import cut_lineage

_FLUSH = 256


def cross_products(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Sum of outer products of ``[1, columns]`` per key, as one flat list."""
    names, by = list(columns), list(keys)
    size = len(names) + 1

    def partial(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(by, sort=False) if by else [((), pdf)]
            for key, rows in groups:
                m = np.column_stack([np.ones(len(rows)), rows[names].to_numpy(dtype="float64")])
                key = key if isinstance(key, tuple) else (key,)
                held[key] = held.get(key, 0.0) + m.T @ m
            if len(held) > _FLUSH:
                yield frame(held)
                held = {}
        if held:
            yield frame(held)

    def frame(held: dict[tuple, np.ndarray]) -> pd.DataFrame:
        out = pd.DataFrame(list(held), columns=by) if by else pd.DataFrame(index=range(len(held)))
        out["g"] = [g.ravel() for g in held.values()]
        return out

    schema = T.StructType([df.schema[k] for k in by] + [T.StructField("g", T.ArrayType(T.DoubleType()))])
    picked = df.select(*by, *[F.col(c).cast("double").alias(c) for c in names])
    cells = picked.mapInPandas(partial, schema).select(*by, F.posexplode("g").alias("pos", "v"))
    summed = cells.groupBy(*by, "pos").agg(F.sum("v").alias("v"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"])
    return summed.groupBy(*by).agg(whole.alias("g")).filter(F.size("g") == size * size)


def solve(g: np.ndarray, features: Sequence[int], labels: Sequence[int], alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Ridge coefficients (features x labels) and intercepts from a matrix of cross products."""
    n = g[0, 0]
    sx, sy = g[0, features], g[0, labels]
    xx = g[np.ix_(features, features)] - np.outer(sx, sx) / n
    xy = g[np.ix_(features, labels)] - np.outer(sx, sy) / n
    coef = np.linalg.lstsq(xx + alpha * np.eye(len(features)), xy, rcond=None)[0]
    return coef, sy / n - (sx / n) @ coef


def grouped_ridge(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, alpha: float = 1.0) -> DataFrame:
    """One ridge model per key: coefficients, intercept, rows and residual deviation."""
    by, k = list(keys), len(features)

    def fit(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for flat in pdf["g"]:
                g = np.asarray(flat).reshape(k + 2, k + 2)
                coef, intercept = solve(g, list(range(1, k + 1)), [k + 1], alpha)
                w = np.concatenate([intercept, coef[:, 0]])
                m, xy = g[: k + 1, : k + 1], g[: k + 1, k + 1]
                sse = max(g[k + 1, k + 1] - 2 * w @ xy + w @ m @ w, 0.0)
                rows.append((coef[:, 0], float(intercept[0]), int(g[0, 0]), float(np.sqrt(sse / g[0, 0]))))
            out = pdf[by].copy()
            out[["coef", "intercept", "n", "sigma"]] = pd.DataFrame(rows, index=out.index)
            yield out

    schema = T.StructType(
        [df.schema[c] for c in by]
        + [
            T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("intercept", T.DoubleType()),
            T.StructField("n", T.LongType()), T.StructField("sigma", T.DoubleType()),
        ]
    )
    return cross_products(df, [*features, label], by).mapInPandas(fit, schema)


def predict_linear(features: Sequence[str], coef: str = "coef", intercept: str = "intercept") -> Column:
    """Linear predictor of a row that carries its model."""
    out = F.col(intercept)
    for i, name in enumerate(features):
        out = out + F.col(name).cast("double") * F.get(F.col(coef), F.lit(i))
    return out


def local_ridge_classes(
    df: DataFrame, features: Sequence[str], style: str, alpha: float = 1.0, entity: str = "entity",
    date: str = "start_date", label: str = "label", split: str = "split",
) -> DataFrame:
    """One ridge classifier per entity, fitted on its ``train`` rows and applied to its ``test`` rows.

    Each class is a target of +1 or -1 and the largest score wins. A group is one entity's rows on
    the calendar. A failed fit gives one sentinel row with the message instead of failing the job.
    """
    names = list(features)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf[entity].iloc[0]
        try:
            train, test = pdf[pdf[split] == "train"], pdf[pdf[split] == "test"]
            classes = np.unique(train[label])
            if len(classes) < 2:
                raise ValueError(f"a classifier needs two classes, the training rows have {len(classes)}")
            m = np.column_stack([np.ones(len(train)), train[names], np.where(train[label].to_numpy()[:, None] == classes, 1.0, -1.0)])
            k = len(names)
            coef, intercept = solve(m.T @ m, list(range(1, k + 1)), list(range(k + 1, m.shape[1])), alpha)
            best = classes[np.argmax(test[names].to_numpy() @ coef + intercept, axis=1)]
            return pd.DataFrame({
                "predictions": best, "ground_truth": test[label], "date": test[date], entity: one, "cat_style": style, "error": "NONE",
            })
        except (ValueError, np.linalg.LinAlgError) as err:
            import datetime

            return pd.DataFrame({
                "predictions": [-999.0], "ground_truth": [-999.0], "date": [datetime.date(1900, 1, 1)], entity: [one],
                "cat_style": ["NA"], "error": [str(err)],
            })

    schema = T.StructType([
        T.StructField("predictions", T.DoubleType()), T.StructField("ground_truth", T.DoubleType()),
        T.StructField("date", T.DateType()), df.schema[entity], T.StructField("cat_style", T.StringType()),
        T.StructField("error", T.StringType()),
    ])
    picked = df.select(entity, date, split, F.col(label).cast("double").alias(label), *[F.col(c).cast("double").alias(c) for c in names])
    return picked.groupBy(entity).applyInPandas(run, schema)


def local_ridge(
    df: DataFrame, features: Sequence[str], alpha: float = 1.0, entity: str = "entity", date: str = "start_date",
    label: str = "label", split: str = "split",
) -> DataFrame:
    """One ridge regression per entity; fitted values and predictions for all its rows."""
    names = list(features)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        train = pdf[pdf[split] == "train"]
        out = pdf[[entity, date, split, label]].copy()
        if not len(train):
            out["prediction"] = np.nan
            return out
        m = np.column_stack([np.ones(len(train)), train[names], train[label]])
        k = len(names)
        coef, intercept = solve(m.T @ m, list(range(1, k + 1)), [k + 1], alpha)
        out["prediction"] = pdf[names].to_numpy() @ coef[:, 0] + intercept[0]
        return out

    schema = T.StructType([
        df.schema[entity], df.schema[date], df.schema[split], T.StructField(label, T.DoubleType()),
        T.StructField("prediction", T.DoubleType()),
    ])
    picked = df.select(entity, date, split, F.col(label).cast("double").alias(label), *[F.col(c).cast("double").alias(c) for c in names])
    return picked.groupBy(entity).applyInPandas(run, schema)


def lag_regression(panel: DataFrame, target: str, lag: str, entity: str = "entity") -> DataFrame:
    """Ordinary least squares of the target on one lag per entity, from sums; null without variation."""
    x, y = F.col(lag).cast("double"), F.col(target).cast("double")
    s = panel.filter(x.isNotNull() & y.isNotNull()).groupBy(entity).agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"),
        F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"),
    )
    dx = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    dxy = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    dy = F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    slope = F.try_divide(dxy, dx)
    with_slope = s.withColumns({"slope": slope, "_dx": dx, "_dxy": dxy, "_dy": dy})
    sse = (F.col("_dy") - F.col("slope") * F.col("_dxy")) / F.col("n")
    return with_slope.select(
        entity, "n", "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"),
        F.try_divide(F.try_divide(sse, (F.col("n") - 2).cast("double")) * F.col("n"), F.col("_dx")).alias("slope_var"),
        (F.try_divide(sse, (F.col("n") - 2).cast("double")) * F.try_divide(F.col("sxx"), F.col("_dx"))).alias("intercept_var"),
    )


def shrink(models: DataFrame, names: Sequence[str] = ("slope", "intercept"), entity: str = "entity") -> DataFrame:
    """Pull each entity's estimate to the mean of all by ``between / (between + own variance)``.

    The between-entity variance is the variance of the estimates less the mean of their own
    variances, not below 0.
    """
    known = models.filter(F.col(names[0]).isNotNull() & F.col(f"{names[0]}_var").isNotNull())
    out = known
    for name in names:
        mean = known.agg(F.avg(name)).scalar()
        spread = known.agg(F.var_pop(name)).scalar()
        noise = known.agg(F.avg(f"{name}_var")).scalar()
        between = F.greatest(spread - noise, F.lit(0.0))
        weight = F.coalesce(F.try_divide(between, between + F.col(f"{name}_var")), F.lit(1.0))
        out = out.withColumn(f"{name}_shrunk", mean + weight * (F.col(name) - mean))
    return out.select(entity, "n", *names, *[f"{name}_shrunk" for name in names])


def pool_correlated(panel: DataFrame, target: str, lag: str, entity: str = "entity", rounds: int = 30) -> DataFrame:
    """Intercept and slope per entity, pooled with a full 2 x 2 covariance between entities: ``entity, n, intercept, slope``.

    The model is ``target = a + b * lag + noise`` with (a, b) drawn jointly normal for each entity and one noise for all. Its
    covariance, mean and noise are found by EM from six sums per entity, which are all that the rows leave behind; a
    round is one aggregate over entities that returns seven numbers. Entities without variation of the lag are pooled too.
    """
    x, y = F.col(lag).cast("double"), F.col(target).cast("double")
    sums = cut_lineage(panel.filter(x.isNotNull() & y.isNotNull()).groupBy(entity).agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"),
        F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"),
    ), "sums")
    state = pooled_start(sums)
    for _ in range(rounds):
        state = pooled_round(sums, state)
    return pooled_estimates(sums, state).select(entity, "n", F.col("a").alias("intercept"), F.col("b").alias("slope"))


def pooled_start(sums: DataFrame) -> dict[str, float]:
    """One line through all rows, unit covariance."""
    t = sums.agg(*[F.sum(c).cast("double").alias(c) for c in ("n", "sx", "sy", "sxx", "sxy", "syy")]).first()
    dx = t["sxx"] - t["sx"] ** 2 / t["n"]
    slope = (t["sxy"] - t["sx"] * t["sy"] / t["n"]) / dx if dx else 0.0
    base = (t["sy"] - slope * t["sx"]) / t["n"]
    noise = (t["syy"] - base * t["sy"] - slope * t["sxy"]) / t["n"]
    return {"ma": base, "mb": slope, "vaa": 1.0, "vab": 0.0, "vbb": 1.0, "noise": max(noise, 1e-12)}


def pooled_estimates(sums: DataFrame, state: dict[str, float]) -> DataFrame:
    """``a, b`` of each entity given the state, and the covariance ``paa, pab, pbb`` that is left of them."""
    s = state
    det = max(s["vaa"] * s["vbb"] - s["vab"] ** 2, 1e-300)
    iaa, iab, ibb = s["vbb"] / det, -s["vab"] / det, s["vaa"] / det
    qaa, qab, qbb = F.col("n") / s["noise"] + iaa, F.col("sx") / s["noise"] + iab, F.col("sxx") / s["noise"] + ibb
    ra = F.col("sy") / s["noise"] + (iaa * s["ma"] + iab * s["mb"])
    rb = F.col("sxy") / s["noise"] + (iab * s["ma"] + ibb * s["mb"])
    inverse = sums.withColumns({"_d": qaa * qbb - qab * qab, "_aa": qaa, "_ab": qab, "_bb": qbb, "_ra": ra, "_rb": rb})
    held = inverse.withColumns({"paa": F.col("_bb") / F.col("_d"), "pab": -F.col("_ab") / F.col("_d"), "pbb": F.col("_aa") / F.col("_d")})
    a = F.col("paa") * F.col("_ra") + F.col("pab") * F.col("_rb")
    b = F.col("pab") * F.col("_ra") + F.col("pbb") * F.col("_rb")
    return held.withColumns({"a": a, "b": b}).drop("_d", "_aa", "_ab", "_bb", "_ra", "_rb")


def pooled_round(sums: DataFrame, state: dict[str, float]) -> dict[str, float]:
    """One round of EM."""
    e = pooled_estimates(sums, state)
    a, b = F.col("a"), F.col("b")
    left = F.col("syy") - 2 * a * F.col("sy") - 2 * b * F.col("sxy") + a * a * F.col("n") + 2 * a * b * F.col("sx") + b * b * F.col("sxx")
    spare = F.col("n") * F.col("paa") + 2 * F.col("sx") * F.col("pab") + F.col("sxx") * F.col("pbb")
    t = e.agg(
        F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.avg(F.col("paa") + a * a).alias("aa"), F.avg(F.col("pab") + a * b).alias("ab"),
        F.avg(F.col("pbb") + b * b).alias("bb"), F.sum(left + spare).alias("sse"), F.sum("n").alias("n")).first()
    return {
        "ma": t["ma"], "mb": t["mb"], "vaa": t["aa"] - t["ma"] ** 2, "vab": t["ab"] - t["ma"] * t["mb"], "vbb": t["bb"] - t["mb"] ** 2,
        "noise": max(t["sse"] / t["n"], 1e-12),
    }
