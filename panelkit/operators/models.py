"""Model jobs on MLlib."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .boosting import Setting, boosted_classifier
from .metrics import class_weights
from .ranking import exact_quantiles


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def training_rows(df: DataFrame, features: Sequence[str], *columns: str) -> DataFrame:
    """Feature vectors written once, as every fit passes over them many times."""
    return cut_lineage(assemble(df, features).select("features", *columns))


def robust_scale(train: DataFrame, others: Sequence[DataFrame], columns: Sequence[str]) -> list[DataFrame]:
    """Center on the median and divide by the quartile range, both from the training rows.

    A column without spread is only centered. Returns the training frame and the others, scaled.
    """
    long = train.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "x")
    fitted = exact_quantiles(long, ["column"], "x", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, large=True)
    table = fitted.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("q1", "q2", "q3"))))).scalar()
    done = []
    for df in (train, *others):
        held = df.withColumn("_fit", table)
        scaled = {}
        for c in columns:
            q = F.try_element_at("_fit", F.lit(c))
            width = q["q3"] - q["q1"]
            scaled[c] = (F.col(c) - q["q2"]) / F.when(width == 0, F.lit(1.0)).otherwise(width)
        done.append(held.withColumns(scaled).drop("_fit"))
    return done


def tree_classifier(
    train: DataFrame, test: DataFrame, features: Sequence[str], classes: int, label: str = "label", iterations: int = 10,
    depth: int = 4, seed: int = 42,
) -> DataFrame:
    """Boosted trees with balanced class weights: MLlib's for two classes, histogram boosting with softmax for more."""
    balanced = class_weights(train, label)
    if classes > 2:
        return boosted_classifier(balanced, test, features, classes, label, "weight", iterations, Setting(leaves=2**depth, depth=depth))
    weighted = training_rows(balanced, features, label, "weight")
    model = GBTClassifier(maxIter=iterations, labelCol=label, weightCol="weight", maxDepth=depth, seed=seed).fit(weighted)
    scored = model.transform(assemble(test, features))
    return scored.withColumn("probabilities", vector_to_array("probability")).drop("features", "rawPrediction", "probability")


def ridge_classifier(
    train: DataFrame, test: DataFrame, features: Sequence[str], classes: int, label: str = "label", alpha: float = 1.0
) -> DataFrame:
    """Least squares with L2 on +1 / -1 per class; the class with the largest score wins.

    MLlib divides the penalty by the deviation of the label, so it is multiplied in beforehand.
    """
    packed = training_rows(train, features, label)
    counts = {int(r[label]): r["count"] for r in packed.groupBy(label).count().collect()}  # one row per class
    n = sum(counts.values())
    scored = assemble(test, features)
    for k in range(classes):
        side = packed.withColumn("_y", F.when(F.col(label) == k, 1.0).otherwise(-1.0))
        share = counts.get(k, 0) / n
        deviation = 2.0 * (share * (1.0 - share)) ** 0.5
        fit = LinearRegression(
            labelCol="_y", regParam=alpha / n * deviation, elasticNetParam=0.0, standardization=False, solver="normal",
            predictionCol=f"score_{k}",
        ).fit(side)
        scored = fit.transform(scored)
    scores = F.array(*[F.col(f"score_{k}") for k in range(classes)])
    best = F.array_position(scores, F.array_max(scores)) - 1
    return scored.withColumn("prediction", best.cast("double")).drop("features")


def poisson_regression(train: DataFrame, test: DataFrame, features: Sequence[str], label: str = "label", l2: float = 0.01) -> DataFrame:
    fit = GeneralizedLinearRegression(family="poisson", link="log", labelCol=label, regParam=l2, maxIter=25).fit(
        training_rows(train, features, label)
    )
    return fit.transform(assemble(test, features)).drop("features")


def presence_model(rows: DataFrame, features: Sequence[str], label: str = "presence") -> DataFrame:
    """Probability of presence from histogram features."""
    fit = LogisticRegression(labelCol=label, regParam=0.01, maxIter=50).fit(training_rows(rows, features, label))
    out = fit.transform(assemble(rows, features))
    return out.withColumn("probability", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction")


def presence_out_of_block(rows: DataFrame, features: Sequence[str], block: Sequence[str], folds: int = 4, label: str = "presence") -> DataFrame:
    """Probability of presence by a model that saw no row of the same block, such as a place and year, with its ``fold``.

    Blocks go to folds by hash. A fold is scored by the rows of all others, so ``rows`` must have blocks in two folds at least.
    """
    fold = F.pmod(F.xxhash64(*block), F.lit(folds)).cast("int")
    placed = cut_lineage(assemble(rows, features).withColumn("fold", fold), "folds")
    scored = []
    for k in [r["fold"] for r in placed.select("fold").distinct().orderBy("fold").collect()]:  # at most ``folds`` rows
        fit = LogisticRegression(labelCol=label, regParam=0.01, maxIter=50).fit(placed.filter(F.col("fold") != k))
        scored.append(fit.transform(placed.filter(F.col("fold") == k)))
    out = reduce(lambda a, b: a.unionByName(b), scored)
    return out.withColumn("probability", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "prediction")


def flat_clusters(series: DataFrame, values: str, k: int = 10, entity: str = "entity", seed: int = 42) -> DataFrame:
    """``k`` clusters of the series vectors."""
    packed = cut_lineage(
        series.select(entity, array_to_vector(F.transform(values, lambda x: x.cast("double"))).alias("features"))
    )
    return KMeans(k=k, seed=seed, maxIter=20).fit(packed).transform(packed).select(entity, F.col("prediction").alias("cluster"))


def cluster_tree(series: DataFrame, values: str, levels: int = 3, rounds: int = 4, entity: str = "entity") -> DataFrame:
    """Binary tree of clusters as rows (node, parent, level, entity).

    All nodes of a level are split in two together. The first centers are the means of the
    entities below and above the node's mean level; then ``rounds`` times each entity moves to the
    nearer center. The children of node n are 2n and 2n + 1. The broadcast center tables hold one row
    of two calendar-long lists per node, so at most ``2 ** levels`` rows.
    """
    vectors = series.select(entity, F.transform(values, lambda x: x.cast("double")).alias("v"))
    members = cut_lineage(vectors.withColumn("node", F.lit(1).cast("long")))
    out = [members.select("node", F.lit(None).cast("long").alias("parent"), F.lit(0).alias("level"), entity)]
    for level in range(1, levels + 1):
        size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
        middle = members.groupBy("node").agg(F.avg(size).alias("_mid"))
        sided = members.join(F.broadcast(middle), "node").withColumn("side", F.when(size > F.col("_mid"), 1).otherwise(0)).drop("_mid")
        for _ in range(rounds):
            centers = _centers(sided)
            both = members.join(F.broadcast(centers), "node")
            near = [F.aggregate(F.zip_with("v", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x) for c in ("c0", "c1")]
            sided = both.withColumn("side", F.when(F.col("c1").isNotNull() & (near[1] < near[0]), 1).otherwise(0)).drop("c0", "c1")
        members = cut_lineage(sided.select(entity, "v", (F.col("node") * 2 + F.col("side")).alias("node")))
        out.append(members.select("node", F.floor(F.col("node") / 2).alias("parent"), F.lit(level).alias("level"), entity))
    return reduce(lambda a, b: a.unionByName(b), out)


def _centers(sided: DataFrame) -> DataFrame:
    """Mean vector of both sides of every node; a missing side is null."""
    cells = sided.select("node", "side", F.posexplode("v").alias("pos", "x"))
    means = cells.groupBy("node", "side", "pos").agg(F.avg("x").alias("m"))
    vectors = means.groupBy("node", "side").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("c")
    )
    return vectors.groupBy("node").agg(
        F.coalesce(F.max(F.when(F.col("side") == 0, F.col("c"))), F.max("c")).alias("c0"),
        F.max(F.when(F.col("side") == 1, F.col("c"))).alias("c1"),
    )
