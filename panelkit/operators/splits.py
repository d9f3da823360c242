"""Train, validation and test splits, sampling and bypass rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.draws import unit_draw
from .joins import salted_join
from .ranking import global_position

# The bypass row of an entity without any case.
SENTINEL = -999.0
SENTINEL_DATE = "1900-01-01"
SENTINEL_STYLE = "NA"
ZERO_ERROR = "Only zeros in training data"


def temporal_holdout(df: DataFrame, train_start: str, train_end: str, test_end: str, date: str = "start_date"):
    """Train ``[start, train_end)`` and test ``[train_end, test_end)``."""
    day = F.col(date)
    a, b, c = (F.lit(x).cast("date") for x in (train_start, train_end, test_end))
    return df.filter((day >= a) & (day < b)), df.filter((day >= b) & (day < c))


def fold_blocks(df: DataFrame, n_splits: int = 4, date: str = "start_date", entity: str = "entity") -> DataFrame:
    """Add ``block``: rows ordered by date then entity, the last ``n_splits`` blocks of n // (n_splits + 1) rows.

    Block 0 holds the rows before them. Fold k tests on block k and trains on all earlier blocks.
    """
    placed = global_position(df, date, [entity], "_row")
    total = df.agg(F.count("*")).scalar()
    size = F.floor(total / F.lit(n_splits + 1))
    past = F.col("_row") - 1 - (total - size * n_splits)
    block = F.when(past < 0, 0).otherwise(F.try_divide(past, size).cast("int") + 1).cast("int")
    return placed.withColumn("block", block).drop("_row")


def expanding_folds(df: DataFrame, n_splits: int = 4, date: str = "start_date", entity: str = "entity") -> DataFrame:
    """Rows of each expanding-window fold with role ``train`` or ``test``."""
    blocks = fold_blocks(df, n_splits, date, entity)
    first = F.greatest(F.col("block"), F.lit(1))
    folds = blocks.withColumn("fold", F.explode(F.sequence(first, F.lit(n_splits))))
    role = F.when(F.col("block") == F.col("fold"), F.lit("test")).otherwise(F.lit("train"))
    return folds.withColumn("role", role).drop("block")


def entity_split(
    df: DataFrame, train: float = 0.6, valid: float = 0.2, seed: int = 42, entity: str = "entity"
) -> DataFrame:
    """Add ``split`` by entity: the train and valid counts are rounded down, the rest is test."""
    hashed = df.select(entity).distinct().withColumn("_h", unit_draw(seed, entity))
    placed = global_position(hashed, "_h", [entity], "_row")
    total = hashed.agg(F.count("*")).scalar()
    n_train, n_valid = F.floor(total * F.lit(train)), F.floor(total * F.lit(valid))
    name = F.when(F.col("_row") <= n_train, "train").when(F.col("_row") <= n_train + n_valid, "valid").otherwise("test")
    return df.join(placed.select(entity, name.alias("split")), entity)


def hashed_sample(df: DataFrame, fraction: float, on: Sequence[str], seed: int = 42) -> DataFrame:
    """Keep about ``fraction`` of the rows; a rerun keeps the same ones."""
    return df.filter(unit_draw(seed, *on) <= F.lit(fraction))


def sample_rows(df: DataFrame, n: int, on: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` random rows, those with the lowest draw; a rerun keeps the same ones. Tasks send their ``n`` lowest."""
    draw = unit_draw(seed, *on)
    return df.withColumn("_draw", draw).orderBy("_draw", *on).limit(n).drop("_draw")


def evaluation_cut(panel: DataFrame, horizon: int, entity: str = "entity", date: str = "start_date") -> DataFrame:
    """Mark the last ``horizon`` steps of every series as ``truth`` and the rest as ``history``."""
    back = F.row_number().over(W.partitionBy(entity).orderBy(F.col(date).desc()))
    return panel.withColumn("part", F.when(back <= horizon, F.lit("truth")).otherwise(F.lit("history")))


def zero_entities(df: DataFrame, target: str = "target", entity: str = "entity") -> DataFrame:
    return df.groupBy(entity).agg(F.sum(target).alias("_sum")).filter(F.col("_sum") == 0).select(entity)


def drop_zero_entities(df: DataFrame, train: DataFrame, target: str = "target", entity: str = "entity") -> DataFrame:
    """Rows of the entities with a non-zero training target."""
    return salted_join(df, zero_entities(train, target, entity), [entity], df.columns, how="left_anti")


def bypass_rows(entities: DataFrame, entity: str = "entity", classes: int = 2) -> DataFrame:
    """One result row with sentinels per entity that is not fitted."""
    return entities.select(
        F.lit(SENTINEL).alias("predictions"),
        F.lit(SENTINEL).alias("ground_truth"),
        F.lit(SENTINEL_DATE).cast("date").alias("date"),
        F.col(entity),
        F.lit(SENTINEL_STYLE).alias("cat_style"),
        F.lit(ZERO_ERROR).alias("error"),
        F.array_repeat(F.lit(SENTINEL), classes).alias("probabilities"),
    )
