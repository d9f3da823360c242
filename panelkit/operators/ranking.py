"""Ranks, codes and quantiles that never bring a whole table or an unbounded group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .joins import salted_join


def ordinal_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """1-based rank without ties inside groups bounded by the calendar."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def global_position(df: DataFrame, first: str, rest: Sequence[str] = (), name: str = "position") -> DataFrame:
    """1-based position over the whole table ordered by ``first`` then ``rest``, nulls first, columns of any type.

    Spark cuts the table into ranges of even size by a sample of all order columns, whatever their values look
    like; rows are numbered inside a range and shifted by the rows of earlier ranges. The ranges are written once, so
    that a rerun task finds the same. The only window without a partition runs over one row per range.
    """
    ranged = df.repartitionByRange(first, *rest).withColumn("_b", F.spark_partition_id())
    ranged = cut_lineage(ranged, "ranges")
    sizes = ranged.groupBy("_b").agg(F.count("*").alias("_n"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_b").orderBy(first, *rest))
    return ranged.join(starts, "_b").withColumn(name, F.col("_start") + inside).drop("_b", "_start")


def dense_code(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Dense rank of an id over the table: distinct ids are ranked, then joined back, rows of hot ids spread."""
    ids = global_position(df.select(column).filter(F.col(column).isNotNull()).distinct(), column, name=name)
    return salted_join(df, ids, [column], df.columns, how="left")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    weight: str | None = None,
    large: bool = False,
) -> DataFrame:
    """Exact quantiles of groups of any size.

    Without a weight, quantiles are interpolated between neighbouring ranks. With one, the
    quantile is the first value whose running weight reaches the share of the total.

    ``large`` tells how the groups are handled: each ordered in one task, which suits many groups of bounded size, or
    each spread over many tasks, which suits few groups of any size. Without ``keys`` the table is one large group.
    """
    keys, weighted = list(keys), weight is not None
    picked = [F.col(value).cast("double").alias("_v"), *([F.col(weight).alias("_w")] if weighted else [])]
    known = df.filter(F.col(value).isNotNull()).select(*keys, *picked)
    if large or not keys:
        return _spread_quantiles(known, keys, probs, weighted)
    return _task_quantiles(known, keys, probs, weighted)


def _task_quantiles(known: DataFrame, keys: list[str], probs: dict[str, float], weighted: bool) -> DataFrame:
    if not weighted:
        grouped = known.groupBy(*keys).agg(F.percentile("_v", list(probs.values())).alias("_q"))
        return grouped.select(*keys, *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(probs)])
    w = W.partitionBy(*keys)
    running = F.sum("_w").over(w.orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    merged = known.groupBy(*keys, "_v").agg(F.sum("_w").alias("_w"))
    placed = merged.withColumns({"_upto": running, "_total": F.sum("_w").over(w)})
    reached = {name: F.col("_upto") >= F.col("_total").cast("double") * F.lit(p) for name, p in probs.items()}
    return placed.groupBy(*keys).agg(*[F.min(F.when(at, F.col("_v"))).alias(name) for name, at in reached.items()])


def _spread_quantiles(
    known: DataFrame, keys: list[str], probs: dict[str, float], weighted: bool, buckets: int = 1024
) -> DataFrame:
    """Quantiles of large groups.

    Equal values are merged first. Weights are then summed per equal-width bucket of the value
    range to find the bucket that holds each quantile; that bucket is split once more between its
    own least and greatest value, and only the values of the inner bucket are ordered. A group with
    a third of all rows, or values crowded beside far outliers, is spread over many tasks.
    """
    amount = F.sum("_w") if weighted else F.count("*")
    merged = cut_lineage(known.groupBy(*keys, "_v").agg(amount.alias("_w")), "values")
    ends = merged.agg(F.min("_v"), F.max("_v")).first()
    low, high = (F.lit(x).cast("double") for x in ends)
    merged = merged.withColumn("_b", _bucket(low, high, buckets))

    outer = merged.groupBy(*keys, "_b").agg(
        F.sum("_w").alias("_bw"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    upto = F.sum("_bw").over(whole.orderBy("_b").rowsBetween(W.unboundedPreceding, 0))
    placed = outer.withColumns({"_before": upto - F.col("_bw"), "_total": F.sum("_bw").over(whole)})
    aims = F.flatten(F.array(*[_targets(name, p, weighted) for name, p in probs.items()]))
    wanted = placed.withColumn("_t", F.explode(aims)).select("*", "_t.*").drop("_t").filter(
        _holds(F.col("_before"), F.col("_before") + F.col("_bw"), weighted)
    )

    ranges = wanted.select(*keys, "_b", "_lo", "_hi").distinct()
    near = salted_join(merged, ranges, [*keys, "_b"], ["_v"], salts=16).withColumn(
        "_c", _bucket(F.col("_lo"), F.col("_hi"), buckets)
    )
    inner = near.groupBy(*keys, "_b", "_c").agg(F.sum("_w").alias("_cw"))
    within = F.sum("_cw").over(W.partitionBy(*keys, "_b").orderBy("_c").rowsBetween(W.unboundedPreceding, 0))
    inside = (
        wanted.join(inner.withColumn("_in", within - F.col("_cw")), [*keys, "_b"])
        .withColumn("_from", F.col("_before") + F.col("_in"))
        .filter(_holds(F.col("_from"), F.col("_from") + F.col("_cw"), weighted))
        .select(*keys, "_b", "_c", "_from", "_name", "_side", "_aim", "_frac")
    )
    last = W.partitionBy(*keys, "_b", "_c", "_name", "_side").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    lined = near.join(inside, [*keys, "_b", "_c"]).withColumn("_upto", F.col("_from") + F.sum("_w").over(last))
    hit = lined.filter(_holds(F.col("_upto") - F.col("_w"), F.col("_upto"), weighted))

    def at(name: str, side: int, column: str = "_v") -> Column:
        return F.max(F.when((F.col("_name") == name) & (F.col("_side") == side), F.col(column)))

    out = []
    for name in probs:
        if weighted:
            out.append(at(name, 0).alias(name))
        else:
            out.append((at(name, 0) + (at(name, 1) - at(name, 0)) * at(name, 0, "_frac")).alias(name))
    return hit.groupBy(*keys).agg(*out)


def _bucket(low: Column, high: Column, buckets: int) -> Column:
    share = F.coalesce(F.try_divide(F.col("_v") - low, high - low), F.lit(0.0))
    return F.least(F.floor(share * buckets), F.lit(buckets - 1))


def _targets(name: str, p: float, weighted: bool) -> Column:
    """Rank (or running weight) to look for, one entry per neighbouring rank."""
    if weighted:
        aims = [(0, F.col("_total").cast("double") * F.lit(p), F.lit(0.0))]
    else:
        at = (F.col("_total") - 1).cast("double") * F.lit(p)
        frac = at - F.floor(at)
        aims = [(0, F.floor(at).cast("double"), frac), (1, F.ceil(at).cast("double"), frac)]
    return F.array(
        *[
            F.struct(F.lit(name).alias("_name"), F.lit(side).alias("_side"), aim.alias("_aim"), frac.alias("_frac"))
            for side, aim, frac in aims
        ]
    )


def _holds(before: Column, upto: Column, weighted: bool) -> Column:
    aim = F.col("_aim")
    return ((before < aim) & (aim <= upto)) if weighted else ((before <= aim) & (aim < upto))


def quantile_cut_ranks(df: DataFrame, rank: str, probs: Sequence[float], labels: Sequence[str], name: str) -> DataFrame:
    """Label ranks by global quantiles of the ranks, bins closed on the right.

    Ranks are small whole numbers, so they are counted per value and the quantiles taken from the
    counts; the break list is one scalar.
    """
    counts = df.groupBy(rank).agg(F.count("*").alias("_n"))
    breaks = counts.agg(F.percentile(rank, list(probs), F.col("_n"))).scalar()
    label = F.lit(labels[-1])
    for i in reversed(range(len(probs))):
        label = F.when(F.col(rank) <= F.get(breaks, F.lit(i)), F.lit(labels[i])).otherwise(label)
    return df.withColumn(name, label)
