"""Joins. No side is forced to broadcast: Spark broadcasts only a side whose size it has checked."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .schema import drop_any_null


def join_named(
    left: DataFrame, right: DataFrame, keys: Mapping[str, str], how: str = "left", spread_on: Sequence[str] = ()
) -> DataFrame:
    """Equi-join on differently named keys (left name -> right name); the left names stay.

    With ``spread_on`` hot keys of the left side are salted; the right side is then unique per key.
    """
    renamed = right.withColumnsRenamed({r: l for l, r in keys.items()})
    if spread_on:
        return salted_join(left, renamed, list(keys), spread_on, how=how)
    return left.join(renamed, list(keys), how)


def join_complete(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join, then drop rows with a null: unmatched rows and null attributes both go."""
    return drop_any_null(left.join(right, list(keys), "inner"))


def join_variables(frames: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Inner join of many frames; a column that already exists gets ``_{variable}`` appended."""

    def add(left: DataFrame, item: tuple[str, DataFrame]) -> DataFrame:
        name, right = item
        taken = set(left.columns) - set(keys)
        clash = {c: f"{c}_{name}" for c in right.columns if c in taken}
        return left.join(right.withColumnsRenamed(clash), list(keys), "inner")

    items = list(frames.items())
    return reduce(add, items[1:], items[0][1])


def salted_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], spread_on: Sequence[str], salts: int = 8, how: str = "inner"
) -> DataFrame:
    """Equi-join of a fact with hot keys to a side that is unique per key.

    Rows of one key are spread over ``salts`` tasks by a hash of ``spread_on``; the small side is
    repeated once per salt. The hash is a function of the row, so a rerun task repeats itself.
    The repeats come from an unpivot, which Spark's size estimate counts, where it takes an exploded list for one row:
    a side is broadcast only if it is small with its repeats.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the repeated side can only be the right one")
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_on), F.lit(salts)).cast("int"))
    numbers = [F.lit(k).alias(f"_salt{k}") for k in range(salts)]
    repeated = small.select("*", *numbers).unpivot(
        [F.col(f"`{c}`") for c in small.columns], [f"_salt{k}" for k in range(salts)], "_name", "_salt"
    ).drop("_name")  # one row per salt
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def lookup(df: DataFrame, table: DataFrame, column: str, key: str, value: str, alias: str) -> DataFrame:
    """Map a column through a two-column table; unmatched values become null."""
    renamed = table.select(F.col(key).alias(column), F.col(value).alias(alias))
    return df.join(renamed, column, "left")


def lookup_in_list(
    df: DataFrame, table: DataFrame, row_keys: Sequence[str], values: str, key: str, value: str, alias: str
) -> DataFrame:
    """Map each element of a list column through a table, keeping the order."""
    exploded = df.select(*row_keys, F.posexplode(values).alias("_pos", key))
    named = table.select(key, F.col(value).alias("_value"))
    mapped = salted_join(exploded, named, [key], [*row_keys, "_pos"], how="left")
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_value")))
    lists = mapped.groupBy(*row_keys).agg(F.transform(ordered, lambda x: x["_value"]).alias(alias))
    return df.join(lists, list(row_keys), "left")


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row counts of both sides and of their inner join, and whether all three agree.

    Counts per key are multiplied instead of joining rows, so a hot key costs one row per side.
    """
    sides = left.groupBy(*keys).agg(F.count("*").alias("l")).join(
        right.groupBy(*keys).agg(F.count("*").alias("r")), list(keys), "full"
    )
    totals = sides.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("merged_rows"),
    )
    same = (F.col("left_rows") == F.col("right_rows")) & (F.col("left_rows") == F.col("merged_rows"))
    return totals.withColumn("is_match", same)


def neighbour_rows(df: DataFrame, neighbours: DataFrame, chosen: Column, entity: str, list_column: str) -> DataFrame:
    """Rows of every entity in the neighbour lists of the chosen entities."""
    wanted = neighbours.filter(chosen).select(F.explode(list_column).alias(entity)).distinct()
    return df.join(wanted, entity, "left_semi")


def join_lagged_partner(df: DataFrame, partners: DataFrame, series: DataFrame, entity: str, partner: str, date: str,
                        value: str) -> DataFrame:
    """Add the value of each entity's partner at the same date."""
    other = series.select(F.col(entity).alias(partner), date, value)
    paired = df.join(partners, entity, "inner")
    return salted_join(paired, other, [partner, date], [entity])  # a hub is the partner of many
