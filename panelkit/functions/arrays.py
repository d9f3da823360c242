"""Array and struct column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .text import LAND_COVER_BANDS, band_pairs, decimals_in


def list_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def list_mean(values: Column) -> Column:
    return F.try_divide(list_sum(values), F.size(values).cast("double"))


def head(values: Column, n: int) -> Column:
    return F.slice(values, 1, n)


def named_fields(values: Column, names: Sequence[str]) -> Column:
    """List to struct by position; missing positions become null."""
    return F.struct(*[F.get(values, F.lit(i)).alias(name) for i, name in enumerate(names)])


def mean_abs_scale(context: Column, floor: float = 1e-5) -> Column:
    """Mean absolute value of a context window, never below ``floor``."""
    return F.greatest(list_mean(F.transform(context, lambda x: F.abs(x))), F.lit(floor))


def scale_context(context: Column, floor: float = 1e-5) -> Column:
    scale = mean_abs_scale(context, floor)
    return F.transform(context, lambda x: x / scale)


def ewm_mean(values: Column, com: float = 1.0) -> Column:
    """Exponentially weighted mean of a list, newest last, weights normalised."""
    keep = com / (1.0 + com)
    state = F.aggregate(
        values,
        F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("bottom")),
        lambda acc, x: F.struct(
            (acc["top"] * F.lit(keep) + x).alias("top"), (acc["bottom"] * F.lit(keep) + F.lit(1.0)).alias("bottom")
        ),
    )
    return F.try_divide(state["top"], state["bottom"])


def cover_fractions(text: Column, bands: Sequence[str] = LAND_COVER_BANDS, positional: bool = False) -> list[Column]:
    """Fraction of the total per band from ``[[band, value], ...]`` text.

    By default bands are looked up by number, so an absent band is 0. ``positional`` names the
    numbers with a decimal point in the order they appear and leaves missing ones null.
    """
    if positional:
        found = decimals_in(text)
        total = list_sum(found)
        return [F.try_divide(F.get(found, F.lit(i)), total).alias(band) for i, band in enumerate(bands)]
    pairs = band_pairs(text)
    total = list_sum(F.map_values(pairs))
    return [
        F.try_divide(F.coalesce(F.try_element_at(pairs, F.lit(i)), F.lit(0.0)), total).alias(band)
        for i, band in enumerate(bands)
    ]


def squared_distance(a: Column, b: Column) -> Column:
    return list_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
