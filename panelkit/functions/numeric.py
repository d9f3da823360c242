"""Numeric column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def safe_div(top: Column, bottom: Column) -> Column:
    """Quotient as double, null where the denominator is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def rate_per(count: Column, population: Column, per: float = 100_000.0) -> Column:
    """Events per ``per`` people; null for an empty population."""
    return F.try_divide(count.cast("double"), population.cast("double") / F.lit(per))


def log_offset(value: Column, offset: float = 0.1) -> Column:
    return F.log(value + F.lit(offset))


def unit_scale(value: Column, low: float, high: float) -> Column:
    """Fixed min-max scaling; values outside the limits stay outside 0..1."""
    return (value - F.lit(low)) / F.lit(high - low)


def series_age(position: Column) -> Column:
    """Age feature of a step, ``position`` counted from 0."""
    return F.log10(F.lit(2.0) + position)


def scaled_month(month: Column) -> Column:
    """Month 1..12 mapped to -0.5..0.5."""
    return (month - F.lit(1)) / F.lit(11.0) - F.lit(0.5)


def right_closed_bins(value: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin ``(previous, break]`` that holds the value; null stays null."""
    if len(labels) != len(breaks) + 1:
        raise ValueError("need one label more than breaks")
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(breaks, labels):
        out = out.when(value <= F.lit(edge), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit to ``low``..``high``, keeping nulls."""
    out = value
    if low is not None:
        out = F.when(out < F.lit(low), F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > F.lit(high), F.lit(high)).otherwise(out)
    return out


def guarded_corr(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson correlation from sums; null where a side is constant."""
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    return F.when((vx > 0) & (vy > 0), (n * sxy - sx * sy) / (F.sqrt(vx) * F.sqrt(vy)))
