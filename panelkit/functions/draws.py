"""Repeatable pseudo-random draws: a function of the row, so a rerun task or another engine gets the same."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_HEX_DIGITS = 13  # 52 bits, exact as double


def unit_draw(seed: int, *columns: Column | str) -> Column:
    """Number in [0, 1) from the columns' values and a seed."""
    text = F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns], F.lit(str(seed)))
    digits = F.substring(F.md5(text), 1, _HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16**_HEX_DIGITS))
