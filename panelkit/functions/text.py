"""String and date-text column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Land-cover band names in band order.
LAND_COVER_BANDS = (
    "water", "trees", "grass", "flooded_vegetation", "crops", "shrub_scrub", "built", "bare", "snow_ice",
)


def prefix(text: Column, length: int = 6) -> Column:
    return F.substring(text, 1, length)


def drop_last(text: Column, n: int = 1) -> Column:
    return F.left(text, F.greatest(F.length(text) - F.lit(n), F.lit(0)))


def parse_date(text: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Strict: a bad value fails the job."""
    return F.to_date(text, pattern)


def try_parse_date(text: Column, pattern: str = "yyyyMMdd") -> Column:
    """Lenient: a bad value becomes null."""
    return F.try_to_date(text, pattern)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def variable_from_path(path: Column) -> Column:
    """Variable name in ``.../{variable}_{start date}_{end date}.parquet``."""
    return F.regexp_extract(path, r"([^/]+?)_\d{4}-\d{2}-\d{2}_\d{4}-\d{2}-\d{2}\.parquet", 1)


def decimals_in(text: Column) -> Column:
    """Every number written with a decimal point after white space, as doubles."""
    found = F.regexp_extract_all(text, F.lit(r"(\s[0-9]*\.[0-9]*)"), F.lit(1))
    return F.transform(found, lambda x: F.trim(x).cast("double"))


def band_pairs(text: Column) -> Column:
    """``[[band, value], ...]`` text as a map from band to value."""
    bands = F.transform(
        F.regexp_extract_all(text, F.lit(r"\[\s*(\d+)\s*,\s*[0-9.]+\s*\]"), F.lit(1)), lambda x: x.cast("int")
    )
    values = F.transform(
        F.regexp_extract_all(text, F.lit(r"\[\s*\d+\s*,\s*([0-9.]+)\s*\]"), F.lit(1)), lambda x: x.cast("double")
    )
    return F.map_from_arrays(bands, values)


def safe_name(name: str) -> str:
    """Column name with every run of other characters than word characters made ``_``."""
    return re.sub(r"\W+", "_", name)
