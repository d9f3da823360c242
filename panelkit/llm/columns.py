"""Column helpers of the document operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word, everywhere in this package.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
