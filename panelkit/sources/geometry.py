"""Region geometry from vertex rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def region_centroids(vertices: DataFrame, region: str = "region", number: str = "vertex_no", x: str = "x", y: str = "y"
                     ) -> DataFrame:
    """Signed area and centroid per region by the shoelace formula.

    Vertices are numbered without gaps. Each meets the next one on equal (region, number), which
    spreads a region with many vertices over all tasks; the closing edge is added to the sums.
    """
    here = vertices.select(region, number, F.col(x).alias("ax"), F.col(y).alias("ay"))
    after = vertices.select(region, (F.col(number) - 1).alias(number), F.col(x).alias("bx"), F.col(y).alias("by"))
    cross = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    edges = here.join(after, [region, number]).groupBy(region).agg(
        F.sum(cross).alias("_c"), F.sum((F.col("ax") + F.col("bx")) * cross).alias("_cx"),
        F.sum((F.col("ay") + F.col("by")) * cross).alias("_cy"),
    )
    ends = vertices.groupBy(region).agg(
        F.max_by(x, number).alias("ax"), F.max_by(y, number).alias("ay"),
        F.min_by(x, number).alias("bx"), F.min_by(y, number).alias("by"),
    )
    area2 = F.col("_c") + cross
    return edges.join(ends, region).select(
        region,
        (area2 / 2.0).alias("area"),
        F.try_divide(F.col("_cx") + (F.col("ax") + F.col("bx")) * cross, area2 * 3).alias("x_centroid"),
        F.try_divide(F.col("_cy") + (F.col("ay") + F.col("by")) * cross, area2 * 3).alias("y_centroid"),
    )
