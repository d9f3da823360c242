"""Share of each raster cell that lies inside each region, from the regions' outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Shares under this are rounding of edges that cancel out.
LEAST_SHARE = 1e-9


def _edges(vertices: DataFrame) -> DataFrame:
    """``region, ring, ax, ay, bx, by``: each vertex and the next one of its ring, the last one and the first."""
    keys = ["region", "ring"]
    here = vertices.select(*keys, "vertex_no", F.col("x").alias("ax"), F.col("y").alias("ay"))
    after = vertices.select(*keys, (F.col("vertex_no") - 1).alias("vertex_no"), F.col("x").alias("bx"), F.col("y").alias("by"))
    ends = vertices.groupBy(*keys).agg(
        F.max_by("x", "vertex_no").alias("ax"), F.max_by("y", "vertex_no").alias("ay"),
        F.min_by("x", "vertex_no").alias("bx"), F.min_by("y", "vertex_no").alias("by"),
    )
    return here.join(after, [*keys, "vertex_no"]).drop("vertex_no").unionByName(ends)


def cell_shares(vertices: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """``region, row, col, share`` of all cells that a region covers in part or whole.

    ``vertices`` has (region, ring, hole, vertex_no, x, y), numbered without gaps in each ring; a hole is taken off its
    region. Rings may run either way and may be closed by a repeated vertex. Cells are squares of ``size`` from (x0, y0).

    Every edge is cut at the cells it crosses, an index of edges by cell. Inside a row of cells the area left of an edge
    counts for its own cell in part and for all cells behind it by its height: both are sums by cell, so the parts of
    a long outline meet only as one number each. A running sum along the row then gives the share of every cell, and cells
    between two crossed ones share one value.
    """
    scaled = vertices.withColumns({"x": (F.col("x") - x0) / size, "y": (F.col("y") - y0) / size})
    edges = _edges(scaled)
    turn = edges.groupBy("region", "ring").agg(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")).alias("area"))
    holes = vertices.groupBy("region", "ring").agg(F.max(F.col("hole").cast("int")).alias("hole"))
    sign = turn.join(holes, ["region", "ring"]).select("region", "ring", (F.signum("area") * (1 - 2 * F.col("hole"))).alias("sign"))
    rising = edges.filter("ay <> by").join(sign, ["region", "ring"])
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    last = lambda top, bottom: F.greatest(F.floor(bottom), F.ceil(top) - 1)
    rows = rising.withColumn("row", F.explode(F.sequence(F.floor(low), last(high, low))))
    at = lambda y: F.col("ax") + (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / (F.col("by") - F.col("ay"))
    bottom, top = F.greatest(low, F.col("row").cast("double")), F.least(high, F.col("row") + 1.0)
    cut = rows.select(
        "region", "row", at(bottom).alias("u"), at(top).alias("v"),
        (F.col("sign") * F.when(F.col("by") > F.col("ay"), 1.0).otherwise(-1.0) * (top - bottom)).alias("height"))
    left, right = F.least("u", "v"), F.greatest("u", "v")
    cells = cut.withColumn("col", F.explode(F.sequence(F.floor(left), last(right, left))))
    start, stop = F.greatest(left, F.col("col").cast("double")), F.least(right, F.col("col") + 1.0)
    part = F.col("height") * F.when(right > left, (stop - start) / (right - left)).otherwise(1.0)
    sums = cells.groupBy("region", "row", "col").agg(F.sum(part).alias("height"), F.sum(part * (F.col("col") + 1 - (start + stop) / 2)).alias("area"))
    along = W.partitionBy("region", "row").orderBy("col")  # the crossed cells of one region and row
    upto = F.sum("height").over(along)
    shares = sums.select("region", "row", "col", (-(upto - F.col("height") + F.col("area"))).alias("share"), (-upto).alias("inner"), F.lead("col").over(along).alias("next"))
    run = F.when((F.col("next") > F.col("col") + 1) & (F.abs("inner") > LEAST_SHARE), F.sequence(F.col("col") + 1, F.col("next") - 1))
    inside = shares.select("region", "row", F.explode(run).alias("col"), F.col("inner").alias("share"))
    crossed = shares.filter(F.abs("share") > LEAST_SHARE).select("region", "row", "col", "share")
    return crossed.unionByName(inside)


def cell_of(x: Column, y: Column, size: float, x0: float = 0.0, y0: float = 0.0) -> tuple[Column, Column]:
    """Row and column of the cell that a point lies in."""
    return F.floor((y - y0) / size).alias("row"), F.floor((x - x0) / size).alias("col")


def region_pixels(pixels: DataFrame, vertices: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """``pixels`` (with ``x``, ``y`` of a point in each cell) once for each region they touch, with ``region`` and ``weight``,
    the share of the pixel inside it. Pixels outside all regions are left out."""
    row, col = cell_of(F.col("x"), F.col("y"), size, x0, y0)
    placed = pixels.select("*", row, col)
    shares = cell_shares(vertices, size, x0, y0).withColumnRenamed("share", "weight")
    return placed.join(shares, ["row", "col"]).drop("row", "col")
