"""Sorts, limits and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import association
from ..operators.series import collect_series
from .aggregates import _CORR
from .joining import _KNN, _LAGGED, lagged_series
from .registry import query


@query("srt_1_sort", "SRT-1", "SELECT entity, start_date, count FROM counts ORDER BY entity, start_date DESC", uses="counts")
def _(t):
    return t.counts.orderBy("entity", F.col("start_date").desc())


@query(
    "srt_2_top_lag_correlated", "SRT-2",
    "WITH " + _LAGGED + """ SELECT i, j, round(corr, 9) AS corr, 1 AS rank FROM corrs WHERE i <> j AND corr IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY i ORDER BY corr DESC, j) = 1""",
    uses="dense",
)
def _(t):
    return association.top_correlated(lagged_series(t), "now", "prev", 1).withColumn("corr", F.round("corr", 9))


_BOTH = ", both_ways AS (SELECT i, j, corr FROM corrs WHERE corr IS NOT NULL UNION ALL SELECT j, i, corr FROM corrs WHERE corr IS NOT NULL)"


@query(
    "srt_3_top_nine", "SRT-3",
    "WITH " + _CORR + _BOTH + """ SELECT i, j, round(corr, 9) AS corr, CAST(row_number() OVER (PARTITION BY i ORDER BY corr DESC, j) AS INTEGER) AS rank
      FROM both_ways QUALIFY rank <= 9""",
    uses="dense",
)
def _(t):
    return association.top_correlated(collect_series(t.dense, ["count"]), "count", k=9).withColumn("corr", F.round("corr", 9))


@query(
    "srt_4_largest_of_one", "SRT-4",
    "WITH " + _CORR + _BOTH + """ SELECT j, round(corr, 9) AS corr FROM both_ways WHERE i = (SELECT min(entity) FROM dense)
      ORDER BY both_ways.corr DESC, j LIMIT 10""",
    uses="dense",
)
def _(t):
    low = t.dense.agg(F.min("entity")).scalar()
    best = association.most_like(collect_series(t.dense, ["count"]), F.col("entity") == low, "count", 10)
    return best.select("j", F.round("corr", 9).alias("corr"))


@query("srt_5_nearest", "SRT-5", "WITH " + _KNN + " SELECT i, j, round(distance, 6) AS distance, rank FROM near")
def _(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("entity"), "embedding")
    return association.nearest(vectors, "embedding", 15).withColumn("distance", F.round("distance", 6))


_PLACES = "pl AS (SELECT entity, count(*) AS x, CAST(max(quantity) * 7 AS DOUBLE) + entity % 13 AS y FROM line_list GROUP BY 1)"
_NINE = _CORR + _BOTH + """, nine AS (SELECT i, j FROM both_ways QUALIFY row_number() OVER (PARTITION BY i ORDER BY corr DESC, j) <= 9),
    dist AS (SELECT n.i, n.j, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS distance FROM nine n JOIN pl a ON a.entity = n.i JOIN pl b ON b.entity = n.j)"""


def _distances(t):
    # place of an entity: number of cases and a mix of its size and id
    places = t.line_list.groupBy("entity").agg(
        F.count("*").alias("x"), (F.max("quantity") * 7 + F.first(F.col("entity") % 13)).alias("y")
    )
    partners = association.top_correlated(collect_series(t.dense, ["count"]), "count", k=9)
    return association.partner_distances(partners, places, "x", "y")


@query(
    "srt_6_partner_path", "SRT-6",
    "WITH " + _PLACES + ", " + _NINE + " SELECT i, j, CAST(row_number() OVER (PARTITION BY i ORDER BY distance, j) AS INTEGER) AS step, round(distance, 6) AS distance FROM dist",
    uses="dense line_list",
)
def _(t):
    return _distances(t).withColumn("distance", F.round("distance", 6))


@query(
    "srt_6_path_lengths", "SRT-6",
    "WITH " + _PLACES + ", " + _NINE + """ SELECT round(avg(km), 9) AS mean_km, round(min(km), 9) AS min_km, round(max(km), 9) AS max_km
      FROM (SELECT i, max(distance) / 1000 AS km FROM dist GROUP BY 1)""",
    uses="dense line_list",
)
def _(t):
    out = association.path_lengths(_distances(t))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(
    "srt_7_groups_by_size", "SRT-7",
    "SELECT s_nationkey, count(*) AS members FROM supplier GROUP BY 1 ORDER BY members DESC, s_nationkey",
)
def _(t):
    return t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("members")).orderBy(F.col("members").desc(), "s_nationkey")
