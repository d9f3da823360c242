"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from ..operators.association import nearest, top_correlated
from ..operators.lags import add_lags
from ..operators.series import collect_series
from ..operators.splits import drop_zero_entities
from ..operators.targets import apply_expectations, expectations
from ..operators.zonal import add_period_weight
from .registry import query
from .standins import TRAIN_END


@query(
    "jon_1_inner_composite", "JON-1",
    "SELECT p.entity, p.start_date, p.count, q.volume, q.top_price, q.low_tax FROM panel p JOIN parameters q USING (entity, start_date)",
    uses="panel parameters",
)
def _(t):
    params = t.parameters.drop("end_date")
    return t.panel.select("entity", "start_date", "count").join(params, ["entity", "start_date"], "inner")


@query(
    "jon_2_left_composite", "JON-2",
    "SELECT p.entity, p.start_date, p.count, q.volume FROM panel p LEFT JOIN parameters q USING (entity, start_date)",
    uses="panel parameters",
)
def _(t):
    params = t.parameters.select("entity", "start_date", "volume")
    return t.panel.select("entity", "start_date", "count").join(params, ["entity", "start_date"], "left")


@query(
    "jon_2_left_salted_line_list", "JON-2",
    """SELECT l.entity, l.event_date, l.part, l.quantity, x.pop FROM line_list l
       LEFT JOIN exposure x ON x.entity = l.entity AND x.year = year(l.event_date)""",
    uses="line_list exposure",
)
def _(t):
    rows = t.line_list.select("entity", "event_date", "part", "quantity", "order_id", F.year("event_date").alias("year"))
    joined = joins.salted_join(rows, t.exposure, ["entity", "year"], ["order_id", "part", "event_date"], how="left")
    return joined.select("entity", "event_date", "part", "quantity", "pop")


@query(
    "jon_3_named_keys", "JON-3",
    "SELECT o_orderkey, o_custkey, c_name, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def _(t):
    right = t.customer.select("c_custkey", "c_name", "c_nationkey")
    return joins.join_named(t.orders.select("o_orderkey", "o_custkey"), right, {"o_custkey": "c_custkey"}, spread_on=["o_orderkey"])


@query(
    "jon_4_left_then_drop_null", "JON-4 FLT-5",
    "SELECT d.entity, d.start_date, d.count, x.year, x.pop FROM dense d JOIN raw_exposure x ON x.entity = d.entity AND x.year = year(d.start_date) WHERE x.pop IS NOT NULL",
    uses="dense raw_exposure",
)
def _(t):
    left = t.dense.withColumn("year", F.year("start_date"))
    return joins.join_complete(left, t.raw_exposure, ["entity", "year"])


@query(
    "jon_5_small_lookups", "JON-5",
    """SELECT p.entity, p.start_date, p.count, i.anomaly, i.peak, e.nation, e.name FROM panel p
       LEFT JOIN idx i USING (year, month) LEFT JOIN entities e USING (entity)""",
    uses="panel idx entities",
)
def _(t):
    static = t.entities.select("entity", "nation", "name")
    cols = t.panel.select("entity", "start_date", "count", "year", "month")
    index = F.broadcast(t.index)  # one row per calendar month
    return cols.join(index, ["year", "month"], "left").join(static, "entity", "left").drop("year", "month")


@query(
    "jon_6_many_variables", "JON-6",
    """SELECT entity, end_date, start_date, volume, start_date AS start_date_price, top_price, start_date AS start_date_tax, low_tax
       FROM parameters""",
    uses="parameters",
)
def _(t):
    pick = lambda c: t.parameters.select("entity", "end_date", "start_date", c)
    frames = {"volume": pick("volume"), "price": pick("top_price"), "tax": pick("low_tax")}
    return joins.join_variables(frames, ["entity", "end_date"])


@query(
    "jon_7_semi_join", "JON-7",
    """SELECT entity, event_date, kind, value FROM daily WHERE entity IN
        (SELECT entity FROM daily WHERE kind = 'error' AND event_date < DATE '2024-01-05')""",
    uses="daily",
)
def _(t):
    early = t.daily.filter((F.col("kind") == "error") & (F.col("event_date") < F.lit("2024-01-05").cast("date")))
    kept = early.select("entity").distinct()
    return joins.salted_join(t.daily, kept, ["entity"], ["event_id"], how="left_semi").select("entity", "event_date", "kind", "value")


@query(
    "jon_8_anti_join", "JON-8 AGG-26",
    """SELECT entity, event_date, kind, value FROM daily WHERE entity NOT IN (SELECT entity FROM daily GROUP BY entity
        HAVING sum(CASE WHEN kind = 'error' AND event_date < DATE '2024-01-05' THEN 1 ELSE 0 END) = 0)""",
    uses="daily",
)
def _(t):
    hit = (F.col("kind") == "error") & (F.col("event_date") < F.lit("2024-01-05").cast("date"))
    train = t.daily.withColumn("target", F.when(hit, 1).otherwise(0))
    return drop_zero_entities(t.daily, train).select("entity", "event_date", "kind", "value")


@query(
    "jon_9_missing_per_period", "JON-9 SET-3",
    """SELECT e.entity, p.start_date, e.name FROM entities e CROSS JOIN (SELECT DISTINCT start_date FROM counts) p
       LEFT JOIN counts c ON c.entity = e.entity AND c.start_date = p.start_date WHERE c.entity IS NULL""",
    uses="entities counts",
)
def _(t):
    blanks = t.dense.join(t.counts, ["entity", "start_date"], "left_anti").select("entity", "start_date")
    return blanks.join(t.entities.select("entity", "name"), "entity", "left")


@query(
    "jon_10_apply_expectations", "JON-10 TGT-6",
    """WITH x AS (SELECT entity, month(start_date) AS month, CAST(sum(count) AS DOUBLE) / count(count) AS expected FROM counts
          WHERE start_date < DATE '1996-06-01' GROUP BY 1, 2)
        SELECT c.entity, c.start_date, c.count, x.expected FROM counts c JOIN x ON x.entity = c.entity
          AND x.month = month(c.start_date) WHERE c.start_date >= DATE '1996-06-01'""",
    uses="counts",
)
def _(t):
    months = t.counts.withColumn("month", F.month("start_date"))
    cut = F.lit("1996-06-01").cast("date")
    expected = expectations(months.filter(F.col("start_date") < cut), ("entity", "month"), "count")
    later = months.filter(F.col("start_date") >= cut)
    return apply_expectations(later, expected, ("entity", "month")).drop("month")


_LAGGED = """lagged AS (SELECT entity, start_date, count AS now, lag(count) OVER (PARTITION BY entity ORDER BY start_date) AS prev FROM dense),
    l AS (SELECT * FROM lagged WHERE prev IS NOT NULL AND start_date < DATE '2000-01-01'),
    pairs AS (SELECT a.entity AS i, b.entity AS j, count(*) AS n, CAST(sum(a.now) AS DOUBLE) AS sx, CAST(sum(b.prev) AS DOUBLE) AS sy,
       CAST(sum(a.now * a.now) AS DOUBLE) AS sxx, CAST(sum(b.prev * b.prev) AS DOUBLE) AS syy, CAST(sum(a.now * b.prev) AS DOUBLE) AS sxy
       FROM l a JOIN l b USING (start_date) GROUP BY 1, 2),
    corrs AS (SELECT i, j, CASE WHEN n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0
       THEN (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) END AS corr FROM pairs)"""


def lagged_series(t):
    """Aligned lists of this month's and last month's count per entity, before the end of training."""
    lagged = add_lags(t.dense, {"count": [1]}).filter(F.col("1_shifted_count").isNotNull())
    early = lagged.filter(F.col("start_date") < F.lit(TRAIN_END).cast("date"))
    renamed = early.select("entity", "start_date", F.col("count").alias("now"), F.col("1_shifted_count").alias("prev"))
    return collect_series(renamed, ["now", "prev"])


@query(
    "jon_11_lagged_partner", "JON-11 SRT-2 AGG-15",
    "WITH " + _LAGGED + """, top AS (SELECT i, j FROM corrs WHERE i <> j AND corr IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY i ORDER BY corr DESC, j) = 1)
      SELECT d.entity, d.start_date, d.count, top.j AS top_correlated_id, x.prev AS shifted_cases FROM dense d
        JOIN top ON top.i = d.entity JOIN lagged x ON x.entity = top.j AND x.start_date = d.start_date WHERE x.prev IS NOT NULL""",
    uses="dense",
)
def _(t):
    best = top_correlated(lagged_series(t), "now", "prev", 1).select(
        F.col("i").alias("entity"), F.col("j").alias("top_correlated_id")
    )
    shifted = add_lags(t.dense, {"count": [1]}).withColumnRenamed("1_shifted_count", "shifted_cases")
    known = shifted.filter(F.col("shifted_cases").isNotNull())
    return joins.join_lagged_partner(t.dense, best, known, "entity", "top_correlated_id", "start_date", "shifted_cases")


@query(
    "jon_12_right_merge", "JON-12",
    """SELECT e.name, e.nation, c.entity, c.start_date, c.count FROM (SELECT * FROM entities WHERE balance >= 0) e
       RIGHT JOIN counts c ON c.entity = e.entity""",
    uses="entities counts",
)
def _(t):
    attributes = t.entities.filter(F.col("balance") >= 0).select("entity", "name", "nation")
    return attributes.join(t.counts, "entity", "right")


@query(
    "jon_13_truncated_ids", "JON-13 SCL-1",
    """SELECT CAST(1000000 + c_custkey * 10 AS VARCHAR) AS region_id, c_name, o.n FROM customer JOIN
         (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey""",
)
def _(t):
    # region ids of seven digits, items keyed by the first six
    regions = t.customer.select((F.lit(1000000) + F.col("c_custkey") * 10).cast("string").alias("region_id"), "c_name")
    items = t.orders.groupBy((F.lit(100000) + F.col("o_custkey")).cast("string").alias("item_id")).agg(F.count("*").alias("n"))
    keyed = regions.withColumn("item_id", F.substring("region_id", 1, 6))
    return keyed.join(items, "item_id").drop("item_id")


@query(
    "jon_14_dictionary_lookup", "JON-14 UDF-3",
    "SELECT c.entity, c.start_date, c.count, n.n_name AS cluster FROM counts c LEFT JOIN entities e USING (entity) LEFT JOIN nation n ON n.n_nationkey = e.nation AND e.balance >= 0",
    uses="counts entities",
)
def _(t):
    named = t.entities.filter(F.col("balance") >= 0).join(t.nation, F.col("nation") == F.col("n_nationkey"))
    return joins.lookup(t.counts, named.select("entity", "n_name"), "entity", "entity", "n_name", "cluster")


_KNN = """v AS (SELECT vec_id AS id, embedding FROM embeddings),
    p AS (SELECT a.id AS i, b.id AS j, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding),
        lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))) AS distance FROM v a CROSS JOIN v b),
    near AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY distance, j) AS INTEGER) AS rank FROM p QUALIFY rank <= 15)"""


def _neighbour_lists(t, chosen=None):
    """Neighbour lists of all vectors, or of the chosen ones, which alone are then compared with all."""
    near = nearest(t.embeddings.select(F.col("vec_id").alias("entity"), "embedding", "label"), "embedding", 15, chosen=chosen)
    return near.groupBy(F.col("i").alias("entity")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "j"))), lambda x: x["j"]).alias("indices")
    )


@query(
    "jon_15_lookup_in_list", "JON-15",
    "WITH " + _KNN + """ SELECT i AS entity, string_agg('v' || j || '/' || e.label, ',' ORDER BY rank) AS neighbours FROM near
       JOIN embeddings e ON e.vec_id = near.j GROUP BY 1""",
)
def _(t):
    names = t.embeddings.select(
        F.col("vec_id").alias("key"), F.concat(F.lit("v"), "vec_id", F.lit("/"), "label").alias("name")
    )
    mapped = joins.lookup_in_list(_neighbour_lists(t), names, ["entity"], "indices", "key", "name", "muni_neighbors")
    return mapped.select("entity", F.array_join("muni_neighbors", ",").alias("neighbours"))


@query(
    "jon_16_reconcile", "JON-16",
    """SELECT *, left_rows = right_rows AND left_rows = merged_rows AS is_match FROM (SELECT
         (SELECT count(*) FROM parameters) AS left_rows, (SELECT count(*) FROM dense) AS right_rows,
         (SELECT count(*) FROM parameters JOIN dense USING (entity, start_date)) AS merged_rows)""",
    uses="parameters dense",
)
def _(t):
    return joins.reconcile(t.parameters, t.dense, ["entity", "start_date"])


@query(
    "jon_17_neighbour_rows", "JON-17",
    "WITH " + _KNN + """ SELECT vec_id, label FROM embeddings WHERE vec_id IN
       (SELECT j FROM near JOIN embeddings e ON e.vec_id = near.i WHERE e.label = 3)""",
)
def _(t):
    chosen = _neighbour_lists(t, F.col("label") == 3)
    rows = t.embeddings.select(F.col("vec_id").alias("entity"), "label")
    out = joins.neighbour_rows(rows, chosen, F.lit(True), "entity", "indices")
    return out.select(F.col("entity").alias("vec_id"), "label")


@query(
    "jon_18_year_of_period", "JON-18",
    """SELECT p.pixel, p.region, p.date, CAST(year(p.date) AS INTEGER) AS year, x.pop FROM pixels p
       LEFT JOIN exposure x ON x.entity = p.region AND x.year = year(p.date)""",
    uses="pixels exposure",
)
def _(t):
    yearly = t.exposure.withColumnRenamed("entity", "region")
    return add_period_weight(t.pixels, yearly, ["region"], "date", "pop", ["pixel", "date", "value"]).select("pixel", "region", "date", "year", "pop")
