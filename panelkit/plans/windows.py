"""Window functions."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions.arrays import ewm_mean
from ..operators import association, fills, lags, periods, ranking, series
from ..operators.series import collect_series
from ..session import cut_lineage
from .registry import query


def _lag_sql(names: dict[str, list[int]], source: str, start: str, end: str, target: str = "count", alias: dict | None = None,
             extra: str = "month", env: tuple = ()) -> str:
    alias = alias or {target: "cases"}
    cols = [f'lag({c}, {i}) OVER w AS "{i}_shifted_{alias.get(c, c)}"' for c, steps in names.items() for i in steps]
    made = [f'"{i}_shifted_{alias.get(c, c)}"' for c, steps in names.items() for i in steps]
    return (
        f"WITH f AS (SELECT entity, start_date, {target} AS target, {extra}, {', '.join(cols)} FROM {source} "
        f"WINDOW w AS (PARTITION BY entity ORDER BY start_date)) SELECT * FROM f WHERE start_date >= DATE '{start}' "
        f"AND start_date < DATE '{end}' AND " + " AND ".join(f"{m} IS NOT NULL" for m in made)
    )


@query("win_1_target_lags", "WIN-1", _lag_sql({"count": list(range(2, 8))}, "panel", "1996-01-01", "2001-01-01"), uses="panel")
def _(t):
    return lags.lag_frame(t.panel, "1996-01-01", "2001-01-01", "count", case_lookback=6, case_lag=2, dense=True)


_JOINED = "(SELECT p.*, q.volume, q.top_price FROM panel p JOIN parameters q USING (entity, start_date)) j"


def _with_parameters(t):
    return t.panel.join(t.parameters.select("entity", "start_date", "volume", "top_price"), ["entity", "start_date"])


@query(
    "win_2_covariate_lags", "WIN-2",
    _lag_sql({"count": [1, 2, 3], "volume": [0, 1, 2], "top_price": [0, 1, 2]}, _JOINED, "1996-01-01", "2001-01-01"),
    uses="panel parameters",
)
def _(t):
    return lags.lag_frame(
        _with_parameters(t), "1996-01-01", "2001-01-01", "count", case_lookback=3, env_list=["volume", "top_price"],
        env_lookback=3, env_lag=0,
    )


@query(
    "win_3_specific_lags", "WIN-3",
    _lag_sql({"count": [1, 12, 24], "volume": [1, 6]}, _JOINED, "1998-01-01", "2001-01-01"), uses="panel parameters",
)
def _(t):
    return lags.lag_frame(
        _with_parameters(t), "1998-01-01", "2001-01-01", "count", env_list=["volume"], specific_cases=[1, 12, 24],
        specific_env=[1, 6],
    )


@query(
    "win_4_lag_frame", "WIN-4 FLT-2",
    _lag_sql({"cases_per_100k": list(range(1, 25))}, "(SELECT * FROM panel WHERE cases_per_100k IS NOT NULL)", "1997-01-01", "2001-01-01",
             target="cases_per_100k", alias={"cases_per_100k": "cases"}),
    uses="panel",
)
def _(t):
    known = t.panel.filter(F.col("cases_per_100k").isNotNull())
    return lags.lag_frame(known, "1997-01-01", "2001-01-01")


@query(
    "win_5_filter_before_lag", "WIN-5",
    _lag_sql({"count": list(range(1, 19))}, "(SELECT * FROM panel WHERE start_date >= DATE '1996-01-01' AND start_date < DATE '2000-01-01')",
             "1990-01-01", "2010-01-01"),
    uses="panel",
)
def _(t):
    return lags.lag_frame(t.panel, "1998-01-01", "2000-01-01", "count", case_lookback=18, filter_first=True)


@query(
    "win_6_single_lag", "WIN-6",
    "SELECT * FROM (SELECT *, lag(count) OVER (PARTITION BY entity ORDER BY start_date) AS case_lag FROM counts) WHERE case_lag IS NOT NULL",
    uses="counts",
)
def _(t):
    return lags.single_lag(t.counts, "count")


@query(
    "win_7_partition_totals", "WIN-7",
    """SELECT entity, start_date, count, CAST(sum(count) OVER (PARTITION BY entity) AS BIGINT) AS total,
         CAST(sum(count) OVER (PARTITION BY entity) AS DOUBLE) / count(*) OVER (PARTITION BY entity) AS mean FROM dense""",
    uses="dense",
)
def _(t):
    w = W.partitionBy("entity")
    total = F.sum("count").over(w)
    return t.dense.withColumns({"total": total, "mean": total / F.count("*").over(w)})


@query(
    "win_8_ordinal_rank", "WIN-8",
    """SELECT entity, start_date, month, count, CAST(row_number() OVER (PARTITION BY entity, month ORDER BY count, start_date) AS INTEGER) AS rank FROM panel""",
    uses="panel",
)
def _(t):
    cols = t.panel.select("entity", "start_date", "month", "count")
    return ranking.ordinal_rank(cols, ["entity", "month"], ["count", "start_date"])


@query(
    "win_9_dense_code", "WIN-9",
    "SELECT l_orderkey, l_partkey, l_suppkey, dense_rank() OVER (ORDER BY l_partkey) AS code FROM lineitem",
)
def _(t):
    return ranking.dense_code(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey"), "l_partkey")


@query(
    "win_9_dense_code_text", "WIN-9",
    "SELECT p_partkey, p_type, dense_rank() OVER (ORDER BY p_type) AS code FROM part",
)
def _(t):
    return ranking.dense_code(t.part.select("p_partkey", "p_type"), "p_type")


def _rolling_sql(months: int, keep: int, extra: str = "", size: str | None = None) -> str:
    size = size or f"len(l) = {months}"
    return f"""WITH r AS (SELECT entity, start_date, count, list(count) OVER (PARTITION BY entity ORDER BY year(start_date) * 12 + month(start_date)
        RANGE BETWEEN {months - 1} PRECEDING AND CURRENT ROW) AS l FROM counts)
      SELECT entity, start_date, count, array_to_string(l[1:{keep}], ',') AS case_lag FROM r WHERE {size}"""


@query("win_10_rolling_history", "WIN-10 FLT-7", _rolling_sql(24, 23), uses="counts")
def _(t):
    out = lags.rolling_history(t.counts, "count", 24, 23)
    return out.withColumn("case_lag", F.array_join(F.col("case_lag").cast("array<string>"), ","))


@query("win_10_rolling_history_after_cut", "WIN-10", _rolling_sql(12, 11, size="least(len(l), 11) = 11"), uses="counts")
def _(t):
    out = lags.rolling_history(t.counts, "count", 12, 11, test_after_cut=True)
    return out.withColumn("case_lag", F.array_join(F.col("case_lag").cast("array<string>"), ","))


@query(
    "win_11_neighbour_matrix", "WIN-11",
    """WITH d AS (SELECT a.entity, b.entity AS neighbour, sum((a.count - b.count) * (a.count - b.count)) AS d2 FROM dense a JOIN dense b USING (start_date)
             WHERE a.entity <> b.entity GROUP BY 1, 2),
       nb AS (SELECT entity, neighbour, row_number() OVER (PARTITION BY entity ORDER BY d2, neighbour) AS rank FROM d QUALIFY rank <= 14),
       h AS (SELECT entity, start_date, count, list(count) OVER (PARTITION BY entity ORDER BY start_date ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS l FROM dense),
       own AS (SELECT entity, start_date, count, array_to_string(l[1:23], ',') AS o FROM h WHERE len(l) = 24),
       th AS (SELECT nb.entity, own.start_date, string_agg(own.o, ',' ORDER BY rank) AS o FROM nb JOIN own ON own.entity = nb.neighbour GROUP BY 1, 2)
       SELECT own.entity, own.start_date, own.count, own.o || ',' || th.o AS features FROM own JOIN th USING (entity, start_date)""",
    uses="dense",
)
def _(t):
    # the entity itself and its 14 nearest by the whole series, 24 months
    near = association.nearest(collect_series(t.dense, ["count"]), "count", 14, include_self=False)
    neighbours = cut_lineage(near.select(F.col("i").alias("entity"), F.col("j").alias("neighbour"), "rank"), "near")
    out = lags.neighbour_matrix(t.dense, neighbours, "count", 24)
    return out.withColumn("features", F.array_join(F.col("features").cast("array<string>"), ","))


@query("win_12_interpolate", "WIN-12", "SELECT entity, year, pop FROM interpolated", uses="interpolated")
def _(t):
    return fills.interpolate(t.raw_exposure, "pop", ["entity"], "year")


@query("win_13_backward_fill", "WIN-13", "SELECT entity, year, pop FROM exposure", uses="exposure")
def _(t):
    return t.exposure


_UPSAMPLED = """lim AS (SELECT entity, min(start_date) AS a, max(start_date) AS b FROM c GROUP BY 1),
    spine AS (SELECT entity, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS start_date FROM lim),
    up AS (SELECT s.entity, s.start_date, c.count, c.top, c.kind FROM spine s LEFT JOIN c ON c.entity = s.entity AND c.start_date = s.start_date)"""
_DAILY_C = "c AS (SELECT entity, event_date AS start_date, count(*) AS count, max(value) AS top, min(kind) AS kind FROM daily GROUP BY 1, 2)"


def _daily_counts(t):
    return periods.count_by_period(t.daily, "day", aggs={"top": F.max("value"), "kind": F.min("kind")})


@query(
    "win_14_forward_fill", "WIN-14 CAL-1",
    f"""WITH {_DAILY_C}, {_UPSAMPLED} SELECT entity, start_date, count,
        last_value(top IGNORE NULLS) OVER w AS top, last_value(kind IGNORE NULLS) OVER w AS kind FROM up
        WINDOW w AS (PARTITION BY entity ORDER BY start_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    uses="daily",
)
def _(t):
    up = periods.upsample_daily(_daily_counts(t))
    return fills.forward_fill(up, ["entity"], "start_date", but=["count"])


@query(
    "win_15_ewm_mean", "WIN-15",
    """WITH h AS (SELECT entity, start_date, row_number() OVER (PARTITION BY entity ORDER BY start_date) AS r, count FROM dense),
       p AS (SELECT a.entity, a.start_date, sum(b.count * pow(0.5, a.r - b.r)) / sum(pow(0.5, a.r - b.r)) AS e
             FROM h a JOIN h b ON a.entity = b.entity AND b.r BETWEEN a.r - 11 AND a.r WHERE a.r >= 12 GROUP BY 1, 2)
       SELECT entity, start_date, round(e, 6) AS ewm FROM p""",
    uses="dense",
)
def _(t):
    lists = lags.rolling_history(t.dense, "count", 12, 12, "l")
    ewm = ewm_mean(F.transform("l", lambda x: x.cast("double")), 1.0)
    return lists.select("entity", "start_date", F.round(ewm, 6).alias("ewm"))


def _windows_sql(cut: str) -> str:
    return f"""WITH s AS (SELECT entity, list(count ORDER BY start_date) AS v FROM dense GROUP BY 1),
      c AS (SELECT entity, v, {cut} AS cut FROM s)
      SELECT entity, cut, array_to_string(list_concat(list_resize([]::BIGINT[], greatest(100 - cut, 0), 0), v[greatest(cut - 99, 1):cut]), ',') AS past,
        array_to_string(list_concat(list_resize([]::INTEGER[], greatest(100 - cut, 0), 1), list_resize([]::INTEGER[], least(cut, 100), 0)), ',') AS is_pad,
        coalesce(array_to_string(v[cut + 1:cut + 3], ','), '') AS future FROM c"""


def _instances(t, mode: str):
    lists = series.collect_series(t.dense, ["count"])
    cut = series.split_point(mode, "count", "entity", 3)
    out = series.instance_windows(lists, "count", cut, 100, 3, ["entity"])
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("past", "is_pad", "future")})


@query("win_16_instance_windows_valid", "WIN-16 WIN-17", _windows_sql("CAST(len(v) - 3 AS INTEGER)"), uses="dense")
def _(t):
    return _instances(t, "valid")


@query("win_17_instance_sampler_test", "WIN-17 WIN-16", _windows_sql("CAST(len(v) AS INTEGER)"), uses="dense")
def _(t):
    return _instances(t, "test")


_DRAW = "(('0x' || substr(md5(CAST(entity AS VARCHAR) || '|42'), 1, 13)) :: BIGINT / 4503599627370496.0)"


@query("win_17_instance_sampler_train", "WIN-17", _windows_sql(f"CAST(floor({_DRAW} * greatest(len(v) - 3 + 1, 1)) AS INTEGER)"), uses="dense")
def _(t):
    return _instances(t, "train")


@query(
    "win_18_history_vector", "WIN-18",
    """WITH h AS (SELECT entity, start_date, count, list(count) OVER (PARTITION BY entity ORDER BY start_date ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS l FROM dense)
       SELECT entity, start_date, count, array_to_string(list_append(l, month(start_date)), ',') AS history FROM h WHERE len(l) = 24""",
    uses="dense",
)
def _(t):
    panel = t.dense.withColumn("month", F.month("start_date"))
    out = lags.history_vector(panel, "count", 2)
    return out.select("entity", "start_date", "count", F.array_join(F.col("history").cast("array<string>"), ",").alias("history"))
