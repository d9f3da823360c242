"""Registered queries: oracle parity on the smallest data, plan shapes, order independence."""

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check_oracle import rows_of  # noqa: E402

from panelkit.operators import lags  # noqa: E402
from panelkit.plans import all_entries  # noqa: E402
from panelkit.plans.standins import TABLES, Tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"
ENTRIES = all_entries()
WITH_SQL = [name for name, entry in ENTRIES.items() if entry.sql]


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", WITH_SQL)
def test_oracle(spark, con, name):
    df = ENTRIES[name].build(Tables(spark, SMALL))
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(ENTRIES[name].sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(columns, cursor.fetchall())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_lags_use_one_window(spark):
    t = Tables(spark, SMALL)
    frame = lags.lag_frame(t.dense.withColumn("month", F.month("start_date")), "1997-01-01", "2001-01-01", "count", dense=True)
    plan = plan_of(frame)
    assert plan.count("+- Window [") == 1


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(ENTRIES["flt_2_half_open_range"].build(Tables(spark, SMALL)))
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_extendedprice" not in plan
    plan = plan_of(ENTRIES["agg_1_weekly_counts"].build(Tables(spark, SMALL)))
    assert "ReadSchema: struct<l_suppkey:bigint,l_shipdate:timestamp_ntz>" in plan


SHUFFLED = [
    "flagship_labelled_panel", "win_4_lag_frame", "agg_1_monthly_counts", "agg_22_item_metrics", "srt_3_top_nine", "spl_2_expanding_folds",
    "scl_13_rank_quantile_cut", "agg_29_zonal_median", "agg_7_series_dataset",
]


class Reordered(Tables):
    """The same tables with rows in another order and other partitions."""

    def __getattr__(self, name):
        return super().__getattr__(name).orderBy(F.rand(7)).repartition(13)


@pytest.mark.parametrize("name", SHUFFLED)
def test_row_order_does_not_matter(spark, name):
    entry = ENTRIES[name]
    a, b = entry.build(Tables(spark, SMALL)), entry.build(Reordered(spark, SMALL))
    assert rows_of(a.columns, [tuple(r) for r in a.collect()]) == rows_of(b.columns, [tuple(r) for r in b.collect()])


def test_entry_point(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
