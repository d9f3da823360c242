"""Steps whose cost must follow their input: pairs of vectors, repeated sides of joins, windows of days, shared pixels."""

import datetime as dt

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from panelkit.operators import association, joins, periods, zonal


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def vectors(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "entity long, v array<double>")


@pytest.mark.parametrize("symmetric", [True, False])
def test_vector_is_copied_once_a_stripe(spark, symmetric):
    df = vectors(spark, np.arange(640.0).reshape(320, 2))
    tagged = association._stripe_pairs(df, df, "entity", ["v"], 5, symmetric)  # 64 blocks
    assert tagged.groupBy("entity", "side").count().agg(F.max("count")).first()[0] <= 8


@pytest.mark.parametrize("find", [association.cross_corr, association.top_correlated])
def test_series_of_both_sides_are_made_once(spark, find):
    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    x = np.random.default_rng(6).integers(0, 9, size=(40, 9)).astype(float)
    df = vectors(spark, x).mapInPandas(make, "entity long, v array<double>")
    both = df.select("entity", F.slice("v", 2, 8).alias("now"), F.slice("v", 1, 8).alias("before"))
    got = {(r["i"], r["j"]): r["corr"] for r in find(both, "now", "before", block=5).collect()}
    assert made.value == 40
    assert len(got) == (1600 if find is association.cross_corr else 40)
    for (i, j), value in got.items():
        assert value == pytest.approx(np.corrcoef(x[i, 1:], x[j, :-1])[0, 1], abs=1e-12)


@pytest.mark.parametrize("block", [7, 64])
def test_nearest_far_from_origin(spark, block):
    """Squares of 1e14 with differences of 1e-3: products alone would lose the order and the ties."""
    rng = np.random.default_rng(2)
    x = 1e7 + rng.integers(0, 4, size=(60, 9)) / 1024
    x[20:30] = x[3]
    got = {(r["i"], r["rank"]): (r["j"], r["distance"]) for r in association.nearest(vectors(spark, x), "v", 5, block=block).collect()}
    for i in range(60):
        want = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in range(60))[:5]
        assert [got[i, r + 1] for r in range(5)] == [(j, d) for d, j in want]


def test_best_correlated_of_many_copies(spark):
    x = np.tile(np.array([[1.0, 2, 4, 3], [4, 1, 1, 5], [2, 2, 2, 2]]), (12, 1))
    got = association.top_correlated(vectors(spark, x), "v", k=3, block=5).collect()
    for i in range(36):
        mine = sorted((r["rank"], r["j"]) for r in got if r["i"] == i)
        assert [j for _, j in mine] == ([] if i % 3 == 2 else [j for j in range(i % 3, 36, 3) if j != i][:3])


def test_pairs_leave_the_task_in_parts(spark):
    df = vectors(spark, np.random.default_rng(4).random((50, 6)))
    parts = association.corr_sums(df, "v", block=10)
    assert parts.agg(F.sum("n_pairs")).first()[0] == 50 * 49 // 2
    frames = association._all_pairs("entity", True, 10)(iter([df.withColumn("side", F.lit(2)).toPandas()]))
    assert max(len(f) for f in frames) <= 100


@pytest.mark.parametrize("ordered", [True, False])
def test_files_of_pairs_hold_little_besides_scores(spark, tmp_path, ordered):
    x = np.random.default_rng(8).random((1500, 6))
    df = vectors(spark, x).orderBy(F.xxhash64("entity"))
    both = df.select("entity", F.col("v").alias("now"), F.reverse("v").alias("before"))
    pairs = association.cross_corr(both, "now", "before") if ordered else association.pairwise_corr(df, "v")
    pairs.write.parquet(str(tmp_path / "pairs"))
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "pairs").glob("*.parquet")]
    groups = [m.row_group(g) for m in files for g in range(m.num_row_groups)]
    rows, ids = sum(g.num_rows for g in groups), sum(g.column(c).total_compressed_size for g in groups for c in (0, 1))
    assert rows == (1500 * 1500 if ordered else 1500 * 1499 // 2) and ids < 0.3 * rows


def test_repeated_side_is_not_taken_for_small(spark, tmp_path):
    path = str(tmp_path / "ids")
    spark.range(4000).select("id", F.col("id").alias("code")).coalesce(1).write.parquet(path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100KB")  # the file is smaller, its 8 repeats are not
    try:
        big = spark.range(20000).select((F.col("id") % 4000).alias("id"), F.col("id").alias("row"))
        out = joins.salted_join(big, spark.read.parquet(path), ["id"], ["row"])
        assert "BroadcastHashJoin" not in executed(out)
        assert out.filter("id = code").count() == 20000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("months", [1, 2])
def test_sliding_windows_are_made_once(spark, months):
    day = dt.date(2023, 12, 30)
    days = [day + dt.timedelta(k) for k in (0, 0, 1, 2, 31, 32, 33, 60, 61, 62, 190)]
    df = spark.createDataFrame([("a", d) for d in days] + [("b", days[3]), ("b", None), (None, day)], "entity string, event_date date")
    out = periods.sliding_counts(df, months)
    assert executed(out).count("HashAggregate") == 2  # counts per day only; no sums over exploded days
    got = {(r[0], r[1]): r[2] for r in out.collect()}
    want = {}
    for k in range(191):
        start = day + dt.timedelta(k)
        at = start.month - 1 + months
        first = dt.date(start.year + at // 12, at % 12 + 1, 1)
        last = (dt.date(first.year + first.month // 12, first.month % 12 + 1, 1) - dt.timedelta(1)).day
        end = first.replace(day=min(start.day, last))
        n = sum(start <= d < end for d in days)
        if n:
            want["a", start] = n
    assert got == want | {("b", days[3]): 1, (None, day): 1}


def test_images_of_a_pixel_are_summed_before_zones(spark):
    rows = [(0.5, 0.5, 1, 2.0), (0.5, 0.5, 1, 4.0), (0.5, 0.5, 1, None), (1.5, 0.5, 1, 9.0), (0.5, 0.5, 2, None)]
    pixels = spark.createDataFrame(rows, "x double, y double, period int, value double")
    images = zonal.image_sums(pixels, ["x", "y", "period"], "value")
    assert sorted(tuple(r) for r in images.collect()) == [(0.5, 0.5, 1, 6.0, 2), (1.5, 0.5, 1, 9.0, 1)]
    weighted = images.withColumn("w", F.when(F.col("x") < 1, 0.25).otherwise(1.0))
    assert zonal.zonal_mean(weighted, ["period"], "value", "w", "images").first()["mean"] == pytest.approx((0.25 * 6 + 9) / 1.5)
