"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (default the sf0.1 folder) and ``BENCH_CPUS`` (default 8). Every query is run
to a sink that reads all rows and columns.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from panelkit.plans import all_queries  # noqa: E402
from panelkit.session import build_session  # noqa: E402

HEADLINE = [
    "flagship_labelled_panel",
    "agg_1_monthly_counts",
    "agg_1_weekly_counts",
    "agg_3_sliding_month_line_list",
    "agg_4_densify",
    "jon_2_left_salted_line_list",
    "jon_16_reconcile",
    "win_4_lag_frame",
    "win_9_dense_code",
    "win_18_history_vector",
    "agg_14_pairwise_corr",
    "srt_2_top_lag_correlated",
    "srt_5_nearest",
    "agg_22_item_metrics",
    "agg_20_report_averages",
    "agg_28_pixel_composite",
    "agg_29_zonal_median",
    "agg_30_fixed_histogram",
    "cal_5_lookback_histogram",
    "ml_9_seasonal_forecast",
    "ml_10_partial_pooling",
    "ml_13_lookback_sweep",
    "ml_14_forward_selection",
    "ml_1_robust_scaling",
    "ml_2_global_binary_classifier",
    "ml_7_hierarchical_refinement",
    "ml_15_successive_halving",
    "spl_2_expanding_folds",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries["agg_4_densify"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's code paths
    times: dict[str, float] = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(found.group(1)) if found else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
