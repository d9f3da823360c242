"""Run registered queries against their oracle SQL in DuckDB and compare the values.

usage: python tools/check_oracle.py [sf_dir] [name part ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelkit.plans import all_entries  # noqa: E402
from panelkit.plans.standins import TABLES, Tables  # noqa: E402
from panelkit.session import build_session  # noqa: E402


def plain(value):
    """One comparable form for the values of both engines."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, int):
        return value
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    bad = 0
    for name, entry in all_entries().items():
        if parts and not any(p in name for p in parts):
            continue
        begin = time.time()
        try:
            df = entry.build(Tables(spark, sf_dir))
            columns = df.columns
            got = rows_of(columns, [tuple(r) for r in df.collect()])
        except Exception as err:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: spark {type(err).__name__}: {str(err)[:600]}", flush=True)
            continue
        took = time.time() - begin
        if entry.sql is None:
            print(f"rows  {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(entry.sql)
            want_columns = [d[0] for d in cur.description]
            want = rows_of(want_columns, cur.fetchall())
        except Exception as err:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: duckdb {str(err)[:600]}", flush=True)
            continue
        if sorted(columns) != sorted(want_columns):
            bad += 1
            print(f"FAIL  {name}: columns {sorted(columns)} != {sorted(want_columns)}", flush=True)
        elif got != want:
            bad += 1
            diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
            print(f"FAIL  {name}: {len(got)} vs {len(want)} rows; {sorted(columns)}", flush=True)
            for a, b in diff:
                print(f"      spark  {a}\n      oracle {b}", flush=True)
        else:
            flag = "" if got else "  EMPTY"
            print(f"ok    {name}: {len(got)} rows {took:.1f}s{flag}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
