"""Run registered queries in Spark and their oracle SQL in DuckDB; compare results.

Usage: python tools/oracle_check.py [--sf DIR] [name-or-prefix ...]
Compares row count, column names and the multiset of rows (order-insensitive),
values normalised the same way on both sides.
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tessera.plans.registry import TABLES, load_all  # noqa: E402
from tessera.session import build_session  # noqa: E402


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return format(v + 0.0, ".9g")
    if hasattr(v, "item") and not isinstance(v, (list, tuple, dict)):
        try:
            return norm(v.item())
        except Exception:
            pass
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(norm(x) for x in list(v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in records)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    queries, oracle = load_all()
    names = [n for n in queries if not a.names or any(n == x or n.startswith(x) for x in a.names)]
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            sdf = queries[n](spark, a.sf)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:
            bad += 1
            print(f"SPARK-ERR {n}: {type(e).__name__}: {str(e)[:400]}")
            traceback.print_exc(limit=3)
            continue
        ts = time.time() - t0
        if n not in oracle:
            print(f"rows-only {n}: {len(srows)} rows  ({ts:.1f}s)")
            continue
        try:
            cur = con.execute(oracle[n])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:
            bad += 1
            print(f"SQL-ERR {n}: {str(e)[:400]}")
            continue
        if sorted(scols) != sorted(ocols):
            bad += 1
            print(f"COLS {n}: spark={scols} sql={ocols}")
            continue
        sr, orr = rows_of(scols, srows), rows_of(ocols, orows)
        if sr == orr:
            print(f"ok {n}: {len(sr)} rows ({ts:.1f}s)")
        else:
            bad += 1
            print(f"DIFF {n}: spark {len(sr)} rows vs sql {len(orr)}")
            ss, oo = set(sr), set(orr)
            for r in list(ss - oo)[:3]:
                print("   spark-only", r)
            for r in list(oo - ss)[:3]:
                print("   sql-only  ", r)
    print(f"{len(names) - bad}/{len(names)} passed")
    spark.stop()


if __name__ == "__main__":
    main()
