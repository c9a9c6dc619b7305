"""Run every registered query on Spark and its oracle SQL on DuckDB; compare like the driver.

usage: python scripts/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from lacuna.plans.registry_more import QUERIES  # noqa: E402
from lacuna.session import local_session  # noqa: E402
from lacuna.sources.testdata import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        return repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if type(v).__name__ == "date" else v.isoformat()
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name in names:
        fn, sql = QUERIES[name]
        t0 = time.time()
        try:
            df = fn(spark, sf)
            cols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        dt = time.time() - t0
        if sql is None:
            print(f"{name:32s} rows={len(srows)} (no oracle) {dt:.1f}s")
            continue
        try:
            cur = con.execute(sql)
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} ORACLE ERROR {str(e)[:400]}")
            bad += 1
            continue
        h1, l1 = digest(cols, srows)
        h2, l2 = digest(ocols, orows)
        ok = sorted(cols) == sorted(ocols) and len(srows) == len(orows) and h1 == h2
        print(f"{name:32s} rows={len(srows)}/{len(orows)} cols_ok={sorted(cols) == sorted(ocols)} match={ok} {dt:.1f}s")
        if not ok:
            bad += 1
            if sorted(cols) != sorted(ocols):
                print("   spark cols", cols, "\n   oracle cols", ocols)
            diff1 = [x for x in l1 if x not in set(l2)][:3]
            diff2 = [x for x in l2 if x not in set(l1)][:3]
            print("   spark-only", diff1, "\n   oracle-only", diff2)
    print("FAILED", bad)


if __name__ == "__main__":
    main()
