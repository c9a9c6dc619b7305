"""Driver-style check: load __spark_entry__.py by path, run entry(), every queries() callable and its
oracle_sql() on DuckDB, and compare. Run it from any folder to confirm the workers can import the package.

usage: python /path/to/scripts/check_entry.py [sf_dir]
"""

from __future__ import annotations

import hashlib
import importlib.util
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        return repr(round(v, 6))
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").getOrCreate())
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(REPO, "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    print("entry rows", len(entry.entry(spark).collect()))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    t0 = time.time()
    for name, fn in queries.items():
        try:
            df = fn(spark, sf)
            rows = [tuple(r) for r in df.collect()]
            if name not in oracle:
                print(f"{name:32s} rows={len(rows)} (no oracle)")
                continue
            cur = con.execute(oracle[name])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
            ok = (sorted(df.columns) == sorted(ocols) and len(rows) == len(orows)
                  and _digest(df.columns, rows) == _digest(ocols, orows))
        except Exception as e:  # noqa: BLE001
            ok = False
            print(f"{name:32s} ERROR {str(e)[:200]}")
        if not ok:
            bad += 1
            print(f"{name:32s} MISMATCH")
    print(f"mismatches {bad} of {len(queries)} in {time.time() - t0:.1f}s")


if __name__ == "__main__":
    main()
