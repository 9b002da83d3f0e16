"""Run bound queries in Spark and their SQL in DuckDB and compare the rows.

python compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

from bindings import ORACLES, QUERIES
from isoframe.session import checkpoint_dir, local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)):
        f = float(v)
        return "nan" if math.isnan(f) else f"{f:.9g}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf):
    started = time.time()
    df = QUERIES[name](spark, sf)
    mine = rows_of(df.columns, df.collect())
    took = time.time() - started
    if name not in ORACLES:
        return len(mine) > 0, f"{len(mine)} rows, no SQL", took
    res = con.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    want = rows_of(cols, res.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}", took
    if mine != want:
        extra = sorted(set(mine) - set(want))[:3]
        missing = sorted(set(want) - set(mine))[:3]
        return False, f"{len(mine)} vs {len(want)} rows; only Spark {extra}; only SQL {missing}", took
    return len(mine) > 0, f"{len(mine)} rows", took


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{args.sf}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    spark = local_session(cores="8")
    checkpoint_dir(spark)
    bad = 0
    for name in args.names or QUERIES:
        try:
            ok, note, took = compare(spark, con, name, args.sf)
        except Exception as error:  # noqa: BLE001
            ok, note, took = False, f"{type(error).__name__}: {str(error)[:600]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {took:6.2f}s {note}", flush=True)
    spark.stop()
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
