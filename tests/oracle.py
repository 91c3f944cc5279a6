"""Run registered queries next to their oracle SQL: ``python tests/oracle.py [name-or-module-part ...]``."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from curatrix.plans.catalog import oracle_sql, queries  # noqa: E402
from curatrix.plans.frames import BASE_TABLES  # noqa: E402
from curatrix.plans.registry import QUERIES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}".rstrip("0").rstrip(".").replace("-0", "0" if v == 0 else "-0")
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return repr(v)


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, sf_dir):
    df = queries()[name](spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    sql = oracle_sql().get(name)
    if sql is None:
        return None, f"{len(got[1])} rows, no oracle"
    cur = con.execute(sql)
    want = table([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} vs {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        extra, miss = sorted(a - b)[:3], sorted(b - a)[:3]
        return False, f"rows {len(got[1])} vs {len(want[1])}\n   cols {got[0]}\n   spark only {extra}\n   oracle only {miss}"
    return True, f"{len(got[1])} rows"


if __name__ == "__main__":
    from curatrix.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("oracle", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    want = sys.argv[1:]
    skip = os.environ.get("SKIP", "").split(",") if os.environ.get("SKIP") else []
    bad = 0
    for n, q in QUERIES.items():
        if n in skip or want and not any(w in n or w in q.run.__module__ for w in want):
            continue
        t = time.time()
        try:
            ok, msg = compare(spark, con, n, sf)
        except Exception as err:  # report and go on
            ok, msg = False, f"{type(err).__name__}: {str(err)[:350]}"
        bad += ok is False
        print(f"{'ok  ' if ok else 'ROWS' if ok is None else 'FAIL'} {n:34s} {time.time() - t:5.2f}s {msg}", flush=True)
    print(f"{bad} failures")
    spark.stop()
