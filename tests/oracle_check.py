"""Run registered queries in Spark and their SQL twins in DuckDB; compare.

Mirrors the driver's gate: row count, column names, and an
order-insensitive hash of the values (doubles rounded).
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        r = round(v, digits)
        return repr(0.0 if r == 0 else r)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x, digits) for x in v) + "]"
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def fingerprint(pdf: pd.DataFrame, digits: int = 6):
    cols = sorted(pdf.columns)
    rows = sorted("|".join(_norm(r[c], digits) for c in cols) for r in pdf.to_dict("records"))
    return cols, len(rows), hashlib.sha256("\n".join(rows).encode()).hexdigest(), rows


def compare(spark, name, build, sql, sf_dir, con=None, digits=6):
    con = con or duck(sf_dir)
    t0 = time.time()
    sp = build(spark, sf_dir).toPandas()
    t1 = time.time()
    dk = con.execute(sql).df()
    a, b = fingerprint(sp, digits), fingerprint(dk, digits)
    ok = a[0] == b[0] and a[1] == b[1] and a[2] == b[2]
    detail = ""
    if not ok:
        if a[0] != b[0]:
            detail = f"cols spark={a[0]} duck={b[0]}"
        elif a[1] != b[1]:
            detail = f"rows spark={a[1]} duck={b[1]}"
        else:
            diff = [(x, y) for x, y in zip(a[3], b[3]) if x != y][:3]
            detail = f"values differ e.g. {diff}"
    return ok, a[1], t1 - t0, detail


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from triptopics.session import get_spark

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = get_spark()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, build in qs.items():
        if only and name not in only:
            continue
        if name not in sqls:
            t0 = time.time()
            try:
                n = build(spark, sf_dir).count()
                print(f"ROWS  {name:32s} rows={n} {time.time()-t0:.1f}s", flush=True)
            except Exception as exc:  # noqa: BLE001
                bad += 1
                print(f"BAD   {name:32s} ERROR {type(exc).__name__}: {str(exc)[:200]}", flush=True)
            continue
        try:
            ok, n, secs, detail = compare(spark, name, build, sqls[name], sf_dir, con)
        except Exception as exc:  # noqa: BLE001
            ok, n, secs, detail = False, -1, 0.0, f"ERROR {type(exc).__name__}: {str(exc)[:300]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'}   {name:32s} rows={n} {secs:.1f}s {detail}", flush=True)
    print("mismatches:", bad)
