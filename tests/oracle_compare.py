"""Run a registered query in Spark and its oracle SQL in DuckDB, then compare
row count, column names and an order-insensitive digest of the values
(doubles rounded to 6 places), the way the round driver does."""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import os
import sys

import duckdb

sys.path.insert(0, "/root/repo")

from kvlens.sources.tables import DRIVER_TABLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, query, sf_dir, show=5):
    sdf = query.build(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(_norm(x) for x in r) for r in sdf.collect()]
    res = con.execute(query.oracle)
    o_cols = [d[0] for d in res.description]
    o_rows = [tuple(_norm(x) for x in r) for r in res.fetchall()]
    ok_cols = sorted(s_cols) == sorted(o_cols)
    if ok_cols:
        idx = [o_cols.index(c) for c in s_cols]
        o_rows = [tuple(r[i] for i in idx) for r in o_rows]
    s_sorted = sorted(s_rows, key=repr)
    o_sorted = sorted(o_rows, key=repr)
    ok = ok_cols and len(s_rows) == len(o_rows) and s_sorted == o_sorted
    detail = ""
    if not ok:
        sset, oset = set(map(repr, s_sorted)), set(map(repr, o_sorted))
        only_s = [r for r in s_sorted if repr(r) not in oset][:show]
        only_o = [r for r in o_sorted if repr(r) not in sset][:show]
        detail = (f"cols spark={s_cols} oracle={o_cols}\n rows spark={len(s_rows)} oracle={len(o_rows)}\n"
                  f" only spark: {only_s}\n only oracle: {only_o}")
    return ok, len(s_rows), detail


def main(argv):
    sys.path.insert(0, "/root/repo")
    from kvlens.plans import load_all
    from kvlens.session import local_session
    sf_dir = "/root/testdata/sf0.01"
    names = argv or None
    spark = local_session()
    con = duck(sf_dir)
    qs = load_all()
    bad = 0
    for name, query in qs.items():
        if names and name not in names:
            continue
        if query.oracle is None:
            n = len(query.build(spark, sf_dir).collect())
            print(f"ROWS  {name}: {n} rows (no oracle)")
            continue
        try:
            ok, n, detail = compare(spark, con, name, query, sf_dir)
        except Exception as e:  # report and continue
            ok, n, detail = False, -1, f"{type(e).__name__}: {str(e)[:2000]}"
        bad += not ok
        print(f"{'OK   ' if ok else 'FAIL '} {name}: {n} rows")
        if detail:
            print(detail)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
