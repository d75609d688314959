"""Run registered queries against their SQL twins in DuckDB.

    python tests/compare.py [key ...] | [prefix*] | [@module,module]
"""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return f"b{int(v)}"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"f{v!r}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return f"{type(v).__name__[0]}{v}"


def table_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, key, build, sql, sf_dir=SF):
    """Returns (ok, message)."""
    t = time.time()
    df = build(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return bool(got), f"{len(got)} rows only, {took:.1f}s"
    t = time.time()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    duck = time.time() - t
    c1, r1 = table_rows(df.columns, got)
    c2, r2 = table_rows(names, want)
    if c1 != c2:
        return False, f"columns {c1} != {c2}"
    if r1 == r2:
        return True, f"{len(r1)} rows, {took:.1f}s vs {duck:.1f}s" + ("" if r1 else " EMPTY")
    s1, s2 = set(r1), set(r2)
    bad1, bad2 = [x for x in r1 if x not in s2], [x for x in r2 if x not in s1]
    return False, f"rows {len(r1)} vs {len(r2)}, differing {len(bad1)}/{len(bad2)}\n   cols  {c1}\n   spark {bad1[:3]}\n   sql   {bad2[:3]}"


def main(argv):
    import __spark_entry__ as e
    from shelfspark.session import build_session

    spark = build_session("compare")
    import logging

    logging.disable(logging.ERROR)
    con = connect()
    queries, oracles = e.queries(), e.oracle_sql()
    keys = [k for k in queries if not argv or k in argv or any(a.endswith("*") and k.startswith(a[:-1]) for a in argv)]
    if argv and argv[0].startswith("@"):
        from shelfspark.plans import registry

        keys = [k for k in registry.OWNER if registry.OWNER[k] in argv[0][1:].split(",")]
    bad = []
    for k in keys:
        try:
            ok, msg = compare(spark, con, k, queries[k], oracles.get(k))
        except Exception as ex:  # report and go on
            ok, msg = False, f"{type(ex).__name__}: {str(ex)[:500]}"
        if not ok:
            bad.append(k)
        print(("ok   " if ok else "FAIL ") + f"{k}: {msg}", flush=True)
    print(f"{len(keys) - len(bad)}/{len(keys)} match; bad: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
