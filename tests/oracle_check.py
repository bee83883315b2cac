"""Spark result against the DuckDB oracle: row count, column names, values.

Mirrors the driver's check: columns are compared by sorted name and rows as
an order-insensitive multiset.  Run as a script for a per-query report:

    python tests/oracle_check.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records), sorted(columns)


def compare(spark, con, name: str, sf_dir: str, query, sql: str) -> dict:
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    con.execute(f"CREATE OR REPLACE TEMP VIEW checked AS {sql}")  # a statement must also work as a view
    res = con.execute("SELECT * FROM checked")
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    t2 = time.time()
    s_norm, s_cols = rows_of(sdf.columns, s_rows)
    d_norm, d_cols_sorted = rows_of(d_cols, d_rows)
    out = {
        "name": name,
        "spark_rows": len(s_rows),
        "oracle_rows": len(d_rows),
        "columns_match": s_cols == d_cols_sorted,
        "values_match": s_norm == d_norm,
        "spark_s": round(t1 - t0, 2),
        "oracle_s": round(t2 - t1, 2),
    }
    if not out["columns_match"]:
        out["spark_cols"], out["oracle_cols"] = s_cols, d_cols_sorted
    if out["columns_match"] and not out["values_match"]:
        sa, da = set(s_norm), set(d_norm)
        out["only_spark"] = sorted(sa - da)[:3]
        out["only_oracle"] = sorted(da - sa)[:3]
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as entry
    from tillscope.session import local_session

    spark = local_session(extra={"spark.ui.showConsoleProgress": "false"})
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = argv[2:] or list(qs)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf_dir, qs[n], sqls[n])
        except Exception as e:  # report and continue
            r = {"name": n, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        ok = r.get("columns_match") and r.get("values_match") and r["spark_rows"] == r["oracle_rows"]
        bad += not ok
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
