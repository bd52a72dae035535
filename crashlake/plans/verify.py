"""Run catalog queries in Spark and their oracle SQL in DuckDB, compare results.

Comparison is order-insensitive: same column names, same row count, same
multiset of rows (floats compared after rounding to 9 places).
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from crashlake.sources.tables import TABLES


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if hasattr(v, "is_integer") and not isinstance(v, bool):  # Decimal
        try:
            return round(float(v), 9)
        except Exception:
            return str(v)
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf: str, names: list[str] | None = None, verbose: bool = True) -> dict[str, str]:
    from crashlake.plans.catalog import QUERIES
    from crashlake.plans.oracle import oracle_sql

    oracle = oracle_sql()
    con = duck(sf)
    out = {}
    for name, q in QUERIES.items():
        if names and name not in names:
            continue
        if name not in oracle:
            out[name] = "no-oracle"
            continue
        t = time.time()
        out[name] = _compare_one(spark, con, q, oracle[name], sf)
        if verbose:
            print(f"{name}: {out[name][:700]} ({time.time() - t:.1f}s)", flush=True)
    return out


def _compare_one(spark, con, q, sql, sf) -> str:
    try:
        df = q(spark, sf)
        s_cols = df.columns
        s_rows = [tuple(r) for r in df.collect()]
    except Exception as e:  # noqa: BLE001
        return f"spark-error: {str(e)[:600]}"
    try:
        res = con.execute(sql)
        d_cols = [c[0] for c in res.description]
        d_rows = res.fetchall()
    except Exception as e:  # noqa: BLE001
        return f"duck-error: {str(e)[:600]}"
    if True:
        if sorted(s_cols) != sorted(d_cols):
            return f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
        if len(s_rows) != len(d_rows):
            return f"rows differ: spark={len(s_rows)} duck={len(d_rows)}"
        a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
        if a == b:
            return "match"
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return f"values differ ({len(s_rows)} rows), e.g. spark={diff[0][0]} duck={diff[0][1]}"


if __name__ == "__main__":
    from crashlake.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    res = compare(local_session(), sf, sys.argv[2:] or None)
    bad = {k: v for k, v in res.items() if v not in ("match", "no-oracle")}
    print(f"{len(res) - len(bad)}/{len(res)} ok; failing: {sorted(bad)}")
