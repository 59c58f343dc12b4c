"""Compare registered queries with their SQL twins: python tests/oracle_check.py [sf] [name-prefix…]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from verdictframe.catalog.views import TABLES  # noqa: E402
from verdictframe.session import local_session  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return round(value, 5) + 0.0
    if isinstance(value, bool):
        return value
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26]
    return value


def kind(value):
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    return type(value).__name__


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)), [cols[i] for i in order]


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return ("rows-only", f"{len(got)} rows", took)
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    a, ca = rows_of(df.columns, got)
    b, cb = rows_of(want_cols, want)
    if ca != cb:
        return ("FAIL", f"columns {sorted(set(ca) ^ set(cb))}", took)
    if len(a) != len(b):
        return ("FAIL", f"rows {len(a)} vs {len(b)}; first spark {a[:2]} duck {b[:2]}", took)
    for x, y in zip(a, b):
        for c, u, v in zip(ca, x, y):
            same = u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) < 2e-5)
            if not same:
                return ("FAIL", f"col {c}: spark {u!r} duck {v!r}\n   S {x}\n   D {y}", took)
            if u is not None and kind(u) != kind(v):
                return ("FAIL", f"type of {c}: {kind(u)} vs {kind(v)}", took)
    if not a:
        return ("EMPTY", "no rows", took)
    return ("ok", f"{len(a)} rows", took)


def main(argv):
    sf = argv[0] if argv else "0.01"
    prefixes = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), duck(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            status, detail, took = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            status, detail, took = "ERROR", f"{type(exc).__name__}: {str(exc)[:700]}", 0.0
        if status not in ("ok", "rows-only"):
            bad += 1
        if status != "ok" or took > 3:
            print(f"{status:9s} {name} {took:.1f}s {detail}", flush=True)
    print(f"{bad} problem(s)")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
