"""Run registered queries next to their SQL in DuckDB and compare all rows.

Usage: python tests/compare.py SF_DIR [name-part ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(repr(v)) + 0.0
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v if isinstance(v, str) else str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted([tuple(_cell(row[i]) for i in order) for row in rows], key=repr)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def run_sql(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return canonical(names, cur.fetchall())


def run_spark(df):
    return canonical(df.columns, [tuple(row) for row in df.collect()])


def differences(a, b, limit=4):
    (an, ar), (bn, br) = a, b
    if an != bn:
        return f"columns {an} != {bn}"
    if len(ar) != len(br):
        return f"rows {len(ar)} != {len(br)}"
    bad = [(x, y) for x, y in zip(ar, br) if x != y]
    if bad:
        return f"{len(bad)} of {len(ar)} rows differ, e.g. " + " | ".join(
            f"{x} <> {y}" for x, y in bad[:limit])
    return None


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session

    sf, parts = argv[0], argv[1:]
    spark, con = make_session(), connect(sf)
    sqls, failed = oracle_sql(), []
    for name, fn in queries().items():
        group = fn.__closure__[0].cell_contents.__module__.rsplit(".", 1)[-1]
        if parts and not any(p in name or p == f"@{group}" for p in parts):
            continue
        start = time.time()
        try:
            got = run_spark(fn(spark, sf))
            took = time.time() - start
            problem = differences(got, run_sql(con, sqls[name])) if name in sqls else None
        except Exception as exc:  # report and go on with the next query
            took, problem, got = time.time() - start, f"{type(exc).__name__}: {str(exc)[:700]}", (0, [])
        mark = "FAIL" if problem else ("ok" if name in sqls else "rows")
        print(f"{mark:5}{name:36}{took:7.2f}s {len(got[1]):8} rows  {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
