"""Runs queries beside their SQL in DuckDB. ``python tests/oracle.py FOLDER NAME...``"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


UNCOMPARED = "no SQL"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "as_tuple"):
        return f"{float(v):.6g}"
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr), sorted(columns)


def connect(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}{'/*.parquet' if os.path.isdir(f'{folder}/{f}') else ''}'")
    return c


def compare(spark, folder, name, f, sql):
    """None, or what differs; and the number of rows. Without SQL there is nothing to compare: ``UNCOMPARED`` and the rows."""
    df = f(spark, folder)
    got, names = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return UNCOMPARED, len(got)
    cur = connect(folder).execute(sql)
    want, wnames = rows([d[0] for d in cur.description], cur.fetchall())
    if names != wnames:
        return f"columns {names} and {wnames}", len(got)
    if got != want:
        g, w = set(map(repr, got)), set(map(repr, want))
        return f"{len(got)} and {len(want)} rows; only here {sorted(g - w)[:4]}, only in SQL {sorted(w - g)[:4]}", len(got)
    return None, len(got)


if __name__ == "__main__":
    import __spark_entry__ as e
    from tidemark.session import build

    spark = build(master="local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = e.queries(), e.oracle_sql()
    names = [q for q in qs if any(q == x or (x.endswith("*") and q.startswith(x[:-1])) for x in sys.argv[2:])] if len(sys.argv) > 2 else list(qs)
    for n in names:
        t = time.time()
        try:
            bad, k = compare(spark, sys.argv[1], n, qs[n], sqls.get(n))
            print(f"{'OK  ' if not bad else 'RAN ' if bad == UNCOMPARED else 'DIFF'} {n}: {k} rows, {time.time() - t:.1f} s {bad or ''}", flush=True)
        except Exception as x:
            print(f"FAIL {n}: {str(x)[:1500]}", flush=True)
