"""Run registered queries against their SQL; as a script: `python tests/oracle.py <sf_dir> [name ...]`."""
from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def _cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def compare(spark, sf_dir, fn, sql):
    """(problem or None, rows, seconds)"""
    start = time.time()
    df = fn(spark, sf_dir)
    got, got_cols = _rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return None, len(got), took
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    want, want_cols = _rows(rel.columns, rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}", len(got), took
    if len(got) != len(want):
        missing = [x for x in want if x not in got][:2]
        extra = [x for x in got if x not in want][:2]
        return f"rows {len(got)} vs {len(want)}; missing {missing}; extra {extra}", len(got), took
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    kinds = {c: (type(a).__name__, type(b).__name__) for c, a, b in zip(got_cols, got[0], want[0])
             if a is not None and b is not None and type(a) is not type(b)} if got else {}
    if bad:
        return f"{len(bad)} rows differ of {len(got)}: spark {bad[0][0]} | sql {bad[0][1]} {kinds}", len(got), took
    return (f"types {kinds}" if kinds else None), len(got), took


if __name__ == "__main__":
    import __spark_entry__ as e
    from loadwarden.session import local_session

    spark = local_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    oracles = e.oracle_sql()
    failed = []
    for name, fn in e.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            problem, n, took = compare(spark, sys.argv[1], fn, oracles.get(name))
        except Exception as exc:
            problem, n, took = f"{type(exc).__name__}: {str(exc)[:600]}", -1, 0.0
        print(f"{'ok  ' if problem is None else 'BAD '} {name:28s} rows={n:<7d} {took:6.2f}s "
              f"{'' if name in oracles else '(no sql) '}{problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
