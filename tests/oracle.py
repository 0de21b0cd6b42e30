"""Compare a registered query with its SQL in DuckDB: columns, row count and values, in any row order."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return repr(round(f, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("|".join(cell(r[i]) for i in order) for r in data)


def compare(spark, con, q, sf_dir: str):
    """Return (ok, message, seconds)."""
    t = time.time()
    df = q.run(spark, sf_dir)
    data = [tuple(r) for r in df.collect()]
    took = time.time() - t
    cols, got = rows_of(df.columns, data)
    if q.sql is None:
        return True, f"{len(got)} rows (no SQL)", took
    res = con.execute(q.sql)
    want_cols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if cols != want_cols:
        return False, f"columns {cols} != {want_cols}", took
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}; e.g. {got[:2]} vs {want[:2]}", took
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ; e.g.\n   {bad[0][0][:300]}\n   {bad[0][1][:300]}", took
    return True, f"{len(got)} rows", took


def main(argv):
    from reelgraph.session import build_session
    from reelgraph.workload import load_all

    sf_dir = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
    registry = load_all()
    spark = build_session()
    con = duck(sf_dir)
    failed = []
    for name, q in registry.items():
        if names and not any(name == n or q.run.__module__.endswith("." + n) for n in names):
            continue
        try:
            ok, message, took = compare(spark, con, q, sf_dir)
        except Exception as e:  # report and go on
            ok, message, took = False, f"{type(e).__name__}: {str(e)[:700]}", 0.0
        print(f"{'ok ' if ok else 'BAD'} {name:32s} {took:6.2f}s {message}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
