"""Run every registered query against its DuckDB oracle and report matches.

Mirrors the driver's check: row count, column names, and an order-insensitive
hash of the values. Usage: ``python tests/check_oracles.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import datetime
import decimal
import hashlib
import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(json.dumps([norm(r[i]) for i in order], default=str) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from dxcohort.session import local_session
    spark = local_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        rows = [tuple(r) for r in df.collect()]
        cols = df.columns
        t1 = time.time()
        if name not in sqls:
            print(f"{name:45s} rows={len(rows):6d} (no oracle) {t1 - t0:5.2f}s")
            continue
        cur = con.execute(sqls[name])
        ocols = [d[0] for d in cur.description]
        orows = cur.fetchall()
        ok = (len(rows) == len(orows) and sorted(cols) == sorted(ocols)
              and digest(cols, rows) == digest(ocols, orows))
        bad += not ok
        print(f"{name:45s} rows={len(rows):6d}/{len(orows):6d} "
              f"{'OK ' if ok else 'BAD'} {t1 - t0:5.2f}s"
              + ("" if sorted(cols) == sorted(ocols) else f" cols {cols} vs {ocols}"))
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
