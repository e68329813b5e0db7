"""Run queries against their SQL: ``python tests/compare.py [names...] [--sf 0.01]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 9) + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def oracle_rows(con, sql):
    rel = con.sql(sql)
    return rows_of(rel.columns, rel.fetchall())


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from quarrystone.session import local_session

    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connect(folder)
    sqls = oracle_sql()
    bad = 0
    names = [n for n in queries() if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    for name in names:
        fn = queries()[name]
        t0 = time.time()
        try:
            df = fn(spark, folder)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: spark error {str(e)[:600]}", flush=True)
            continue
        took = time.time() - t0
        if name not in sqls:
            print(f"rows {name}: {len(got[1])} rows {took:.1f}s", flush=True)
            continue
        try:
            t0 = time.time()
            want = oracle_rows(con, sqls[name])
            dt = time.time() - t0
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: sql error {str(e)[:600]}", flush=True)
            continue
        if got == want:
            print(f"ok   {name}: {len(got[1])} rows {took:.1f}s sql {dt:.1f}s", flush=True)
            continue
        bad += 1
        print(f"FAIL {name}: columns {got[0]} vs {want[0]}; rows {len(got[1])} vs {len(want[1])}")
        gs, ws = set(got[1]), set(want[1])
        for r in [r for r in got[1] if r not in ws][:3]:
            print("   spark only", str(r)[:700])
        for r in [r for r in want[1] if r not in gs][:3]:
            print("   sql only  ", str(r)[:700], flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
