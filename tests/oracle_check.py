"""Compares every registered query with its SQL in DuckDB: ``python tests/oracle_check.py [sf] [name...]``."""

from __future__ import annotations

import hashlib
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry
from litflow.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def cell(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(0.0 if v == 0 else v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def normal(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    spark = local_session("oracle-check", "8")
    bad = []
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            got = normal(df.columns, [tuple(r) for r in df.collect()])
        except Exception as e:
            bad.append(name)
            print(f"FAIL {name}: {type(e).__name__}: {str(e)[:600]}", flush=True)
            continue
        t1 = time.time()
        if name not in oracles:
            print(f"rows {name}: {len(got[1])} rows {t1 - t0:.1f}s", flush=True)
            if not got[1]:
                bad.append(name)
            continue
        try:
            cur = con.execute(oracles[name])
            want = normal([d[0] for d in cur.description], cur.fetchall())
        except Exception as e:
            bad.append(name)
            print(f"FAIL {name}: oracle {str(e)[:600]}", flush=True)
            continue
        t2 = time.time()
        if got == want and got[1]:
            digest = hashlib.md5(repr(got).encode()).hexdigest()[:8]
            print(f"ok   {name}: {len(got[1])} rows {digest} spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s", flush=True)
            continue
        bad.append(name)
        print(f"DIFF {name}: spark {len(got[1])} rows, sql {len(want[1])} rows", flush=True)
        if got[0] != want[0]:
            print("   columns", got[0], want[0])
            continue
        a, b = set(got[1]), set(want[1])
        for r in sorted(a - b)[:4]:
            print("   spark only", str(r)[:500])
        for r in sorted(b - a)[:4]:
            print("   sql only  ", str(r)[:500])
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
