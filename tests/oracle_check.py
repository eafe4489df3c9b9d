"""Compare registered queries with their SQL on DuckDB, value by value.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else float(repr(value)) + 0.0
    if hasattr(value, "tzinfo") and getattr(value, "tzinfo", None) is not None:
        return value.replace(tzinfo=None)
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda t: [(v is None, str(v)) for v in t])


def compare(spark, con, name: str, sf_dir: str) -> str:
    from __spark_entry__ import oracle_sql, queries

    started = time.time()
    df = queries()[name](spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    spark_seconds = time.time() - started
    sql = oracle_sql().get(name)
    if sql is None:
        return f"rows-only {len(mine)} rows {spark_seconds:.1f}s"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"MISMATCH columns {set(columns) ^ set(df.columns)}"
    if len(mine) != len(theirs):
        return f"MISMATCH rows {len(mine)} vs {len(theirs)}"
    off = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if off:
        names = sorted(columns)
        diff = [(n, x, y) for n, x, y in zip(names, *off[0]) if x != y]
        return f"MISMATCH {len(off)} of {len(mine)} rows, first: {diff}"
    kinds = [
        (n, type(x).__name__, type(y).__name__)
        for a, b in zip(mine[:1], theirs[:1]) for n, x, y in zip(sorted(columns), a, b)
        if x is not None and type(x) is not type(y)
    ]
    return f"ok {len(mine)} rows {spark_seconds:.1f}s" + (f" TYPES {kinds}" if kinds else "")


if __name__ == "__main__":
    from tillcast.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    session, duck = local_session("8"), connect(folder)
    from __spark_entry__ import queries

    failed = 0
    for key in args or queries():
        try:
            outcome = compare(session, duck, key, folder)
        except Exception as problem:  # keep going, report at the end
            outcome = f"ERROR {type(problem).__name__}: {str(problem)[:600]}"
        failed += not outcome.startswith(("ok", "rows-only"))
        print(f"{key:28s} {outcome}", flush=True)
    print(f"{failed} failed")
