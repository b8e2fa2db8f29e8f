"""Run registered queries and compare each with its SQL text in DuckDB: check_queries.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from reliefgrid.plans import oracles, queries  # noqa: E402
from reliefgrid.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.9g}" if value else "0"
    if isinstance(value, bool) or value is None:
        return str(value)
    if hasattr(value, "as_integer_ratio"):
        return f"{float(value):.9g}" if value else "0"
    return str(value)


def frame(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(norm(row[i]) for i in order) for row in rows])


def compare(spark, con, name, plan, sql, sf_dir):
    start = time.time()
    df = plan(spark, sf_dir)
    mine = frame(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return len(mine[1]) > 0, took, f"rows={len(mine[1])} (no sql)"
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    names = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date"}
    odd = [f"{c}:{t}/{kinds.get(c)}" for c, t in df.dtypes if names.get(kinds.get(c)) != t]
    cursor = con.execute(sql)
    theirs = frame([d[0] for d in cursor.description], cursor.fetchall())
    if mine == theirs:
        return True, took, f"rows={len(mine[1])}" + (f" TYPES {odd}" if odd else "")
    if mine[0] != theirs[0]:
        return False, took, f"columns {mine[0]} != {theirs[0]}"
    a, b = set(mine[1]), set(theirs[1])
    return False, took, f"rows {len(mine[1])}/{len(theirs[1])}\n  spark only: {sorted(a - b)[:3]}\n  sql only:   {sorted(b - a)[:3]}"


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def main():
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session("check", "local[4]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g")
    con, sql, bad = connect(sf_dir), oracles(), []
    for name, plan in queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            good, took, note = compare(spark, con, name, plan, sql.get(name), sf_dir)
        except Exception as error:  # report every query, also the broken ones
            good, took, note = False, 0.0, f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{'ok  ' if good else 'FAIL'} {took:6.2f}s {name} {note}", flush=True)
        if not good:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
