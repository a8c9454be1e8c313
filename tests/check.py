"""Side-by-side run of the registered queries and their SQL. ``python tests/check.py [folder] [name ...]``"""

from __future__ import annotations

import datetime
import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(row[i]) for i in order) for row in rows)


def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def compare(spark, con, run, sql, folder):
    """'' when both sides agree, else what differs."""
    df = run(spark, folder)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if got[1] else "no rows"
    cursor = con.execute(sql)
    want = canonical([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, expected {len(want[1])}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"values differ: spark {sorted(a - b)[:2]} sql {sorted(b - a)[:2]} ({len(a - b)})"
    return "" if got[1] else "both empty"


if __name__ == "__main__":
    from gopmill.plans import all_queries
    from gopmill.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(all_queries.QUERIES)
    spark, con = local_session(), duck(folder)
    bad = 0
    for name in names:
        began = time.time()
        try:
            verdict = compare(spark, con, all_queries.QUERIES[name], all_queries.ORACLES.get(name), folder)
        except Exception as error:  # noqa: BLE001 - report and go on
            verdict = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(verdict)
        kind = "sql " if name in all_queries.ORACLES else "rows"
        print(f"{'ok  ' if not verdict else 'FAIL'} {kind} {name} {time.time() - began:.1f}s {verdict}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
