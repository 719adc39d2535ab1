"""Runs registered queries next to their SQL and compares names, rows and values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


spent: dict[str, float] = {}


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return repr(int(v)) if math.isfinite(v) and v == int(v) else repr(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark, con, fn, sql, sf_dir):
    began = time.time()
    df = fn(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent["spark"] = time.time() - began
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}", len(mine[1])
    if mine[1] != theirs[1]:
        left, right = set(mine[1]), set(theirs[1])
        return (
            f"rows {len(mine[1])} / {len(theirs[1])}; only Spark {sorted(left - right)[:3]}; only SQL {sorted(right - left)[:3]}",
            len(mine[1]),
        )
    return None, len(mine[1])


def main(argv):
    from supplyscope.registry import all_oracle_sql, all_queries
    from supplyscope.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(), duck(sf_dir)
    queries, oracle = all_queries(), all_oracle_sql()
    names = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    bad = 0
    for name in names:
        began = time.time()
        try:
            if name in oracle:
                problem, n = differences(spark, con, queries[name], oracle[name], sf_dir)
            else:
                problem, n = None, queries[name](spark, sf_dir).count()
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        bad += problem is not None
        kind = "sql " if name in oracle else "rows"
        print(f"{'BAD ' if problem else 'ok  '} {kind} {name:36s} {n:8d} rows {spent.get('spark', 0):6.2f}s of {time.time() - began:6.2f}s {problem or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
