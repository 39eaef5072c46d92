"""Compares a registered query with its oracle SQL on one data folder."""
from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def rowset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, folder: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    df = entry.queries()[name](spark, folder)
    got_cols, got = rowset(df.columns, [tuple(r) for r in df.collect()])
    if name not in entry.oracle_sql():
        return None if got else "no rows"
    cur = con.execute(entry.oracle_sql()[name])
    want_cols, want = rowset([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "no rows on both sides"
    extra, missing = Counter(got) - Counter(want), Counter(want) - Counter(got)
    if extra or missing:
        return (f"{sum(extra.values())} rows differ over {got_cols}\n   spark  {sorted(extra, key=repr)[0]}"
                f"\n   oracle {sorted(missing, key=repr)[0]}")
    return None


if __name__ == "__main__":
    from silvergrain.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:] or list(entry.queries())
    spark = local_session("8")
    con = connect(folder)
    failed = []
    for name in wanted:
        start = time.time()
        try:
            verdict = compare(spark, con, name, folder)
        except Exception as exc:  # report and go on with the next query
            verdict = f"{type(exc).__name__}: {str(exc)[:500]}"
        took = time.time() - start
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name} {took:.1f}s {verdict or ''}", flush=True)
        if verdict:
            failed.append(name)
    print(f"{len(wanted) - len(failed)} ok, failed: {failed}")
