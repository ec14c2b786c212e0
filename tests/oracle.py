"""Run registered queries beside their SQL in DuckDB and compare every value.

    python tests/oracle.py [sf] [slug-prefix ...]
"""

from __future__ import annotations

import os
import sys
import threading
import time
from datetime import date, datetime

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SQL_SECONDS = 60
TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return ("f", 0.0 if v == 0 else v)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, (date, datetime)):
        return ("d", str(v))
    return ("n", "") if v is None else (type(v).__name__, str(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, fn, sql):
    df = fn(spark, folder)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    watch = threading.Timer(SQL_SECONDS, con.interrupt)
    watch.start()
    try:
        cur = con.execute(sql)
    finally:
        watch.cancel()
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows, want {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        shown = "\n      ".join(f"{g}\n   != {w}" for g, w in bad[:3])
        return f"{len(bad)} of {len(got)} rows differ:\n      {shown}"
    return None


def main(argv):
    sf = argv[0] if argv else "0.01"
    prefixes = tuple(argv[1:])
    from reachworks.plans import catalog
    from reachworks.session import local_session

    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(folder)
    failed = 0
    for slug, fn in catalog.QUERIES.items():
        if prefixes and not slug.startswith(prefixes):
            continue
        start = time.time()
        watch = threading.Timer(150, spark.sparkContext.cancelAllJobs)
        watch.start()
        try:
            if slug in catalog.ORACLE:
                why = compare(spark, con, folder, fn, catalog.ORACLE[slug])
            else:
                n = len(fn(spark, folder).collect())
                why = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:400]}"
        watch.cancel()
        failed += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {time.time() - start:6.1f}s {slug}{'' if slug in catalog.ORACLE else ' (rows only)'}"
              f"{'' if why is None else ': ' + why}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
