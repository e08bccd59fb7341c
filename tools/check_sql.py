"""Run registered queries next to their SQL in DuckDB and compare rows. Usage: check_sql.py [sf] [prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from cohortlens.fixtures import DRIVER_TABLES  # noqa: E402
from cohortlens.plans import catalog  # noqa: E402
from cohortlens.session import local_session  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    return f"{type(v).__name__}:{v}"


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    folder = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connect(folder)
    qs, sql = catalog.queries(), catalog.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            t = time.time()
            df = fn(spark, folder)
            got = rows(df.columns, df.collect())
            took = time.time() - t
            if name not in sql:
                print(f"ROWS {name} n={len(got)} spark={took:.2f}s")
                continue
            t = time.time()
            cur = con.execute(sql[name])
            cols = [d[0] for d in cur.description]
            want = rows(cols, cur.fetchall())
            dtook = time.time() - t
            ok = got == want and sorted(cols) == sorted(df.columns)
            bad += not ok
            print(f"{'ok  ' if ok else 'BAD '} {name} n={len(got)}/{len(want)} spark={took:.2f}s duck={dtook:.2f}s")
            if not ok:
                print("   cols", sorted(df.columns), sorted(cols))
                a, b = set(got), set(want)
                print("   only spark", list(a - b)[:2])
                print("   only sql  ", list(b - a)[:2])
        except Exception as e:  # a broken query must not hide the others
            bad += 1
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:700]}")
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
