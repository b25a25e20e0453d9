"""Run registered queries and their SQL side by side: tools/compare.py [sf_dir] [name ...]."""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

from corpusloom.catalog import QUERIES, SQL
from corpusloom.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in rows], key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("compare", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = []
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf)
            got = rows_of(df.columns, df.collect())
            t1 = time.time()
            if name not in SQL:
                print(f"rows  {name}: {len(got)} rows {t1-t0:.1f}s e.g. {str(got[0])[:150] if got else None}")
                if not got: bad.append(name)
                continue
            cur = con.execute(SQL[name])
            cols = [d[0] for d in cur.description]
            want = rows_of(cols, cur.fetchall())
            ok = sorted(df.columns) == sorted(cols) and got == want
            print(f"{'ok   ' if ok else 'DIFF '} {name}: {len(got)} rows, spark {t1-t0:.1f}s sql {time.time()-t1:.1f}s")
            if not ok:
                bad.append(name)
                print("   columns", sorted(df.columns), sorted(cols), "rows", len(got), len(want))
                a, b = set(map(repr, got)), set(map(repr, want))
                print("   only spark:", [str(x)[:300] for x in list(a - b)[:3]])
                print("   only sql:  ", [str(x)[:300] for x in list(b - a)[:3]], len(a - b), len(b - a))
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"ERROR {name}: {str(e)[:300]} ... {[l for l in str(e).splitlines() if "Caused" in l or "Error" in l][-4:]}")
    print("failed:", bad)


main()
