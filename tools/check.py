"""Compare registered queries with their SQL oracles on one data folder.

    python tools/check.py [-d FOLDER] [name-prefix ...]
"""

import argparse
import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from evalloom.plans import catalog
from evalloom.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def tidy(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (int, str)):
        return value
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(tidy(r[i]) for i in order) for r in rows), key=repr)


def compare(con, df, sql):
    begin = time.time()
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    print(f"{time.time() - begin:6.1f}s run", end=" ")
    if sql is None:
        return mine, None, f"rows only ({len(mine)})"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return mine, theirs, f"COLUMNS {sorted(df.columns)} vs {sorted(names)}"
    if len(mine) != len(theirs):
        return mine, theirs, f"ROWS {len(mine)} vs {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return mine, theirs, f"VALUES {len(bad)}/{len(mine)} first {str(bad[0][0])[:300]} | {str(bad[0][1])[:300]}"
    kinds = {type(v).__name__ for r in mine[:50] for v in r}
    odd = [(type(a), type(b)) for r, s in zip(mine[:50], theirs[:50]) for a, b in zip(r, s) if type(a) is not type(b)]
    if odd:
        return mine, theirs, f"TYPES {odd[0]}"
    return mine, theirs, f"ok ({len(mine)}) {'/'.join(sorted(kinds))}"


def main():
    args = argparse.ArgumentParser()
    args.add_argument("-d", default="/root/testdata/sf0.01")
    args.add_argument("-v", action="store_true")
    args.add_argument("-f", help="module of the queries")
    args.add_argument("names", nargs="*")
    args = args.parse_args()
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.d)
    failed = []
    for name, entry in catalog.load().items():
        if args.f and not entry.build.__module__.endswith("." + args.f):
            continue
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        start = time.time()
        try:
            df = entry.build(catalog.Tables(spark, args.d))
            mine, _, verdict = compare(con, df, entry.sql)
            if args.v:
                for r in mine[:3]:
                    print("    ", str(r)[:200])
        except Exception as error:
            verdict = "ERROR " + str(error)[:700]
            if args.v:
                traceback.print_exc()
        if not (verdict.startswith("ok") or verdict.startswith("rows only")):
            failed.append(name)
        print(f"{time.time() - start:6.1f}s {name}: {verdict}", flush=True)
    print("failed:", failed)
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
