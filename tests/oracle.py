"""Compare every registered query with its SQL counterpart, value by value, ignoring row order.

Command line: python -m tests.oracle [name-prefix ...] [--sf 0.01] [--jobs 1]
"""

from __future__ import annotations

import math
import sys
import time
from multiprocessing.pool import ThreadPool

import duckdb
import pandas as pd

from parcelytics.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def sql_frame(sql: str, folder: str) -> pd.DataFrame:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con.execute(sql).df()


def kind(series: pd.Series) -> str:
    name = str(series.dtype).lower()
    if name.startswith(("int", "uint")):
        return "int"
    if name.startswith("float"):
        return "float"
    if name.startswith("bool"):
        return "bool"
    if name.startswith("datetime"):
        return "time"
    return "object"


def value(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
        if isinstance(x, float) and math.isnan(x):
            return None
    if isinstance(x, float):
        return 0.0 if x == 0 else x
    if isinstance(x, (list, tuple)):
        return tuple(value(v) for v in x)
    return x


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(value(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """'' when equal, else a short reason."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if len(got) == 0:
        return "EMPTY"
    for c in sorted(got.columns):
        a, b = kind(got[c]), kind(want[c])
        if a != b and got[c].notna().all() and want[c].notna().all():
            return f"type of {c}: {got[c].dtype} != {want[c].dtype}"
    left, right = rows(got), rows(want)
    if left != right:
        bad = [(l, r) for l, r in zip(left, right) if l != r]
        return f"values differ in {len(bad)}/{len(left)} rows, e.g.\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    return ""


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries

    sf = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        argv = argv[:at] + argv[at + 2 :]
    jobs = 1
    if "--jobs" in argv:
        at = argv.index("--jobs")
        jobs = int(argv[at + 1])
        argv = argv[:at] + argv[at + 2 :]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("oracle-check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    sqls, failed, registered = oracle_sql(), [], queries()
    names = [n for n in registered if not argv or any(n.lower().startswith(p.lower()) for p in argv)]

    def run(name):
        start = time.time()
        try:
            got, reason = registered[name](spark, folder).toPandas(), ""
        except Exception as error:  # report and go on with the next query
            got, reason = None, f"{type(error).__name__}: {str(error)[:1500]}"
        return name, got, reason, time.time() - start

    with ThreadPool(jobs) as pool:
        for name, got, reason, took in pool.imap_unordered(run, names, chunksize=1):
            if got is not None:
                if name in sqls:
                    reason = compare(got, sql_frame(sqls[name], folder))
                else:
                    reason = "" if len(got) else "EMPTY"
                    print(f"rows-only {name}: {len(got)} rows", flush=True)
            print(f"{'ok  ' if not reason else 'FAIL'} {took:6.2f}s {name} {reason}", flush=True)
            if reason:
                failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
