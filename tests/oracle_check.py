"""Run registered queries against their SQL oracles: python tests/oracle_check.py [sf_dir] [name…]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def _plain(value):
    if isinstance(value, float):
        return round(value, 9) if math.isfinite(value) else str(value)
    return int(value) if isinstance(value, bool) else value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_plain(r[i]) for i in order) for r in records), key=lambda r: [(v is None, str(v)) for v in r]
    )


def compare(spark, sf, name, query, sql):
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows only: {len(got[1])}"
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"ROWS {len(got[1])} {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1], strict=True) if g != w]
    if bad:
        g, w = bad[0]
        col = next(i for i, (x, y) in enumerate(zip(g, w, strict=True)) if x != y)
        return f"VALUES {len(bad)} {got[0][col]}\n  got  {g[col]!r:.600}\n  want {w[col]!r:.600}"
    return f"ok {len(got[1])}"


def main(argv):
    import __spark_entry__ as entry

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        started = time.time()
        try:
            result = compare(spark, sf, name, query, oracles.get(name))
        except Exception as exc:
            result = f"ERROR {type(exc).__name__} {str(exc)[:1500]}"
        print(f"{name:24s} {time.time() - started:6.1f}s {result}", flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
