"""Run registered queries next to their SQL texts in DuckDB and compare the results.

    python tests/compare.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cpus: int = 8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("compare")
             .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "12g")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.9g}" if v else "0"
    return str(v)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, run, sql, sf_dir):
    """None when equal, else a text that shows the first difference."""
    df = run(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got[1] else "no rows"
    cur = con.execute(sql)
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        extra = sorted(set(got[1]) - set(want[1]))[:2], sorted(set(want[1]) - set(got[1]))[:2]
        return f"rows {len(got[1])} != {len(want[1])}; {extra}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        g, w = bad[0]
        return f"{len(bad)} of {len(want[1])} rows differ, e.g. " + str(
            [(n, a, b) for n, a, b in zip(got[0], g, w) if a != b][:6]) + f" in {w[:4]}"
    return None if want[1] else "no rows"


def main(argv):
    from greengrain.plans.catalog import QUERIES
    sf_dir = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    names = [n for n in QUERIES if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    spark, con, failed = session(), database(sf_dir), 0
    for n in names:
        t0 = time.time()
        try:
            problem = compare(spark, con, QUERIES[n].run, QUERIES[n].sql, sf_dir)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        kind = "sql " if QUERIES[n].sql else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.time() - t0:6.1f}s {n} {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
