"""Compare registered queries with their SQL in DuckDB.

Usage: python tests/oracle_check.py [key ...]   (SF_DIR picks the data)
"""

from __future__ import annotations

import math
import os
import signal
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6g}"
        if isinstance(v, int):
            return str(v) if abs(v) > 10**6 else f"{float(v):.6g}"
        return str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, key, query, oracle, sf_dir):
    df = query(spark, sf_dir)
    got_cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if oracle is None:
        return len(got), None
    cur = con.execute(oracle)
    want_cols, want = canonical([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return len(got), f"columns {got_cols} != {want_cols}"
    if got != want:
        extra, missing = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return len(got), f"{len(got)} vs {len(want)} rows; only spark {extra}; only sql {missing}; cols {got_cols}"
    return len(got), None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)

    def expired(*_):
        spark.sparkContext.cancelAllJobs()
        raise TimeoutError("query took too long")

    signal.signal(signal.SIGALRM, expired)
    keys = sys.argv[1:] or list(e.queries())
    queries, oracles = e.queries(), e.oracle_sql()
    bad = 0
    for key in keys:
        t0 = time.time()
        signal.alarm(int(os.environ.get("QUERY_TIMEOUT", "120")))
        try:
            n, err = compare(spark, con, key, queries[key], oracles.get(key), sf_dir)
        except Exception as exc:  # noqa: BLE001
            n, err = -1, f"{type(exc).__name__}: {str(exc)[:900]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        signal.alarm(0)
        bad += err is not None
        kind = "" if key in oracles else " (rows only)"
        print(f"{'FAIL' if err else 'ok  '} {key}{kind} rows={n} {time.time() - t0:.1f}s {err or ''}", flush=True)
    print(f"{len(keys) - bad}/{len(keys)} good")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
