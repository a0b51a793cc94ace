"""Run registered queries at a scale and hold them against their SQL: python tests/compare.py [NAME...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def main(names: list[str]) -> int:
    import duckdb

    import __spark_entry__ as e

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, ors, bad = e.queries(), e.oracle_sql(), 0
    for n in names or qs:
        t = time.time()
        try:
            df = qs[n](spark, sf)
            cols = sorted(df.columns)
            got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
            took = time.time() - t
            if n not in ors:
                print(f"rows-only {n}: {len(got)} rows {took:.1f}s {df.columns}", flush=True)
                continue
            t = time.time()
            rel = con.execute(ors[n])
            names_ = [d[0] for d in rel.description]
            raw = rel.fetchall()
            ix = [names_.index(c) for c in sorted(names_)]
            want = sorted(tuple(norm(r[i]) for i in ix) for r in raw)
            ok = got == want and cols == sorted(names_)
            bad += not ok
            print(f"{'ok  ' if ok else 'BAD '} {n}: {len(got)} rows, sql {len(want)}; {took:.1f}s, sql {time.time() - t:.1f}s", flush=True)
            if not ok:
                print("  columns", cols, sorted(names_))
                g, w = set(got), set(want)
                print("  only spark", sorted(g - w)[:3], "\n  only sql", sorted(w - g)[:3], flush=True)
        except Exception as x:
            bad += 1
            print(f"FAIL {n}: {str(x)[:900]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
