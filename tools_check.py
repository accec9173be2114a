"""Compare registered queries with their SQL on the given tables: ``python tools_check.py [sf] [names...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]

    def norm(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return None
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, float):
            return round(v, 9)
        return v

    return sorted((tuple(norm(v) for v in row) for row in pdf.itertuples(index=False, name=None)), key=repr)


def main() -> int:
    from barloom.plans.registry import all_queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    chosen = sys.argv[2:]
    spark, con, failed = session(), connect(folder), 0
    for name, q in all_queries().items():
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        t0 = time.time()
        try:
            df = q.run(spark, folder)
            got = df.toPandas()
            took = time.time() - t0
            sql = q.oracle()
            if sql is None:
                print(f"rows  {name}: {len(got)} rows, {took:.1f}s", flush=True)
                continue
            t0 = time.time()
            want = con.execute(sql).fetchdf()
            sqlt = time.time() - t0
            a, b = canonical(got), canonical(want)
            types = [(c, str(got[c].dtype), str(want[c].dtype)) for c in sorted(got.columns) if got[c].dtype != want[c].dtype]
            if a == b:
                print(f"ok    {name}: {len(got)} rows, {took:.1f}s sql {sqlt:.1f}s {types or ''}", flush=True)
            else:
                failed += 1
                print(f"DIFF  {name}: {len(a)} vs {len(b)} rows, {took:.1f}s", flush=True)
                cols = sorted(got.columns)
                sa, sb = set(map(repr, a)), set(map(repr, b))
                for row in sorted(sa - sb)[:2]:
                    print("   spark", cols, row[:1500])
                for row in sorted(sb - sa)[:3]:
                    print("   sql  ", row[:1500])
        except Exception as e:  # report and go on with the next query
            failed += 1
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:500]}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
