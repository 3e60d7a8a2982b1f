"""Run registered queries on Spark and DuckDB over one data folder and compare them.

Usage: python tests/compare.py [folder] [name or module ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def make_spark(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("oddsmith-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(str)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype("float64")
        else:
            df[c] = df[c].map(lambda v: "<null>" if v is None or v is pd.NA or (isinstance(v, float) and pd.isna(v)) else str(v))
    return df.sort_values(list(df.columns), ignore_index=True, na_position="last") if len(df.columns) else df


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = same.idxmin()
            return f"{c}: {(~same).sum()} rows differ, e.g.\n   {a.loc[i].to_dict()}\n   {b.loc[i].to_dict()}"
    return None


def check(name: str, spark, con, folder: str) -> tuple[str | None, int, float]:
    from oddsmith.catalog import registry

    start = time.time()
    got = registry.run(name, spark, folder).toPandas()
    took = time.time() - start
    sql = registry.oracle(name)
    if sql is None:
        return None, len(got), took
    return differences(got, con.execute(sql).df()), len(got), took


def main(argv: list[str]) -> int:
    from oddsmith.catalog import all as catalog
    from oddsmith.catalog import registry

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    catalog.load()
    names = list(registry.ENTRIES)
    if len(argv) > 1:
        names = [n for n in names if n in argv[1:] or registry.ENTRIES[n].build.__module__.rsplit(".", 1)[-1] in argv[1:]]
    spark, con = make_spark(), connect(folder)
    bad = []
    for name in names:
        try:
            diff, rows, took = check(name, spark, con, folder)
        except Exception as e:  # report and go on
            diff, rows, took = f"{type(e).__name__}: {str(e)[:700]}", -1, 0.0
        kind = "rows" if registry.ENTRIES[name].sql is None else "ok"
        print(f"{'FAIL' if diff else kind:5} {name:34} {rows:8} {took:6.2f}s", flush=True)
        if diff:
            print("     ", diff, flush=True)
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} equal; failing: {' '.join(bad)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
