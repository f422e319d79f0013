"""Compare registered queries with their SQL statements on one table folder.

usage: check_queries.py [table_dir] [name-prefix ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

from hourmark.plans import ENTRIES
from hourmark.session import build_session


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in glob.glob(f"{path}/*.parquet"):
        name = os.path.basename(file).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{file}')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    """Rows as text in a fixed order."""
    out = pd.DataFrame({c: df[c].map(lambda v: "NULL" if v is None or v is pd.NaT or v != v else str(v)) for c in sorted(df.columns)})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    """None when equal, else a short description of the first difference."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} vs {len(sql_df)}"
    if not len(sql_df):
        return None
    for c in sql_df.columns:
        if str(sql_df[c].dtype).startswith("datetime"):
            sql_df[c] = sql_df[c].astype("datetime64[us]")
        if str(spark_df[c].dtype).startswith("datetime"):
            spark_df[c] = spark_df[c].astype("datetime64[us]")
        if "date" in str(type(spark_df[c].iloc[0] if len(spark_df) else "")) and str(sql_df[c].dtype).startswith("datetime"):
            spark_df[c] = pd.to_datetime(spark_df[c]).astype("datetime64[us]")
        if str(spark_df[c].dtype) == "float64" or str(sql_df[c].dtype) == "float64":
            spark_df[c], sql_df[c] = spark_df[c].astype("float64"), sql_df[c].astype("float64")
    a, b = canonical(spark_df), canonical(sql_df)
    if a.equals(b):
        return None
    bad = (a != b).any(axis=1)
    return f"{int(bad.sum())} of {len(a)} rows differ\n{a[bad].head(3).to_string()}\n--- sql\n{b[bad].head(3).to_string()}"


def main(path: str, prefixes: list[str]) -> int:
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(path)
    failed = 0
    for name, e in ENTRIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            got = e.run(spark, path).toPandas()
            took = time.time() - start
            if e.sql is None:
                print(f"rows {name:42s} {len(got):7d} rows {took:6.2f}s", flush=True)
                continue
            problem = compare(got, con.execute(e.sql).df())
            if problem:
                failed += 1
                print(f"FAIL {name}: {problem}", flush=True)
            else:
                note = "" if len(got) else "  EMPTY"
                print(f"ok   {name:42s} {len(got):7d} rows {took:6.2f}s{note}", flush=True)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            failed += 1
            text = str(error).strip().splitlines() or [repr(error)]
            print(f"ERR  {name}: {type(error).__name__} {' | '.join(text[:4])[:700]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"{failed} problems")
    return failed


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    sys.exit(1 if main(folder, args[1:]) else 0)
