"""Run every catalog query next to its DuckDB statement and compare all values.

    python tests/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    text = pd.DataFrame({c: [_cell(v) for v in df[c].tolist()] for c in df.columns})
    return sorted(map(tuple, text.itertuples(index=False)))


def _cell(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6f}"
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "")
    return str(v)


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns differ: {sorted(set(spark_df.columns) ^ set(sql_df.columns))}"
    if len(spark_df) != len(sql_df):
        return f"rows differ: {len(spark_df)} vs {len(sql_df)}"
    for c in sql_df.columns:  # whole numbers with nulls come as floating ones on one side
        if pd.api.types.is_integer_dtype(sql_df[c]) and pd.api.types.is_float_dtype(spark_df[c]):
            spark_df = spark_df.assign(**{c: spark_df[c].astype("Int64")})
    a, b = canonical(spark_df), canonical(sql_df)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first: {bad[0]}" if bad else "ok"


def main() -> None:
    import __spark_entry__ as e
    from waitline.sources.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("oracles", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                    "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = e.oracle_sql()
    failed = 0
    for name, run in e.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = run(spark, folder).toPandas()
            mid = time.time()
            result = "rows only" if name not in oracles else compare(got, con.execute(oracles[name]).df())
            failed += result not in ("ok", "rows only")
            print(f"{name:32s} {len(got):8d} rows  spark {mid - start:6.2f}s  sql {time.time() - mid:6.2f}s  {result[:600]}", flush=True)
        except Exception as error:
            failed += 1
            print(f"{name:32s} FAILED {type(error).__name__}: {str(error)[:500]}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
