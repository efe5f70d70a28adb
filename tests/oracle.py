"""Compare registered queries with their SQL in DuckDB, value by value.

Run as a script to check all (or the named) queries:  python tests/oracle.py [sf_dir] [query ...]
"""

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry_module  # noqa: E402


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        if pd.api.types.is_datetime64_any_dtype(frame[name]):
            frame[name] = frame[name].astype("datetime64[ns]")
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def compare(spark, sf_dir, name):
    """(rows, None) if the Spark result equals the SQL result bit for bit, else (rows, reason)."""
    got = canonical(entry_module.queries()[name](spark, sf_dir).toPandas())
    with duckdb.connect() as db:
        db.execute("SET TimeZone = 'UTC'")
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
        want = canonical(db.execute(entry_module.oracle_sql()[name]).df())
    if list(got.columns) != list(want.columns):
        return len(got), f"columns {list(got.columns)} != {list(want.columns)}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} != {len(want)}"
    kinds = [(c, got[c].dtype, want[c].dtype) for c in got.columns if got[c].dtype != want[c].dtype]
    if kinds:
        return len(got), f"types {kinds}"
    for column in got.columns:
        differs = ~((got[column] == want[column]) | (got[column].isna() & want[column].isna()))
        if differs.any():
            where = differs.idxmax()
            return len(got), (
                f"{column}: {int(differs.sum())} differ, e.g. {got[column][where]!r} != {want[column][where]!r}"
            )
    return len(got), None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry_module.queries())
    bad = 0
    for query in names:
        start = time.time()
        try:
            count, reason = compare(session, folder, query)
        except Exception as error:  # noqa: BLE001
            count, reason = -1, f"{type(error).__name__}: {str(error)[:600]}"
        bad += reason is not None
        print(f"{query}: {count} rows, {time.time() - start:.1f} s, {reason or 'equal'}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
