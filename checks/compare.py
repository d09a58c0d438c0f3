"""Run registered queries against their oracles: python -m checks.compare [sf] [name ...]"""

from __future__ import annotations

import importlib
import sys
import time

import duckdb
import numpy as np
import pandas as pd

from checks.views import TABLES
from patchlake.session import local_session

entry = importlib.import_module("__spark_entry__")


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, cells as text, rows sorted."""

    def cell(value):
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
            return "~"
        if isinstance(value, bool) or type(value).__name__ == "bool_":
            return str(bool(value))
        if isinstance(value, (float, np.floating)):
            return repr(round(float(value), 6) + 0.0).removesuffix(".0")
        return str(value)

    frame = frame[sorted(frame.columns)]
    frame = pd.DataFrame({c: [cell(v) for v in frame[c].astype(object)] for c in frame.columns})
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def compare(spark, connection, sf_dir: str, name: str) -> str:
    started = time.time()
    got = normal(entry.queries()[name](spark, sf_dir).toPandas())
    took = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"ROWS {name}: {len(got)} rows, {took:.1f}s"
    started = time.time()
    want = normal(connection.execute(sql).df())
    head = f"{name}: {len(got)} rows, spark {took:.1f}s, duckdb {time.time() - started:.1f}s"
    if got.equals(want) and len(got):
        return f"OK   {head}"
    detail = f"{len(want)} wanted, columns {list(got.columns)} / {list(want.columns)}"
    if list(got.columns) == list(want.columns):
        both = got.merge(want, how="outer", indicator=True)
        detail += "\n" + both[both["_merge"] != "both"].head(6).to_string()
    return f"FAIL {head}; {detail}"


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    spark = local_session(8)
    for name in sys.argv[2:] or entry.queries():
        try:
            print(compare(spark, connection, sf_dir, name), flush=True)
        except Exception as err:
            print(f"ERR  {name}: {type(err).__name__}: {str(err)[:1500]}", flush=True)


if __name__ == "__main__":
    main()
