"""Compare registered queries with their SQL on DuckDB: names, row count and values."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

TESTDATA = os.environ.get("GAUGEWORK_TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, str, bytes)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if type(value).__name__ == "Decimal":
        return float(value) if value % 1 else int(value)
    return str(value)


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark_df, con, sql: str) -> str:
    """Empty when equal, otherwise what differs."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = bag(columns, result.fetchall())
    names = spark_df.columns
    if sorted(names) != sorted(columns):
        return f"columns {sorted(names)} != {sorted(columns)}"
    got = bag(names, [tuple(row) for row in spark_df.collect()])
    if got == expected:
        return ""
    return (
        f"{sum(got.values())} rows vs {sum(expected.values())}; "
        f"only spark {list((got - expected).items())[:2]}; only sql {list((expected - got).items())[:2]}"
    )
