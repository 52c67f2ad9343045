"""Query registry: name -> plan, and name -> SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under ``name``; ``sql`` states the same result in plain SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its footer is read for the schema once per process, not per use."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def r(c: Column | str, places: int = 6) -> Column:
    """Round a double for comparison; sums depend on order in the last digits."""
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.select(*[r(c, places).alias(c) if c in columns else F.col(c) for c in df.columns])


def untied(c: Column | str, places: int = 2) -> Column:
    """:func:`r` for means of short decimals, moved off the exact half-way points."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(10.0 ** -(places + 3)), places)


def epoch_seconds(c: str) -> Column:
    """Seconds since 1970 of a zone-less timestamp."""
    origin = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.timestamp_diff("MICROSECOND", origin, F.col(c)) / F.lit(1e6)


def natural_sql(c: str) -> str:
    """SQL counterpart of :func:`gaugework.functions.keys.natural_key`."""
    digits = r"regexp_replace(c, '^0+(.)', '\1')"
    return (
        f"array_to_string(list_transform(regexp_extract_all(({c})::VARCHAR, '([0-9]+|[^0-9]+)', 1), "
        f"lambda c: CASE WHEN regexp_matches(c, '^[0-9]') "
        f"THEN '0' || lpad(length({digits})::VARCHAR, 6, '0') || {digits} "
        f"ELSE '1' || lower(c) || chr(1) END), '')"
    )


def digest_sql(*fields: str) -> str:
    """SQL counterpart of :func:`gaugework.functions.keys.keyed_digest` (SQL expressions in)."""
    return "sha256(concat_ws(chr(31), " + ", ".join(f"({f})::VARCHAR" for f in fields) + "))"


def uniform_sql(digest: str, slot: int = 0) -> str:
    return f"((('0x' || substr({digest}, {1 + 12 * slot}, 12))::BIGINT + 0.5) / 281474976710656.0)"
