"""Small tables held in the plan: parameters, cuts, one row per stratum."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_rows(spark: SparkSession, rows: list[tuple], schema: StructType | str) -> DataFrame:
    """A literal table from a few Python rows."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    records = [dict(zip(schema.names, row, strict=True)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=to_arrow_schema(schema)), schema)


def pinned(df: DataFrame) -> DataFrame:
    """The current rows of a frame that is small by construction, as a literal table.

    For reports and parameters only: one row per stratum, slice limits, one row per check.
    """
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)
