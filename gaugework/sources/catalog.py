"""File catalogue, quarantining ingest, manifests, result documents, read accounting."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gaugework.functions.keys import natural_key
from gaugework.operators.constraints import ConstraintError

#: Schema of a unit manifest; the entity id stays text.
MANIFEST = T.StructType(
    [
        T.StructField("subject_id", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("source_archive", T.StringType()),
        T.StructField("acquisition_group", T.StringType()),
        T.StructField("relative_dicom_path", T.StringType()),
        T.StructField("geometric_slice_position", T.DoubleType()),
        T.StructField("geometric_slice_index", T.IntegerType()),
    ]
)


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def file_catalog(spark: SparkSession, root: str, suffix: str, marker: str = "CT") -> DataFrame:
    """One row per unit file below ``<source>/<marker>/<entity>/…``; content is not read.

    The suffix matches in any case. Entities without a file have no row. An entity id found
    in two sources fails the job: pooling them could put one subject into two partitions.
    """
    path = F.col("path")
    pattern = rf"([^/]+)/{marker}/([^/]+)/(?:.*/)?[^/]+$"
    rows = (
        _files(spark, root)
        .select("path", "length")
        .where(F.endswith(F.lower(path), F.lit(suffix.lower())) & path.rlike(pattern))
        .select(
            "path",
            F.regexp_extract(path, pattern, 1).alias("source"),
            F.regexp_extract(path, pattern, 2).alias("entity_id"),
            F.substring_index(path, "/", -1).alias("file"),
            "length",
        )
    )
    sources = rows.groupBy("entity_id").agg(
        F.min("source").alias("_a"), F.max("source").alias("_b"), F.count("*").alias("entity_files")
    )
    checked = F.when(F.col("_a") == F.col("_b"), F.col("source")).otherwise(
        F.raise_error(F.concat(F.lit("entity in two sources: "), F.col("entity_id")))
    )
    return rows.join(sources, "entity_id").select(
        "path", checked.alias("source"), "entity_id", "file", "length", "entity_files"
    )


def catalog_order(catalog: DataFrame) -> DataFrame:
    """Listing order: natural entity order, then natural file name."""
    return catalog.orderBy(natural_key("entity_id"), "entity_id", natural_key("file"), "path")


def ingest(
    spark: SparkSession,
    root: str,
    decoder: Callable[[bytes], dict],
    fields: str,
    pattern: str = "*",
) -> DataFrame:
    """Decode every file with a user function; a failure becomes the row's ``error`` text.

    ``fields`` is the DDL of the decoded columns. The job goes on over bad files.
    """
    schema = T.StructType(
        [T.StructField("path", T.StringType()), T.StructField("error", T.StringType())]
        + T.StructType.fromDDL(fields).fields
    )
    names = schema.names[2:]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            records = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    found = decoder(content)
                    records.append((path, None, *[found.get(n) for n in names]))
                except Exception as error:  # noqa: BLE001 - the audit must survive bad files
                    records.append((path, f"{type(error).__name__}: {error}", *[None] * len(names)))
            yield pd.DataFrame(records, columns=schema.names).astype(object)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return files.load(root).select("path", "content").mapInPandas(decode, schema)


def parse_json(df: DataFrame, text: str, fields: str, name: str = "parsed") -> DataFrame:
    """Parse a JSON column; rows that do not parse get ``error`` instead of stopping the job."""
    opened = fields + ", _corrupt string"
    parsed = F.from_json(
        F.col(text), opened, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    rows = df.withColumn("_p", parsed)
    bad = F.col("_p").isNull() | F.col("_p._corrupt").isNotNull()
    return rows.withColumn("error", F.when(bad, F.lit("unreadable JSON"))).withColumn(
        name, F.when(~bad, F.col("_p").dropFields("_corrupt"))
    ).drop("_p")


def quarantine(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """``(good, bad)`` by the error column."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def read_manifest(
    spark: SparkSession,
    path: str,
    partition: str,
    allowed: list[str],
    schema: T.StructType = MANIFEST,
    column: str = "split",
    fmt: str = "csv",
) -> DataFrame:
    """The rows of one open partition with a fixed schema; the filter reaches the scan.

    A partition outside ``allowed`` or without rows is an error.
    """
    if partition not in allowed:
        raise ConstraintError(f"partition {partition!r} is not open; open are {allowed}")
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST")
    rows = reader.format(fmt).load(path).where(F.col(column) == partition)
    if rows.isEmpty():
        raise ConstraintError(f"manifest {path} has no row of partition {partition!r}")
    return rows


def manifest_order(rows: DataFrame, entity: str = "subject_id", index: str = "geometric_slice_index") -> DataFrame:
    return rows.orderBy(natural_key(entity), entity, index)


def read_summaries(spark: SparkSession, paths: list[str] | str, metrics: list[str], result: str = "primary_result") -> DataFrame:
    """``file, metric, value`` from nested result documents (``<result>.<metric>.mean``).

    A document without one of the metrics fails the job.
    """
    leaf = T.StructType([T.StructField("mean", T.DoubleType())])
    inner = T.StructType([T.StructField(m, leaf) for m in metrics])
    schema = T.StructType([T.StructField(result, inner)])
    docs = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(paths)
    entries = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(f"{result}.{m}.mean").alias("value"))
            for m in metrics
        ]
    )
    rows = docs.select(F.col("_metadata.file_path").alias("file"), F.explode(entries).alias("r"))
    value = F.when(F.col("r.value").isNotNull(), F.col("r.value")).otherwise(
        F.raise_error(F.concat(F.lit("no value of "), F.col("r.metric"), F.lit(" in "), F.col("file")))
    )
    return rows.select("file", F.col("r.metric").alias("metric"), value.alias("value"))


def plain_path(c: Column) -> Column:
    """File URI without scheme, percent escapes resolved, so listings and metadata compare."""
    return F.url_decode(F.replace(F.regexp_replace(c, "^[a-z0-9]+:/+", "/"), F.lit("+"), F.lit("%2B")))


def local_path(uri: str) -> str:
    return unquote(urlparse(uri).path) if "://" in uri or uri.startswith("file:") else uri


def file_reads(read: DataFrame, catalog: DataFrame, partition: str, allowed: list[str]) -> DataFrame:
    """Distinct files and rows read per partition; files outside the catalogue are ``unlisted``.

    ``read`` comes straight from a file source. ``refused`` marks what is not allowed.
    """
    seen = read.select(plain_path(F.col("_metadata.file_path")).alias("_file")).groupBy("_file").agg(
        F.count("*").alias("_rows")
    )
    listed = catalog.select(plain_path(F.col("path")).alias("_file"), partition)
    joined = seen.join(listed, "_file", "left")
    label = F.coalesce(F.col(partition), F.lit("unlisted"))
    return joined.groupBy(label.alias(partition)).agg(
        F.count("*").alias("files"), F.sum("_rows").alias("rows")
    ).withColumn("refused", ~F.col(partition).isin(*allowed))
