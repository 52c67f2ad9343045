"""Write-once publication: staged, checked against the declared layout, then renamed."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugework.functions.nested import require_finite, rounded
from gaugework.functions.values import PUBLISHED_PLACES


class PublicationError(RuntimeError):
    """A publication was refused or did not match its declared layout."""


@dataclass(frozen=True)
class Output:
    """One declared table: ``csv`` reports are small and single-file, ``parquet`` is data."""

    table: DataFrame
    fmt: str = "parquet"
    columns: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    #: Columns that rows are ordered by.
    order: tuple[str, ...] = ()


def guard_partial(limit: int | None, destination: str, canonical: tuple[str, ...]) -> None:
    """A row-limited run may not write a canonical location."""
    if limit is not None and any(
        destination.rstrip("/") == c.rstrip("/") or destination.startswith(c.rstrip("/") + "/")
        for c in canonical
    ):
        raise PublicationError(f"a run limited to {limit} rows may not write {destination}")


def strict_json(df: DataFrame, places: int = PUBLISHED_PLACES) -> DataFrame:
    """One JSON text per row, numbers rounded; one that is not finite, at any depth, fails the job
    instead of being written."""
    clean = rounded(require_finite(df), places)
    return clean.select(F.to_json(F.struct(*[f"`{c}`" for c in clean.columns]), {"ignoreNullFields": "false"}).alias("value"))


def write_table(output: Output, path: str) -> None:
    """Write a declared table. Numbers are rounded in every format, so that the same results give the
    same values; reports are one file in the declared order, data is ordered within its files."""
    df = output.table.select(*output.columns) if output.columns else output.table
    order = [F.col(c) for c in output.order]
    if output.fmt in ("csv", "json"):
        # Reports only: one small file.
        one = df.coalesce(1)
        one = one.sortWithinPartitions(*order) if order else one
        if output.fmt == "csv":
            writer = rounded(one).write.mode("errorifexists").option("header", "true")
            writer.option("lineSep", "\n").csv(path)
        else:
            strict_json(one).write.mode("errorifexists").option("lineSep", "\n").text(path)
        return
    data = rounded(df)
    if order:
        data = data.sortWithinPartitions(*output.partition_by, *order)
    writer = data.write.mode("errorifexists")
    if output.partition_by:
        writer = writer.partitionBy(*output.partition_by)
    writer.parquet(path)


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, to_path = _filesystem(spark, path)
    stream = fs.create(to_path(path), False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def publish_once(spark: SparkSession, outputs: dict[str, Output], destination: str, limit: int | None = None, canonical: tuple[str, ...] = ()) -> str:
    """Write all tables or none, exactly once.

    The destination and its staging folder must not exist. Tables go to staging, the produced
    names are compared with the declared ones, the receipt is written last and staging is
    renamed. A failure leaves staging in place with ``FAILED.json``; there is no retry.
    """
    guard_partial(limit, destination, canonical)
    destination = destination.rstrip("/")
    staging = destination + ".staging"
    fs, to_path = _filesystem(spark, destination)
    for path in (destination, staging):
        if fs.exists(to_path(path)):
            raise PublicationError(f"{path} exists already")
    if not fs.mkdirs(to_path(staging)):
        raise PublicationError(f"cannot create {staging}")
    try:
        for name, output in outputs.items():
            write_table(output, f"{staging}/{name}")
        produced = {s.getPath().getName() for s in fs.listStatus(to_path(staging))}
        if produced != set(outputs):
            raise PublicationError(f"staging holds {sorted(produced)}, declared {sorted(outputs)}")
        receipt = {
            "published_utc": datetime.now(timezone.utc).isoformat(timespec="seconds"),
            "tables": {name: _table_facts(fs, to_path, f"{staging}/{name}") for name in outputs},
        }
        _write_text(spark, f"{staging}/receipt.json", json.dumps(receipt, indent=2, sort_keys=True))
        if not fs.rename(to_path(staging), to_path(destination)):
            raise PublicationError(f"cannot rename {staging} to {destination}")
    except Exception as error:
        record = {"error": f"{type(error).__name__}: {error}"}
        if fs.exists(to_path(staging)) and not fs.exists(to_path(f"{staging}/FAILED.json")):
            _write_text(spark, f"{staging}/FAILED.json", json.dumps(record))
        raise
    return destination


def _table_facts(fs, to_path, path: str) -> dict:
    summary = fs.getContentSummary(to_path(path))
    return {"files": summary.getFileCount(), "bytes": summary.getLength()}


def run_path(root: str, method: str, run: int | str | None) -> str:
    """One folder per (method, run); deterministic methods have no run level."""
    return f"{root.rstrip('/')}/{method}" + ("" if run is None else f"/run={run}")
