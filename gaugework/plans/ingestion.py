"""Quarantine of unreadable records and accounting of what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugework.functions import nested
from gaugework.plans.registry import query, table
from gaugework.sources import catalog


@query(
    "quarantine",
    """
WITH p AS (SELECT event_type, CASE WHEN event_type = 'error' THEN substr(props, 1, length(props) - 1) ELSE props END AS props FROM events)
SELECT event_type, count(*) FILTER (WHERE event_type <> 'error') AS good, count(*) FILTER (WHERE event_type = 'error') AS bad,
       (sum(CASE WHEN event_type <> 'error' THEN json_extract(props, '$.k')::BIGINT END))::BIGINT AS k_total
FROM p GROUP BY event_type""",
)
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Error events get a cut-off document; they must end in quarantine, all others be read."""
    cut = F.when(F.col("event_type") == "error", F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    rows = catalog.parse_json(table(spark, d, "events").select("event_type", cut.alias("props")), "props", "k bigint")
    return rows.groupBy("event_type").agg(
        F.count_if(F.col("error").isNull()).alias("good"),
        F.count_if(F.col("error").isNotNull()).alias("bad"),
        F.sum("parsed.k").alias("k_total"),
    )


@query(
    "read_manifest",
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
)
def read_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The rows of one open partition of a manifest with a fixed schema; the filter is in the scan."""
    schema = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").schema
    path = f"{d.rstrip('/')}/orders.parquet"
    return catalog.read_manifest(spark, path, "F", ["F", "O"], schema, "o_orderstatus", "parquet")


@query(
    "published_nested",
    """
WITH u AS (SELECT l_orderkey, list({'line': l_linenumber, 'share': round(l_extendedprice / 3, 6)} ORDER BY l_linenumber) AS lines,
             round(avg(l_discount / 7), 6) AS mean FROM lineitem GROUP BY l_orderkey),
e AS (SELECT l_orderkey, mean, unnest(lines) AS x FROM u)
SELECT l_orderkey, mean, x.line AS line, x.share AS share, x.share AS keyed FROM e""",
)
def published_nested(spark: SparkSession, d: str) -> DataFrame:
    """Orders with nested shares, rounded at every depth and proved finite, taken apart again."""
    line = F.struct(F.col("l_linenumber").alias("line"), (F.col("l_extendedprice") / 3).alias("share"))
    # The lines of an order are few.
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.struct(F.sort_array(F.collect_list(line)).alias("lines")).alias("inner"), F.avg(F.col("l_discount") / 7).alias("mean")
    )
    keyed = F.map_from_entries(F.transform("inner.lines", lambda x, i: F.struct(i.alias("i"), F.struct(x["share"].alias("v")))))
    out = nested.rounded(nested.require_finite(orders.withColumn("map", keyed)), 6)
    rows = out.select("l_orderkey", "mean", "map", F.posexplode("inner.lines").alias("i", "x"))
    return rows.select("l_orderkey", "mean", "x.line", "x.share", F.element_at("map", F.col("i"))["v"].alias("keyed"))


@query(
    "file_reads",
    """
SELECT 'units' AS kind, 1::BIGINT AS files, count(*) AS rows, false AS refused FROM orders
UNION ALL SELECT 'entities', 1, count(*), true FROM customer""",
)
def file_reads(spark: SparkSession, d: str) -> DataFrame:
    """Rows per table read through the catalogue of the data folder, by kind of table."""
    listing = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(d).select("path", "length")
    )
    kind = F.when(F.col("path").rlike("(orders|lineitem)[.]parquet$"), "units").otherwise("entities")
    listed = listing.withColumn("kind", kind)
    read = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "_metadata")
    read = read.unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "_metadata"))
    return catalog.file_reads(read, listed, "kind", ["units"])
