"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import anew, stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it sees."""
    pairs = _both_ways(edges)
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(anew(F.col("u")).alias("at"), F.least("u", "m").alias("m"))
    met = pairs.where("v > u").join(least, anew(F.col("u")) == F.col("at"))
    return met.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    found = least.select(anew(F.col("u")).alias("at"), "m")
    met = down.join(found, anew(F.col("u")) == F.col("at"))
    moved = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (u, v) reaches; roots are not
    listed. Large and small stars alternate until nothing changes, which takes a number of rounds
    that grows with the logarithm of the longest path. Joins on a node with very many neighbours
    are plain joins of a table with its own per-node minimum, which Spark splits when skewed."""
    now = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003))
    before = None
    while True:
        now = stored(_small_star(_large_star(now)).where("u <> v").distinct(), "edges")
        state = now.agg(mark.alias("s")).first()["s"]
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
