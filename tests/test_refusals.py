"""Bad input that has to stop a job: scorers, joins, summaries and rankings."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gaugework.functions.arrays import array_error
from gaugework.operators import grids, joins, stats
from gaugework.operators.selection import rank_candidates

NAN, INF = float("nan"), float("inf")
GOOD = [0.5] * 64


def pair(spark, a, b, m=None):
    return spark.createDataFrame([(a, b, m)], "a array<double>, b array<double>, m array<boolean>").repartition(1)


@pytest.mark.parametrize("a,b,why", [
    ([0.1, NAN], [0.1, 0.2], "reference not finite"),
    ([0.1, 0.2], [0.1, INF], "prediction not finite"),
    ([0.1, None], [0.1, 0.2], "reference not finite"),
    ([0.1, 7.0], [0.1, 0.2], "reference out of range"),
    ([0.1, 0.2], [0.1, -0.1], "prediction out of range"),
    ([], [], "reference empty"),
    (None, [0.1], "reference empty"),
    ([0.1], [0.1, 0.2], "shapes differ"),
])
def test_array_error_refuses(spark, a, b, why):
    df = pair(spark, a, b)
    with pytest.raises(PySparkException, match=why):
        df.select(array_error(F.col("a"), F.col("b"))).collect()


def test_array_error_refuses_masks(spark):
    for mask, why in (([True], "mask shape differs"), ([True, None], "mask not boolean"), (None, "mask shape differs")):
        with pytest.raises(PySparkException, match=why):
            pair(spark, [0.1, 0.2], [0.1, 0.2], mask).select(array_error(F.col("a"), F.col("b"), F.col("m"))).collect()
    wide = pair(spark, [0.0, 255.0], [1.0, 254.0], [True, False])
    row = wide.select(array_error(F.col("a"), F.col("b"), F.col("m"), 255.0).alias("e")).first()["e"]
    assert (row["n"], row["mae"], row["mse"]) == (1, 1.0, 1.0)
    slack = pair(spark, [0.0, 1.0 + 1e-7], [-1e-7, 1.0]).select(array_error(F.col("a"), F.col("b")).alias("e"))
    assert slack.first()["e"]["n"] == 2


@pytest.mark.parametrize("value,why", [(NAN, "not finite"), (INF, "not finite"), (7.0, "out of range"), (-1.0, "out of range")])
def test_grid_scorers_refuse(spark, value, why):
    size = F.lit(8)
    for a, b, name in (([value] + GOOD[1:], GOOD, "reference"), (GOOD, GOOD[:-1] + [value], "prediction")):
        df = pair(spark, a, b, [True] * 64)
        with pytest.raises(PySparkException, match=f"{name} is {why}"):
            df.select(grids.unit_metrics(F.col("a"), F.col("b"), F.col("m"), size, size, 5, 1.0)).collect()
        with pytest.raises(PySparkException, match=f"{name} is {why}"):
            df.select(grids.local_similarity(F.col("a"), F.col("b"), size, size, 5, 1.0)).collect()


@pytest.mark.parametrize("cell", [-1, 16, None])
def test_equalize_refuses_cells_outside(spark, cell):
    df = spark.createDataFrame([("g", 1), ("g", cell)], "g string, bin int")
    with pytest.raises(PySparkException, match="outside the 16 bins"):
        grids.clip_limited_equalize(df, ["g"], "bin", 16).collect()


def test_inherit_refuses_repeated_and_unknown_entities(spark):
    units = spark.createDataFrame([(1, 0.5), (1, 0.25), (2, 0.1)], "e long, x double")
    entities = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "e long, s string, t string")
    assert joins.inherit(units, entities, "e", ["s", "t"]).count() == 3
    for wrong, why in ((entities.union(entities.where("e = 1")), "an entity is repeated: 1"), (entities.where("e = 1"), "unknown entity 2")):
        with pytest.raises(PySparkException, match=why):
            joins.inherit(units, wrong, "e", ["s", "t"]).select("x").collect()  # also where no attribute is used
    with pytest.raises(PySparkException, match="is repeated"):
        joins.inherited_mismatches(units.withColumn("s", F.lit("a")), entities.union(entities), "e", "s").collect()


def test_same_run_partner_refuses(spark):
    results = spark.createDataFrame([("m", 1, 0.5), ("m", 2, 0.75)], "metric string, run int, value double")
    partners = spark.createDataFrame([("m", 1, 0.25), ("m", 2, 0.5)], "metric string, run int, value double")
    assert joins.same_run_partner(results, partners, ["metric"], "run").count() == 2
    for wrong, why in ((partners.union(partners.limit(1)), "a partner is repeated: m/1"), (partners.where("run = 1"), "no partner for run 2")):
        with pytest.raises(PySparkException, match=why):
            joins.same_run_partner(results, wrong, ["metric"], "run").select("value").collect()


def sides(spark):
    schema = "entity string, unit_count long, mean_mae double"
    return (spark.createDataFrame([("1", 3, x), ("2", 4, 0.5)], schema) for x in (0.25, 0.5))


def test_strict_pairs_refuse_empty_sides_and_metrics_that_are_not_finite(spark):
    a, b = sides(spark)
    assert joins.strict_pairs(a, b, "entity", ["mae"]).count() == 2
    for method, baseline, why in (
        (a.where("false"), b, "method table: no rows"),
        (a, b.where("false"), "baseline table: no rows"),
        (a.where("false"), b.where("false"), "no rows"),
        (a.withColumn("mean_mae", F.lit(NAN)), b, "mae is not finite"),
        (a, b.withColumn("mean_mae", F.lit(None).cast("double")), "mae is not finite"),
    ):
        with pytest.raises(PySparkException, match=why):
            joins.strict_pairs(method, baseline, "entity", ["mae"]).select("entity").collect()
    both = a.withColumn("method", F.lit("x")).union(b.withColumn("method", F.lit("y")))
    assert joins.strict_pairs_of(both, "entity", "method", "x", "y", ["mae"]).count() == 2
    with pytest.raises(PySparkException, match="p and q: no rows"):
        joins.strict_pairs_of(both, "entity", "method", "p", "q", ["mae"]).collect()


@pytest.mark.parametrize("delta", [NAN, INF, None])
def test_delta_summary_refuses(spark, delta):
    pairs = spark.createDataFrame([("1", 0.5), ("2", -0.25)], "entity string, delta_mae double")
    row = stats.paired_delta_summary(pairs, ["mae"], ("mae",), ("psnr",)).first()
    assert (row["improved"], row["worsened"], row["tied"]) == (1, 1, 0)
    wrong = pairs.union(spark.createDataFrame([("3", delta)], pairs.schema))
    with pytest.raises(PySparkException, match="delta_mae is not finite"):
        stats.paired_delta_summary(wrong, ["mae"], ("mae",), ("psnr",)).collect()
    with pytest.raises(PySparkException, match="paired deltas: no rows"):
        stats.paired_delta_summary(pairs.where("false"), ["mae"], ("mae",), ("psnr",)).collect()


def test_ranking_refuses_no_candidates(spark):
    table = spark.createDataFrame([(0.1, 1, 0.5)], "clip double, tiles int, ssim double")
    assert rank_candidates(table, ["ssim"], ["clip", "tiles"]).count() == 1
    with pytest.raises(PySparkException, match="candidates: no rows"):
        rank_candidates(table.where("false"), ["ssim"], ["clip", "tiles"]).collect()


def test_scores_are_unchanged(spark):
    rng = np.random.default_rng(5)
    a, b = rng.random(64), rng.random(64)
    mask = rng.random(64) > 0.4
    df = pair(spark, a.tolist(), b.tolist(), mask.tolist())
    e = df.select(array_error(F.col("a"), F.col("b")).alias("e"), array_error(F.col("a"), F.col("b"), F.col("m")).alias("f")).first()
    for row, d in ((e["e"], b - a), (e["f"], (b - a)[mask])):
        assert row["n"] == len(d)
        assert (row["mae"], row["mse"], row["psnr"]) == pytest.approx((np.abs(d).mean(), (d**2).mean(), -10 * np.log10((d**2).mean())))
