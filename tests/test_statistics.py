import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gaugework.operators import joins, runs, selection, stats

LOWER, HIGHER = ("mae",), ("psnr",)


@pytest.fixture(scope="module")
def units(spark):
    rows = [("A", "s1", 0.0)] + [("B", "s1", 1.0)] * 9
    return spark.createDataFrame(rows, "entity string, stratum string, m double")


def test_entities_weigh_equally(units):
    entities = stats.entity_means(units, "entity", ["m"], ["stratum"])
    row = stats.describe_entities(entities, ["m"]).first()
    assert (row["n"], row["mean"], row["median"], row["min"], row["max"]) == (2, 0.5, 0.5, 0.0, 1.0)
    assert stats.pooled_mean(units, ["m"]).first()["mean"] == pytest.approx(0.9)
    both = stats.two_level_mean(units, "entity", "m").first()
    assert both["entity_weighted"] == 0.5 and both["pooled"] == pytest.approx(0.9)
    assert {r["entity"]: r["unit_count"] for r in entities.collect()} == {"A": 1, "B": 9}


def test_small_and_large_descriptions_agree(spark):
    long = spark.range(500).select(F.lit("m").alias("metric"), F.sin("id").alias("value"))
    a, b = (stats.describe(long, ["metric"], bound=k).first() for k in (500, None))
    assert tuple(a)[:2] == tuple(b)[:2] and tuple(a)[2:] == pytest.approx(tuple(b)[2:])


def test_layout_does_not_matter(units):
    a = stats.entity_means(units, "entity", ["m"]).collect()
    b = stats.entity_means(units.orderBy(F.rand(3)).repartition(5), "entity", ["m"]).collect()
    assert sorted(a) == sorted(b)


def test_one_entity_has_no_spread(units):
    entities = stats.entity_means(units.where("entity = 'B'"), "entity", ["m"])
    assert stats.describe_entities(entities, ["m"]).first()["std"] is None


def test_inconsistent_attribute_fails(spark):
    df = spark.createDataFrame([("A", "s1", 1.0), ("A", "s2", 1.0)], "entity string, stratum string, m double")
    with pytest.raises(PySparkException, match="inconsistent stratum in entity A"):
        stats.entity_means(df, "entity", ["m"], ["stratum"]).collect()


def side(spark, rows):
    return spark.createDataFrame(rows, "entity string, unit_count long, mean_mae double, mean_psnr double")


def test_strict_pairs_and_summary(spark):
    method = side(spark, [("1", 3, 0.125, 31.0), ("2", 4, 0.5, 30.0), ("10", 5, 0.25, 29.0)])
    base = side(spark, [("10", 5, 0.25, 30.0), ("2", 4, 0.25, 29.0), ("1", 3, 0.25, 30.0)])
    pairs = joins.strict_pairs(method, base, "entity", ["mae", "psnr"])
    got = {r["metric"]: r for r in stats.paired_delta_summary(pairs, ["mae", "psnr"], LOWER, HIGHER).collect()}
    assert (got["mae"]["improved"], got["mae"]["worsened"], got["mae"]["tied"]) == (1, 1, 1)
    assert (got["psnr"]["improved"], got["psnr"]["worsened"], got["psnr"]["tied"]) == (2, 1, 0)
    assert got["psnr"]["mean"] == pytest.approx(1 / 3) and got["mae"]["direction"] == "lower"
    checks = stats.linearity_check(pairs, ["mae", "psnr"]).collect()
    assert all(r["agrees"] for r in checks)
    quick = stats.paired_delta_summary(pairs, ["mae", "psnr"], LOWER, HIGHER, bound=3)
    for r in quick.collect():
        assert r["median"] == pytest.approx(got[r["metric"]]["median"]) and r["improved"] == got[r["metric"]]["improved"]
    verdict = {r["metric"]: r for r in stats.verdicts(quick).collect()}
    assert verdict["psnr"]["beats_baseline"] is True and verdict["psnr"]["metrics_improved"] == 1


@pytest.mark.parametrize(
    "method, message",
    [
        ([("1", 3, 0.1, 1.0)], "2 only in baseline"),
        ([("1", 3, 0.1, 1.0), ("2", 4, 0.1, 1.0), ("3", 1, 0.1, 1.0)], "3 only in method"),
        ([("1", 3, 0.1, 1.0), ("1", 3, 0.1, 1.0), ("2", 4, 0.1, 1.0)], "1 repeated in method"),
        ([("1", 9, 0.1, 1.0), ("2", 4, 0.1, 1.0)], "1 unit_count disagrees"),
    ],
)
def test_pairing_refusals(spark, method, message):
    base = side(spark, [("1", 3, 0.2, 1.0), ("2", 4, 0.2, 1.0)])
    with pytest.raises(PySparkException, match=message):
        # Even a plan that needs no metric column must not lose the check.
        joins.strict_pairs(side(spark, method), base, "entity", ["mae", "psnr"]).count()
    report = joins.pairing_report(side(spark, method), base, "entity", ["mae", "psnr"])
    assert report.where("state <> 'paired'").count() >= 1


def test_missing_metric_column(spark):
    base = side(spark, [("1", 3, 0.2, 1.0)])
    with pytest.raises(ValueError, match="lacks column"):
        joins.strict_pairs(base.drop("mean_psnr"), base, "entity", ["mae", "psnr"])


def run_table(spark, oriented, metrics=("full_psnr",)):
    rows = []
    for metric in metrics:
        for i, d in enumerate(oriented):
            a, sign = 10.0, 1 if metric.endswith("psnr") else -1
            rows += [("a", 2026 + i, metric, a), ("b", 2026 + i, metric, a + sign * d)]
    return spark.createDataFrame(rows, "method string, run int, metric string, value double")


@pytest.mark.parametrize(
    "deltas, phrase, for_b",
    [
        ([1.0, 2.0, 3.0, 1.0, 0.5], "all 5 runs favoured b", True),
        ([1.0, 2.0, 3.0, 1.0, -0.5], "b was directionally consistent across runs", True),
        ([1.0, 2.0, 3.0, -1.0, -0.5], None, False),
        ([1.0, 1.0, 1.0, 1.0, -50.0], None, False),
        ([1.0, 1.0, 1.0, 1.0, 0.0], "b was directionally consistent across runs", True),
        ([-1.0, -2.0, -3.0, -1.0, -0.5], "all 5 runs favoured a", False),
    ],
)
def test_direction_rule(spark, deltas, phrase, for_b):
    pairs = runs.paired_runs(run_table(spark, deltas, ("full_psnr", "full_mae")), "a", "b", LOWER, HIGHER)
    for row in runs.paired_run_summary(pairs).withColumn("phrase", runs.permitted_phrase("a", "b")).collect():
        assert row["phrase"] == phrase and row["consistent_for_b"] is for_b
        assert row["runs_for_a"] + row["runs_for_b"] + row["runs_tied"] == 5


def test_overall_claim(spark):
    metrics = ["full_psnr", "full_mae"]
    table = run_table(spark, [1.0] * 5, metrics)
    summary = runs.paired_run_summary(runs.paired_runs(table, "a", "b", LOWER, HIGHER))
    assert runs.overall_claim(summary, "a", "b", metrics).first()["claim"] == "b"
    mixed = table.withColumn("value", F.when(F.col("metric") == "full_mae", -F.col("value")).otherwise(F.col("value")))
    summary = runs.paired_run_summary(runs.paired_runs(mixed, "a", "b", LOWER, HIGHER))
    assert runs.overall_claim(summary, "a", "b", metrics).first()["claim"] is None
    with pytest.raises(PySparkException, match="needs every metric"):
        runs.overall_claim(summary, "a", "b", [*metrics, "body_mae"]).collect()


def test_run_refusals(spark):
    table = run_table(spark, [1.0] * 5)
    with pytest.raises(PySparkException, match="not paired"):
        runs.paired_runs(table.where("not (method = 'a' and run = 2028)"), "a", "b", LOWER, HIGHER).collect()
    nan = table.withColumn("value", F.when(F.col("run") == 2027, float("nan")).otherwise(F.col("value")))
    with pytest.raises(PySparkException, match="finite"):
        runs.paired_runs(nan, "a", "b", LOWER, HIGHER).collect()
    with pytest.raises(PySparkException, match="at least two"):
        runs.run_spread(table.where("run = 2026"), ["method", "metric"]).collect()
    spread = runs.run_spread(table.where("method = 'b'"), ["method", "metric"]).first()
    assert spread["values"] == [11.0] * 5 and spread["std"] == 0.0


def test_reference_and_partition_change(spark):
    table = run_table(spark, [1.0, 2.0, -1.0, 0.0, 3.0]).where("method = 'b'")
    reference = spark.createDataFrame([("full_psnr", 10.0)], "metric string, value double")
    row = runs.against_reference(table, reference, LOWER, HIGHER).first()
    assert (row["improved"], row["worsened"], row["tied"], row["all_improved"]) == (3, 1, 1, False)
    with pytest.raises(PySparkException, match="reference is missing"):
        runs.against_reference(table, reference.where("false"), LOWER, HIGHER).collect()
    results = spark.createDataFrame([("m", "x", "val", 1.0), ("m", "x", "val", 3.0), ("m", "x", "test", 5.0)], "method string, metric string, partition string, value double")
    assert runs.partition_change(results, "val", "test").first()["change"] == 3.0


def test_same_run_partner_has_no_fallback(spark):
    a = spark.createDataFrame([("m", 1, 1.0), ("m", 2, 2.0)], "metric string, run int, value double")
    with pytest.raises(PySparkException, match="no partner for run 2"):
        joins.same_run_partner(a, a.where("run = 1"), ["metric"], "run").collect()


def history(spark, rows):
    return spark.createDataFrame([(1, e, m) for e, m in rows], "run int, epoch int, metric double")


def test_best_epoch(spark):
    best = lambda rows: selection.best_epoch(history(spark, rows), ["run"], "epoch", "metric").first()["best_epoch"]
    assert best([(0, 0.1), (1, 0.5), (2, 0.3), (3, 0.3)]) == 2
    for bad in ([(0, 1.0), (1, 0.5), (3, 0.2)], [(1, 0.5), (1, 0.4)], [(1, float("nan")), (2, 0.1)], [(0, 0.1)]):
        with pytest.raises(PySparkException, match="history has"):
            best(bad)
    assert selection.best_epoch(history(spark, [(0, float("nan")), (1, 0.5)]), ["run"], "epoch", "metric").first()["best_epoch"] == 1


@pytest.mark.parametrize("slice_rows", [2, 10**6])
def test_best_so_far(spark, slice_rows):
    rows = [(0, 0.9), (1, 0.5), (2, 0.5), (3, 0.6), (4, 0.1)] + [(i, 0.2) for i in range(5, 30)]
    got = selection.best_so_far(history(spark, rows), ["run"], "epoch", "metric", slice_rows=slice_rows)
    assert [r["epoch"] for r in got.where("is_best_so_far").orderBy("epoch").collect()] == [0, 1, 4]


def test_rank_candidates(spark):
    rows = [(2.0, 8, 8, 0.7, 30.0), (1.0, 8, 8, 0.7, 30.0), (1.0, 4, 4, 0.7, 30.0), (3.0, 4, 4, 0.8, 1.0), (4.0, 4, 4, 0.7, 31.0)]
    df = spark.createDataFrame(rows, "clip double, r int, c int, ssim double, psnr double")
    for frame in (df, df.orderBy(F.rand(5)).repartition(4)):
        got = selection.rank_candidates(frame, ["ssim", "psnr"], ["clip", "r", "c"], slice_rows=2).orderBy("selection_rank").collect()
        assert [(r["clip"], r["r"]) for r in got] == [(3.0, 4), (4.0, 4), (1.0, 4), (1.0, 8), (2.0, 8)]
        assert [r["selected"] for r in got] == [True] + [False] * 4
    with pytest.raises(PySparkException, match="repeated"):
        selection.rank_candidates(df.union(df.limit(1)), ["ssim", "psnr"], ["clip", "r", "c"]).collect()


def test_middle_pick_takes_the_first_entity_in_natural_order(spark):
    rows = [("g", e, float(p), f"{e}/{p}") for e, n in (("10", 3), ("2", 4)) for p in range(n)]
    df = spark.createDataFrame(rows, "g string, e string, p double, k string")
    row = selection.middle_pick(df, ["g"], "e", "p", "k").first()
    assert (row["e"], row["k"]) == ("2", "2/2")


def test_inherit_refuses_unknown_entities(spark):
    units = spark.createDataFrame([("a",), ("b",)], "e string")
    entities = spark.createDataFrame([("a", "train")], "e string, partition string")
    with pytest.raises(PySparkException, match="unknown entity b"):
        joins.inherit(units, entities, "e", ["partition"]).collect()


def test_witnesses(spark):
    rows = [("m", 1, w, "x") for w in "abcd"] + [("m", 2, w, "x") for w in "abc"] + [("m", 3, w, "x") for w in "abc"] + [("m", 3, "d", "y")]
    df = spark.createDataFrame(rows, "method string, run int, witness string, value string")
    got = {r["run"]: r["agree"] for r in joins.witness_agreement(df, ["method", "run"], 4).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_alignment(spark):
    a = spark.createDataFrame([(i, f"k{i}") for i in range(10)], "p int, k string")
    row = lambda b: joins.positional_alignment(a, b, ["p"], ["p"], "k", slice_rows=3).first()
    assert row(a)["identical_order"] is True
    assert row(a.where("p < 8"))["order_mismatches"] == 2
    swapped = a.withColumn("p", F.when(F.col("p") == 0, 1).when(F.col("p") == 1, 0).otherwise(F.col("p")))
    assert row(swapped)["order_mismatches"] == 2


def test_hot_keys_are_spread_without_losing_rows(spark):
    """Two thirds of the rows share a key, half of those are identical copies."""
    rows = [("hot", i % 2 * i) for i in range(600)] + [(f"k{i % 7}", i) for i in range(280)] + [(None, i) for i in range(20)]
    units = spark.createDataFrame(rows, "e string, v int").repartition(6)
    lookup = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(6)], "e string, x int")
    plain = units.join(lookup, "e", "left")
    spread = joins.lookup_join(units, lookup, ["e"], "left", slice_rows=50)
    assert spread.exceptAll(plain).isEmpty() and plain.exceptAll(spread).isEmpty()
    assert "_part" in spread._jdf.queryExecution().optimizedPlan().toString()
    inner = joins.lookup_join(units, lookup, ["e"], "inner", slice_rows=50)
    assert inner.count() == plain.where("x is not null").count()
