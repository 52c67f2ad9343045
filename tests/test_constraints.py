"""Every constraint fires on one bad row and stays silent on good data."""

import pytest
from pyspark.sql import functions as F

from gaugework.functions.values import is_finite
from gaugework.operators import constraints as q


@pytest.fixture(scope="module")
def good(spark):
    rows = [(f"k{i}", f"e{i % 4}", "train" if i % 4 < 2 else "val", float(i + 1), f"d{i}") for i in range(20)]
    return spark.createDataFrame(rows, "key string, entity string, part string, v double, digest string").cache()


def add(spark, df, *row):
    return df.union(spark.createDataFrame([row], df.schema))


def state(report):
    return {r["check"]: (r["passed"], r["n_bad"]) for r in report.collect()}


def test_good_data_passes_everything(good):
    report = q.combine(
        [
            q.required_columns(good, ["key", "v"]),
            q.not_empty(good),
            q.unique(good, ["key"]),
            q.constant(good, ["entity"], ["part"]),
            q.domain(good, "part", ["train", "val"]),
            q.expected_counts(good, "part", {"train": 10, "val": 10}),
            q.rows(good, {"finite": is_finite(F.col("v")), "positive": F.col("v") > 0}, "key"),
            q.shared_digest(good, ["key"], "digest"),
            q.same_keys(good, good, ["key"]),
            q.planned(good, good, ["entity", "part"]),
            q.no_leakage(good, "entity", "part"),
            q.only_partitions(good, "part", ["train", "val"]),
            q.within_tolerance(good, good, ["key"], "v", 0.0),
            q.same_bytes(good, good, ["key"], "digest"),
            q.recorded_choice(good, good, ["key"], "v"),
        ]
    )
    assert all(passed for passed, _ in state(report).values())
    q.require(report)


def test_each_constraint_fires(spark, good):
    def only(report):
        (value,) = state(report).values()
        return value

    twin = add(spark, good, "k0", "e0", "train", 1.0, "d0")
    assert only(q.unique(twin, ["key"])) == (False, 1)
    mixed = add(spark, good, "k99", "e0", "val", 1.0, "d")
    assert only(q.constant(mixed, ["entity"], ["part"])) == (False, 1)
    assert only(q.no_leakage(mixed, "entity", "part")) == (False, 1)
    unknown = add(spark, good, "k99", "e9", None, 1.0, "d")
    assert only(q.domain(unknown, "part", ["train", "val"])) == (False, 1)
    assert only(q.only_partitions(unknown, "part", ["train", "val"])) == (False, 1)
    assert only(q.only_partitions(good, "part", ["train"])) == (False, 10)
    assert only(q.expected_counts(good, "part", {"train": 9, "val": 10})) == (False, 2)
    assert only(q.expected_counts(good, "part", {"train": 10})) == (False, 2)
    assert only(q.expected_counts(good, "part", {"train": 10, "val": 10, "test": 1})) == (False, 2)
    assert only(q.not_empty(good.where("false"))) == (False, 1)
    assert only(q.required_columns(good, ["zzz"])) == (False, 1)
    assert only(q.same_keys(good, good.where("key <> 'k3'"), ["key"])) == (False, 1)
    other = good.withColumn("v", F.when(F.col("key") == "k3", 9.5).otherwise(F.col("v")))
    assert only(q.within_tolerance(good, other, ["key"], "v", 1e-9)) == (False, 1)
    assert only(q.recorded_choice(good, other, ["key"], "v")) == (False, 1)
    bytes_ = good.withColumn("digest", F.when(F.col("key") == "k3", "x").otherwise(F.col("digest")))
    assert only(q.same_bytes(good, bytes_, ["key"], "digest")) == (False, 1)
    assert only(q.shared_digest(good.union(bytes_), ["key"], "digest")) == (False, 1)
    plan = state(q.planned(good, good.where("entity <> 'e1'"), ["entity"]))
    assert plan == {"plan complete": (False, 1), "nothing unplanned": (True, 0)}
    plan = state(q.planned(good.where("entity <> 'e1'"), good, ["entity"]))
    assert plan == {"plan complete": (True, 0), "nothing unplanned": (False, 1)}


@pytest.mark.parametrize("value", [float("nan"), float("inf"), None, 0.0])
def test_row_checks_count_null_and_nan(spark, good, value):
    bad = add(spark, good, "k77", "e0", "train", value, "d")
    report = q.rows(bad, {"finite and positive": is_finite(F.col("v")) & (F.col("v") > 0)}, "key")
    row = report.first()
    assert (row["passed"], row["n_bad"], row["detail"]) == (False, 1, "k77")


def test_require_names_every_failure(spark, good):
    twin = add(spark, good, "k0", "e0", "gone", 1.0, "d0")
    report = q.combine([q.unique(twin, ["key"]), q.domain(twin, "part", ["train", "val"]), q.not_empty(twin)])
    with pytest.raises(q.ConstraintError, match=r"domain part: 1 bad.*unique key: 1 bad"):
        q.require(report)


def test_projection_contract(good):
    assert q.projection(good, ["v", "key"], deny=["digest"]).columns == ["v", "key"]
    with pytest.raises(q.ConstraintError, match="leaks"):
        q.projection(good, ["v", "digest"], deny=["digest"])
    with pytest.raises(q.ConstraintError, match="lacks"):
        q.projection(good, ["zzz"])


def test_sealed_partition_is_refused_before_reading(good):
    with pytest.raises(q.ConstraintError, match="not open"):
        q.open_partition(good, "part", "test", ["train", "val"])
    assert q.open_partition(good, "part", "val", ["train", "val"]).count() == 10


def test_sources_clash(spark):
    a = spark.createDataFrame([("1",), ("2",)], "e string")
    b = spark.createDataFrame([("2",), ("3",)], "e string")
    pooled = q.pooled_sources({"x": a, "y": b}, "e")
    assert [tuple(r) for r in q.clashing_entities(pooled, "e").collect()] == [("2", 2)]
