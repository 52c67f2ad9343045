"""Sliced plans give the same rows as plain windows, also with one dominant group."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from gaugework.functions import keys
from gaugework.operators.ordering import (
    Ordering, canonical_order, largest_group, quantiles, rank, sequence_check, sequence_digest, sequences_differ,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows; group 'hot' has two thirds of them, one group is null, positions repeat."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 else rng.choice(["a", "b", "c", None])
        rows.append((i, g, rng.randint(0, 40), float(rng.randint(-50, 50))))
    return spark.createDataFrame(rows, "id long, g string, pos long, v double").repartition(7).cache()


def test_largest_group(skewed):
    assert largest_group(skewed, ["g"], 10) == 2000
    assert largest_group(skewed, [], 10) == 3000


@pytest.mark.parametrize("group", [["g"], []])
def test_rank_matches_window(skewed, group):
    keys = group or [F.lit(0)]
    w = Window.partitionBy(*keys).orderBy("pos", "id")
    expected = skewed.select("id", (F.row_number().over(w) - 1).cast("long").alias("rank"))
    ordering = Ordering(skewed, group, ["pos", "id"], slice_rows=100)
    assert ordering.is_sliced
    assert ordering.rank().select("id", "rank").exceptAll(expected).isEmpty()
    assert rank(skewed, group, ["pos", "id"]).select("id", "rank").exceptAll(expected).isEmpty()


def test_no_slice_holds_a_hot_group(skewed):
    rows = Ordering(skewed, ["g"], ["pos", "id"], slice_rows=100).rows
    assert rows.groupBy("g", "_slice").count().agg(F.max("count")).first()[0] < 1000


def test_slices_are_shuffled_even_after_a_join_on_the_group(spark, skewed):
    lookup = skewed.select("g").distinct().withColumn("x", F.lit(1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skewed.join(lookup, "g")
        plan = Ordering(joined, ["g"], ["pos", "id"], slice_rows=100).rank()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "REPARTITION_BY_COL" in plan


def test_previous_and_running(skewed):
    w = Window.partitionBy("g").orderBy("pos", "id")
    expected = skewed.select(
        "id",
        F.lag("id").over(w).alias("prev_id"),
        F.lag("v").over(w).alias("prev_v"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"),
        F.sum("v").over(Window.partitionBy("g")).alias("t"),
    )
    for rows in (100, 10**6):
        o = Ordering(skewed, ["g"], ["pos", "id"], slice_rows=rows)
        got = (
            o.previous(["id", "v"]).select("id", "prev_id", "prev_v")
            .join(o.with_group_total("v", "s", "t").select("id", "s", "t"), "id")
            .join(o.previous_max("v", "m").select("id", "m"), "id")
            .select("id", "prev_id", "prev_v", "s", "m", "t")
        )
        assert got.exceptAll(expected).isEmpty()
        assert o.running_sum("v", "s").select("id", "s").exceptAll(expected.select("id", "s")).isEmpty()


def test_quantiles_are_exact(skewed):
    probs = [0.0, 0.01, 0.05, 0.5, 0.95, 1.0]
    got = {r["g"]: r["quantiles"] for r in quantiles(skewed, ["g"], "v", probs).collect()}
    data = {}
    for r in skewed.collect():
        data.setdefault(r["g"], []).append(r["v"])
    assert set(got) == set(data)
    for g, values in data.items():
        assert np.allclose(got[g], np.quantile(values, probs))
    whole = quantiles(skewed, [], "v", probs).first()["quantiles"]
    assert np.allclose(whole, np.quantile(sum(data.values(), []), probs))


def test_quantiles_of_close_values_zeros_and_infinities(spark):
    """Values that share all leading bits, signs, zeros, subnormals and what is not finite."""
    rng = np.random.default_rng(3)
    groups = {
        "close": 1.0 + rng.integers(0, 40, 500) * 2.0**-52,
        "signs": np.concatenate([-rng.random(200), rng.random(201), [0.0, -0.0]]),
        "tiny": rng.integers(-30, 30, 99) * 5e-324,
        "huge": np.array([-np.inf, -1e308, 0.5, 1e308, np.inf]),
        "one": np.array([7.25]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    got = {r["g"]: r["quantiles"] for r in quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == set(groups)
    for g in ("close", "signs", "tiny", "one"):
        assert got[g] == pytest.approx(np.quantile(groups[g], probs).tolist(), rel=1e-15, abs=1e-323)
    assert got["huge"][0] == -np.inf and got["huge"][3] == 0.5 and got["huge"][5] == np.inf
    plan = quantiles(df, ["g"], "v", probs)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "percentile" not in plan


def test_order_keys_are_ordered_and_undone(spark):
    rng = np.random.default_rng(6)
    bits = rng.integers(0, 2**64, 4_000, dtype=np.uint64).view(np.float64)
    edges = [0.0, 5e-324, 2.0**-1022, np.nextafter(2.0**-1022, 0), np.finfo(float).max, np.inf, 1.0, np.nextafter(1, 2), np.nextafter(1, 0)]
    values = np.concatenate([bits[~np.isnan(bits)], edges, -np.array(edges), 2.0 ** np.arange(-1074, 1024), 10.0 ** np.arange(-300, 300)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(float("nan"),), (None,)], "v double")
    rows = df.select("v", keys.order_key("v").alias("k")).withColumn("back", keys.from_order_key(F.col("k"))).collect()
    assert rows[-1]["k"] is None and np.isnan(rows[-2]["back"]) and rows[-2]["k"] == max(r["k"] for r in rows[:-1])
    finite = rows[:-2]
    assert all(r["v"] == r["back"] for r in finite)
    finite.sort(key=lambda r: r["v"])
    assert all(a["k"] < b["k"] if a["v"] < b["v"] else a["k"] == b["k"] for a, b in zip(finite, finite[1:]))


def test_materialized_copy_is_used_on_both_sides(skewed):
    o = Ordering(skewed, ["g"], ["pos", "id"], slice_rows=100, materialize=True)
    assert o.rank().count() == 3000


def test_sequence_digest_is_flat_for_one_block_and_layout_free(spark):
    keys = [f"k{i}" for i in range(1000)]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, k string")
    flat = hashlib.sha256("".join(k + "\x1f" for k in keys).encode()).hexdigest()
    assert sequence_digest(df, ["i"], "k").first()["digest"] == flat
    blocks = sequence_digest(df, ["i"], "k", block=64).first()["digest"]
    again = sequence_digest(df.orderBy(F.rand(1)).repartition(5), ["i"], "k", block=64, slice_rows=50).first()
    assert again["digest"] == blocks != flat and again["rows"] == 1000
    swapped = df.withColumn("i", F.when(F.col("i") == 0, 1).when(F.col("i") == 1, 0).otherwise(F.col("i")))
    assert sequence_digest(swapped, ["i"], "k", block=64).first()["digest"] != blocks


def test_sequence_digest_of_nothing_is_a_row(spark):
    none = spark.createDataFrame([], "i long, k string")
    row = sequence_digest(none, ["i"], "k").first()
    assert (row["rows"], row["digest"]) == (0, hashlib.sha256(b"").hexdigest())


def test_sequence_check_and_differences(spark):
    df = spark.range(500).select(F.col("id").alias("p"), F.concat(F.lit("k"), F.col("id") % 90).alias("k"))
    check = lambda x: tuple(sequence_check(x, "p", "k").first())
    values = [int(hashlib.sha256(f"k{i % 90}".encode()).hexdigest()[:12], 16) for i in range(500)]
    p, base = keys.SEQUENCE_PRIME, keys.SEQUENCE_BASE
    assert check(df) == (500, sum(v % p * pow(base, i, p) for i, v in enumerate(values)) % p)
    assert check(df.orderBy(F.rand(2)).repartition(7)) == check(df) and check(df.where("false")) == (0, 0)
    swapped = df.withColumn("p", F.when(F.col("p") == 3, 4).when(F.col("p") == 4, 3).otherwise(F.col("p")))
    dropped = df.where("p <> 77")
    for other, wrong, first in ((swapped, 2, 3), (dropped, 1, 77)):
        assert check(other) != check(df)
        row = sequences_differ(df, other, "p", "k").first()
        assert (row["different_positions"], row["first_difference"]) == (wrong, first)
    assert tuple(sequences_differ(df, df.repartition(3), "p", "k").first()) == (500, 500, 0, None)
    assert tuple(sequences_differ(df.where("false"), df.where("false"), "p", "k").first()) == (0, 0, 0, None)


def test_canonical_order(spark):
    df = spark.createDataFrame([("10", 0), ("2", 1), ("2", 0), ("P2", 0), ("p10b", 0)], "e string, i int")
    got = [(r["e"], r["i"]) for r in canonical_order(df, "e", "i").orderBy("position").collect()]
    assert got == [("2", 0), ("2", 1), ("10", 0), ("P2", 0), ("p10b", 0)]
