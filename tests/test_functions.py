import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gaugework.functions import arrays, directions, geometry, keys, values


def col(spark, data, kind, fn):
    return [r[0] for r in spark.createDataFrame([(v,) for v in data], f"c {kind}").select(fn(F.col("c"))).collect()]


def test_natural_order(spark):
    ids = ["21", "10", "2", "p10b", "P2", "a", "", "007", "7", "a1", "ab", "1a"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = [r[0] for r in df.orderBy(keys.natural_key("id"), "id").collect()]
    assert got == ["", "1a", "2", "007", "7", "10", "21", "a", "a1", "ab", "P2", "p10b"]


def test_keys(spark):
    data = ["a/b.dcm", "/a/b", "a\\b", "a/../b", "C:/x", "", "   ", "a\x1fb", "a/b:c", None]
    assert col(spark, data, "string", keys.is_portable_key) == [True, False, False, False, False, False, True, True, True, False]
    assert col(spark, data, "string", keys.key_fault) == [None] * 5 + ["blank", "blank", "separator", None, "blank"]
    assert col(spark, ["a\\b\\c"], "string", keys.canonical_key) == ["a/b/c"]
    with pytest.raises(PySparkException, match="unusable key"):
        col(spark, ["a\x1fb"], "string", keys.strict_key)


def test_keyed_seed_is_the_big_endian_digest_head(spark):
    expected = int.from_bytes(hashlib.sha256("v1\x1f2026\x1fa/b".encode()).digest()[:8], "big")
    assert col(spark, ["a/b"], "string", lambda c: keys.keyed_seed("v1", 2026, c)) == [expected]


def test_digests(spark):
    assert col(spark, ["x", None], "string", keys.short_hash) == [hashlib.sha256(b"x").hexdigest()[:12], None]
    a, b = col(spark, ["l1\r\nl2\n", "l1\nl2\n"], "string", keys.text_digest)
    assert a == b
    same = lambda c: keys.array_digest(c, F.lit("1x2"))
    x, y = col(spark, [[0.5, 0.25], [0.25, 0.5]], "array<double>", same)
    assert x != y
    assert col(spark, [[0.5, 0.25]], "array<double>", lambda c: keys.array_digest(c, F.lit("2x1"))) != [x]


def test_probe_positions(spark):
    assert col(spark, [10, 3, 0], "int", lambda c: keys.probe_positions(c, 4)) == [[0, 3, 6, 9], [0, 1, 2], []]


def test_quantize_rounds_half_to_even(spark):
    data = [0.5 / 255, 1.5 / 255, 2.5 / 255, 1.0, -0.1, 1.2]
    expected = np.rint(np.clip(data, 0, 1) * 255).astype(int).tolist()
    assert col(spark, data, "double", values.quantize8) == expected


def test_window_range_and_integers(spark):
    assert col(spark, [-200.0, 40.0, 300.0], "double", lambda c: values.window_normalize(c, 40, 400)) == [0.0, 0.5, 1.0]
    with pytest.raises(ValueError, match="positive"):
        values.window_normalize(F.lit(1), 0, 0)
    data = [1.0 + 5e-7, 1.1, float("nan"), None, float("inf")]
    assert col(spark, data, "double", values.in_range) == [True, False, False, False, False]
    data = [3.0, 3.5, float("nan"), None, float("inf")]
    assert col(spark, data, "double", values.is_strict_integer) == [True, False, False, False, False]
    with pytest.raises(PySparkException, match="not an integer"):
        col(spark, [3.5], "double", values.strict_integer)


def test_psnr_limits(spark):
    assert col(spark, [0.0, 0.01], "double", values.psnr) == [float("inf"), pytest.approx(20.0)]


def test_sentinels(spark):
    df = spark.createDataFrame([(5, 5, None), (4, 5, 3), (4, 3, 5), (9, 5, 3), (1, None, None)], "x int, a int, b int")
    got = [r[0] for r in df.select(values.sentinel_flag(F.col("x"), F.col("a"), F.col("b"))).collect()]
    assert got == [True, True, True, False, None]


def test_calibration(spark):
    rows = [("HU", None, None, "CT"), ("OD", 1.0, 0.0, "CT"), (None, 1.0, -1000.0, "CT"), (None, 1.0, None, "CT"), (None, None, None, "CT"), (None, 1.0, 0.0, "MR")]
    df = spark.createDataFrame(rows, "lut string, slope double, intercept double, modality string")
    got = [tuple(r[0]) for r in df.select(values.calibration(*[F.col(c) for c in df.columns])).collect()]
    assert got == [
        ("lookup", None), (None, "lookup table unit OD"), ("affine", None), (None, "missing intercept"),
        (None, "missing slope and intercept"), (None, "wrong modality"),
    ]


def test_noise_depends_on_the_key_only(spark):
    df = spark.range(20000).select("id", values.keyed_normal("v", 1, F.col("id")).alias("z"))
    a = {r["id"]: r["z"] for r in df.collect()}
    b = {r["id"]: r["z"] for r in df.repartition(3).orderBy(F.desc("id")).collect()}
    assert a == b
    z = np.array(list(a.values()))
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03
    noisy = spark.range(500).select(values.keyed_noise(F.lit(0.99), "v", 1, F.col("id"), floor=0.02, signal=0.05).alias("n"))
    assert noisy.agg(F.max("n"), F.min("n")).first()[0] == 1.0


def test_directions(spark):
    df = spark.createDataFrame([("body_psnr", 1.0), ("full_mae", 1.0), ("full_mae", -1.0), ("full_ssim", 0.0)], "m string, d double")
    d = directions.metric_direction(F.col("m"))
    rows = df.select(directions.oriented(d, F.col("d")), directions.is_improvement(d, F.col("d"))).collect()
    assert [tuple(r) for r in rows] == [(1.0, True), (-1.0, False), (1.0, True), (0.0, False)]
    with pytest.raises(PySparkException, match="no direction"):
        spark.createDataFrame([("full_dice",)], "m string").select(directions.metric_direction(F.col("m"))).collect()


def test_geometry(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0, 1.0, 0.0], [1.0, 2.0, 7.5]), ([1.0, 0.0, 0.0, 0.0, 0.0, 1.0], [1.0, 2.0, 7.5]), ([1.0, 0.0, 0.0, 2.0, 0.0, 0.0], [0.0, 0.0, 0.0])], "o array<double>, p array<double>")
    n = geometry.plane_normal(F.col("o"))
    rows = df.select(n.alias("n"), geometry.projected_position(F.col("p"), n).alias("s"), geometry.is_axial(n).alias("a")).collect()
    assert rows[0]["n"] == [0, 0, 1] and rows[0]["s"] == 7.5 and rows[0]["a"] is True
    assert rows[1]["n"] == [0, -1, 0] and rows[1]["s"] == -2.0 and rows[1]["a"] is False
    assert rows[2]["n"] is None


def test_array_error_routes_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.random(9).tolist(), rng.random(9).tolist(), (rng.random(9) > 0.4).tolist()) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>, m array<boolean>")
    full = df.select("id", arrays.array_error(F.col("a"), F.col("b")).alias("e")).select("id", "e.*")
    for r, (_, a, b, _) in zip(full.orderBy("id").collect(), rows):
        d = np.array(b) - np.array(a)
        assert r["mae"] == pytest.approx(np.abs(d).mean()) and r["mse"] == pytest.approx((d**2).mean())
        assert r["psnr"] == pytest.approx(10 * math.log10(1 / (d**2).mean()))
    grid = df.select("id", F.posexplode(F.arrays_zip("a", "b", "m")).alias("i", "c")).where("c.m").groupBy("id").agg(
        F.avg(F.abs(F.col("c.b") - F.col("c.a"))).alias("mae")
    )
    masked = df.select("id", arrays.array_error(F.col("a"), F.col("b"), F.col("m")).alias("e"))
    both = masked.join(grid, "id").select("e.mae", "mae").collect()
    assert len(both) == 5 and all(x == pytest.approx(y) for x, y in both)


def test_identical_arrays_and_empty_masks(spark):
    df = spark.createDataFrame([([0.1, 0.2], [False, False])], "a array<double>, m array<boolean>")
    e, m = df.select(arrays.array_error(F.col("a"), F.col("a")), arrays.array_error(F.col("a"), F.col("a"), F.col("m"))).first()
    assert e["psnr"] == float("inf") and m["n"] == 0 and m["mae"] is None


def test_pair_and_mask_faults(spark):
    rows = [
        ([0.1, 0.2], [0.1, 0.2], [True, False]), ([0.1], [0.1, 0.2], [True]), ([], [0.1], []),
        ([0.1, float("nan")], [0.1, 0.2], [False, False]), ([0.1, 0.2], [0.1, 1.5], [True]),
    ]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, m array<boolean>")
    got = [tuple(r) for r in df.select(arrays.pair_fault(F.col("a"), F.col("b")), arrays.mask_fault(F.col("m"), F.col("a"))).collect()]
    assert got == [
        (None, None), ("shapes differ", None), ("reference empty", "mask selects nothing"),
        ("reference not finite", "mask selects nothing"), ("prediction out of range", "mask shape differs"),
    ]


def test_outlier_cells(spark):
    df = spark.createDataFrame([([0.0, 9.0, 0.0, 8.0],)], "a array<double>")
    cells = df.select(arrays.outlier_cells(F.col("a"), 5.0, 2)).first()[0]
    assert [tuple(c) for c in cells] == [(0, 1, 9.0), (1, 1, 8.0)]
    assert len(df.select(arrays.outlier_cells(F.col("a"), 5.0, 2, cap=1)).first()[0]) == 1


def test_exact_array_digest(spark):
    def digests(schema, *arrays):
        df = spark.createDataFrame([(a,) for a in arrays], f"a {schema}")
        return [r[0] for r in df.select(keys.typed_array_digest(df, "a")).collect()]

    rows = [[0.1], [0.1000003], [0.1, 0.2], [0.1, None], [None, 0.1], [], [float("nan")], [1.0, 2.0], [12.0]]
    found = digests("array<double>", *rows, None)
    assert found[-1] is None and len(set(found)) == len(rows) + 1 and digests("array<double>", *rows) == found[:-1]
    assert digests("array<float>", [1.0, 2.0])[0] not in found
    assert len(set(digests("array<double>", [0.1], [float(np.nextafter(0.1, 1))]))) == 2
