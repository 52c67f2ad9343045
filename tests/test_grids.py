import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gaugework.operators import constraints as q
from gaugework.operators import grids, scoring


def frame(spark, arrays, **extra):
    rows = [(i, np.asarray(a, float).ravel().tolist(), a.shape[0], a.shape[1]) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "id int, v array<double>, h int, w int")


HW = ("h", "w")


def grid_of(rows, shapes, kind=bool):
    return [np.array(r[1], kind).reshape(shapes[r[0]]) for r in sorted(rows)]


def slow_components(mask, diagonal):
    """Flood fill, cell by cell."""
    label = np.zeros(mask.shape, int)
    count = 0
    for y, x in zip(*np.nonzero(mask)):
        if label[y, x]:
            continue
        count += 1
        todo = [(y, x)]
        label[y, x] = count
        while todo:
            a, b = todo.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if (dy or dx) and (diagonal or not (dy and dx)):
                        c, d = a + dy, b + dx
                        if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not label[c, d]:
                            label[c, d] = count
                            todo.append((c, d))
    return label


def slow_region(values, threshold):
    label = slow_components(values > threshold, True)
    sizes = np.bincount(label.ravel())
    sizes[0] = 0
    region = label == sizes.argmax()
    ground = np.pad(~region, 1, constant_values=True)
    outside = slow_components(ground, False)
    return region | ~(outside == outside[0, 0])[1:-1, 1:-1]


def test_largest_region_matches_flood_fill(spark):
    rng = np.random.default_rng(1)
    arrays = [rng.random(s) for s in [(9, 7)] * 20 + [(16, 16)] * 20 + [(1, 12), (12, 1)]]
    spiral = np.zeros((11, 11))
    spiral[0, :] = spiral[:, 10] = spiral[10, :] = spiral[2:, 0] = spiral[2, :9] = spiral[2:9, 8] = spiral[8, 2:9] = 1
    arrays.append(spiral)
    df = frame(spark, arrays)
    got = df.select("id", grids.largest_region(F.col("v"), *HW, 0.45)).collect()
    for mask, a in zip(grid_of(got, [a.shape for a in arrays]), arrays):
        assert (mask == slow_region(a, 0.45)).all()


def test_region_rules(spark):
    disc = np.full((9, 9), -1000.0)
    disc[2:7, 2:7] = 50
    disc[4, 4] = -900  # enclosed hole: filled
    disc[0, 8] = 60  # speck: dropped
    twins = np.zeros((3, 5))
    twins[1, 0] = twins[1, 4] = 1  # equal sizes: the first one wins
    rows = frame(spark, [disc, twins]).select("id", grids.largest_region(F.col("v"), *HW, 0.0)).collect()
    a, b = grid_of(rows, [(9, 9), (3, 5)])
    assert a[2:7, 2:7].all() and a.sum() == 25
    assert b.sum() == 1 and b[1, 0]
    with pytest.raises(PySparkException, match="no cell above"):
        frame(spark, [twins]).select(grids.largest_region(F.col("v"), *HW, 5.0)).collect()


def test_erode(spark):
    mask = np.ones((6, 7))
    mask[2, 3] = 0
    thin = np.zeros((6, 7))
    thin[3, :] = 1
    rows = frame(spark, [mask, thin]).select("id", grids.erode(F.transform("v", lambda v: v > 0), *HW, 3)).collect()
    a, b = grid_of(rows, [(6, 7)] * 2)
    expected = np.array([[0 < y < 5 and 0 < x < 6 and mask[y - 1 : y + 2, x - 1 : x + 2].all() for x in range(7)] for y in range(6)])
    assert (a == expected).all() and not b.any()
    with pytest.raises(ValueError, match="odd"):
        grids.erode(F.col("v"), *HW, 4)


def test_resampling(spark):
    a = np.arange(32, dtype=float).reshape(4, 8)
    row = frame(spark, [a]).select(
        grids.area_average(F.col("v"), *HW, 2), grids.nearest(F.transform("v", lambda v: v > 13), *HW, 2, 4)
    ).first()
    assert row[0] == a.reshape(2, 2, 4, 2).mean(axis=(1, 3)).ravel().tolist()
    assert row[1] == (a > 13)[::2, ::2].ravel().tolist()


def slow_similarity(x, y, window, sigma):
    k = np.outer(grids.gaussian_taps(window, sigma), grids.gaussian_taps(window, sigma))
    out = np.zeros((x.shape[0] - window + 1, x.shape[1] - window + 1))
    for i in range(out.shape[0]):
        for j in range(out.shape[1]):
            a, b = x[i : i + window, j : j + window], y[i : i + window, j : j + window]
            ma, mb = (k * a).sum(), (k * b).sum()
            va, vb, vab = (k * a * a).sum() - ma**2, (k * b * b).sum() - mb**2, (k * a * b).sum() - ma * mb
            out[i, j] = (2 * ma * mb + 1e-4) * (2 * vab + 9e-4) / ((ma**2 + mb**2 + 1e-4) * (va + vb + 9e-4))
    return out


def test_unit_metrics_match_cell_by_cell(spark):
    rng = np.random.default_rng(2)
    shapes = [(14, 15), (20, 13), (14, 15)]
    rows = []
    for i, s in enumerate(shapes):
        a, b, m = rng.random(s), rng.random(s), np.ones(s, bool)
        m[0, :3] = False
        rows.append((i, a.ravel().tolist(), b.ravel().tolist(), m.ravel().tolist(), *s))
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>, m array<boolean>, h int, w int")
    got = df.select("id", grids.unit_metrics(F.col("a"), F.col("b"), F.col("m"), *HW).alias("x"), grids.local_similarity(F.col("a"), F.col("b"), *HW).alias("s")).collect()
    for r in got:
        _, a, b, m, h, w = rows[r["id"]]
        a, b, m = (np.array(v).reshape(h, w) for v in (a, b, m))
        d, sim = b - a, slow_similarity(a, b, 11, 1.5)
        inner = np.array([[m[i : i + 11, j : j + 11].all() for j in range(w - 10)] for i in range(h - 10)])
        expected = [
            np.abs(d).mean(), (d**2).mean(), 10 * np.log10(1 / (d**2).mean()), sim.mean(),
            np.abs(d[m]).mean(), (d[m] ** 2).mean(), 10 * np.log10(1 / (d[m] ** 2).mean()), sim[inner].mean(),
        ]
        assert np.allclose(list(r["x"]), expected) and r["s"] == pytest.approx(sim.mean())


def test_similarity_limits(spark):
    a = np.random.default_rng(4).random((12, 12))
    df = frame(spark, [a]).withColumn("m", F.transform("v", lambda v: F.lit(True)))
    x = df.select(grids.unit_metrics(F.col("v"), F.col("v"), F.col("m"), *HW).alias("x")).first()["x"]
    assert x["full_ssim"] == pytest.approx(1.0) and x["full_psnr"] == float("inf")
    thin = df.withColumn("m", F.transform("v", lambda v, i: i < 12))
    x = thin.select(grids.unit_metrics(F.col("v"), F.col("v"), F.col("m"), *HW).alias("x")).first()["x"]
    assert x["body_ssim"] is None and x["body_mae"] == 0.0
    with pytest.raises(PySparkException, match="smaller than the window"):
        frame(spark, [a[:5]]).select(grids.local_similarity(F.col("v"), F.col("v"), *HW)).collect()
    with pytest.raises(PySparkException, match="selects no cell"):
        none = df.withColumn("m", F.transform("v", lambda v: F.lit(False)))
        none.select(grids.unit_metrics(F.col("v"), F.col("v"), F.col("m"), *HW)).collect()


def test_equalization_lookup_ends_at_the_top(spark):
    rng = np.random.default_rng(5)
    rows = [(g, int(v)) for g, n in (("a", 5000), ("b", 40), ("c", 1)) for v in rng.integers(20, 60, n)]
    df = spark.createDataFrame(rows, "g string, b int")
    got = grids.clip_limited_equalize(df, ["g"], "b", 256, 4.0)
    assert got.count() == len(rows)
    for g in "abc":
        data = np.array([b for x, b in rows if x == g])
        hist = np.bincount(data, minlength=256)
        limit = max(1, int(4.0 * len(data) // 256))
        excess = np.maximum(hist - limit, 0).sum()
        flat = np.minimum(hist, limit) + excess // 256 + (np.arange(256) < excess % 256)
        lut = np.minimum(255, np.rint(flat.cumsum() * 255.0 / len(data))).astype(int)
        assert lut[255] == 255
        seen = {r["b"]: r["equalized"] for r in got.where(F.col("g") == g).collect()}
        assert seen == {b: lut[b] for b in set(data.tolist())}


def test_methods_see_only_their_input(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "e%d" % (i % 2), rng.random(144).tolist(), rng.random(144).tolist(), [True] * 144, 12, 12) for i in range(6)]
    df = spark.createDataFrame(rows, "id int, e string, ref array<double>, given array<double>, body array<boolean>, h int, w int")
    both = {"none": lambda a: a, "half": lambda a: a / 2}
    by_function = scoring.score_functions(df, ["id", "e"], "given", "ref", "body", "h", "w", both)
    by_column = scoring.score_methods(
        df, ["id", "e"], "given", "ref",
        {"none": lambda c: c, "half": lambda c: F.transform(c, lambda v: v / 2)},
    )
    pairs = by_function.join(by_column, ["id", "method"]).select("full_mae", "mae", "full_psnr", "psnr").collect()
    assert len(pairs) == 12 and all(r[0] == pytest.approx(r[1]) and r[2] == pytest.approx(r[3]) for r in pairs)
    q.require(q.shared_digest(by_function, ["id"], "input_digest"))

    def cheat(a):
        a += 1
        return a

    with pytest.raises(PySparkException, match="read-only"):
        scoring.score_functions(df, ["id"], "given", "ref", "body", "h", "w", {"x": cheat}).collect()
    with pytest.raises(PySparkException, match="changed the shape"):
        scoring.score_functions(df, ["id"], "given", "ref", "body", "h", "w", {"x": lambda a: a[1:]}).collect()


def test_preparation_order(spark):
    stored = np.full((8, 8), 24.0)
    stored[2:6, 2:6] = 1074.0
    out = scoring.prepare_unit(frame(spark, [stored]), "v", "h", "w", 1.0, -1024.0, -300.0, 40.0, 400.0, 2)
    row = out.first()
    assert (row["grid_height"], row["grid_width"]) == (4, 4)
    body = np.array(row["body"]).reshape(4, 4)
    assert body[1:3, 1:3].all() and body.sum() == 4
    clean = np.array(row["clean"]).reshape(4, 4)
    assert clean[1, 1] == pytest.approx((50 + 160) / 400) and clean[0, 0] == 0.0


def test_change_diagnostics_keep_raw_and_clipped_apart(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5, 0.5, 0.5], [1.5, -0.5, 0.5, 0.75])], "id int, g array<double>, r array<double>")
    row = scoring.change_summary(scoring.change_diagnostics(df, "g", "r")).first()
    assert (row["fraction_below"], row["fraction_above"], row["fraction_clamped"]) == (0.25, 0.25, 0.5)
    assert row["mean_raw_change"] == pytest.approx(2.25 / 4) and row["mean_kept_change"] == pytest.approx(1.25 / 4)
    assert row["unit_change_q50"] == pytest.approx(2.25 / 4) and (row["raw_min"], row["raw_max"]) == (-0.5, 1.5)


def test_training_pairs_contract(spark):
    row = ([0.1, 0.2], [0.1, 0.3], "7", "Train/CT/7/a.dcm", "Train", "A", 3, "train", [True, False])
    df = spark.createDataFrame([row], "degraded array<double>, clean array<double>, subject_id string, sample_key string, source_archive string, acquisition_group string, geometric_slice_index int, split string, mask array<boolean>")
    assert tuple(scoring.training_pairs(df, "split", "train", ["train"]).columns) == scoring.PAIR_FIELDS
    with pytest.raises(q.ConstraintError, match="not open"):
        scoring.training_pairs(df, "split", "test", ["train"])
    with pytest.raises(q.ConstraintError, match="leaks"):
        scoring.training_pairs(df, "split", "train", ["train"], (*scoring.PAIR_FIELDS, "mask"))
    bad = df.withColumn("degraded", F.array(F.lit(0.5)))
    with pytest.raises(PySparkException, match="unusable pair Train/CT/7/a.dcm: shapes differ"):
        scoring.training_pairs(bad, "split", "train", ["train"]).count()
