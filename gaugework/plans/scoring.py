"""Array and grid metrics, side-by-side scoring, and neighbourhood operators.

Every 64-value vector serves as an 8 x 8 grid; values are shifted into [0, 1].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugework.functions.arrays import array_error, mask_fault, pair_fault
from gaugework.functions.values import affine_rescale, keyed_noise, quantize8
from gaugework.operators import constraints as q
from gaugework.operators import grids, scoring, stats
from gaugework.plans.registry import digest_sql, query, r, rounded, table, uniform_sql

SIDE = 8
WINDOW, SIGMA = 5, 1.0


def _grids(spark: SparkSession, d: str) -> DataFrame:
    """``vec_id, label, ref, height, width`` with values shifted to the middle of [0, 1]."""
    shifted = F.transform("embedding", lambda v: v.cast("double") + F.lit(0.5))
    return table(spark, d, "embeddings").select(
        "vec_id",
        "label",
        F.transform(shifted, lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).alias("ref"),
        F.lit(SIDE).alias("height"),
        F.lit(SIDE).alias("width"),
    )


_CELLS = """cells AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i,
  least(greatest(unnest(embedding)::DOUBLE + 0.5, 0), 1) AS ref FROM embeddings)"""


def _noisy(spark: SparkSession, d: str) -> DataFrame:
    """Grids with a keyed corruption: the same noise for every method and any row order."""
    noisy = F.transform(
        "ref",
        lambda v, i: keyed_noise(v, "grid_v1", 2026, F.col("vec_id"), i, floor=0.02, signal=0.05),
    )
    return _grids(spark, d).withColumn("given", noisy)


_N = digest_sql("'grid_v1'", "2026", "vec_id", "i")
_NOISY = f"""{_CELLS},
hashed AS (SELECT *, {_N} AS h FROM cells),
noisy AS (SELECT vec_id, label, i, i // 8 AS y, i % 8 AS x, ref,
  least(greatest(ref + (0.02 + 0.05 * sqrt(ref)) * sqrt(-2 * ln({uniform_sql('h', 0)})) * cos(2 * pi() * {uniform_sql('h', 1)}), 0), 1) AS given
  FROM hashed)"""


def _psnr(mse: str) -> str:
    return f"10 * log10(1 / ({mse}))"


@query(
    "array_error",
    f"""WITH {_NOISY}
SELECT vec_id, count(*) AS n, round(avg(abs(given - ref)), 8) AS mae, round(avg((given - ref) ** 2), 8) AS mse,
       round({_psnr('avg((given - ref) ** 2)')}, 5) AS psnr FROM noisy GROUP BY vec_id""",
)
def array_error_query(spark: SparkSession, d: str) -> DataFrame:
    e = array_error(F.col("ref"), F.col("given"))
    out = _noisy(spark, d).select("vec_id", e.alias("e")).select("vec_id", "e.*")
    return rounded(rounded(out, ["mae", "mse"], 8), ["psnr"], 5)


@query(
    "masked_error",
    f"""WITH {_NOISY}
SELECT vec_id, count_if(ref > 0.5) AS n, round(avg(abs(given - ref)) FILTER (ref > 0.5), 8) AS mae,
       round(avg((given - ref) ** 2) FILTER (ref > 0.5), 8) AS mse,
       round({_psnr('avg((given - ref) ** 2) FILTER (ref > 0.5)')}, 5) AS psnr FROM noisy GROUP BY vec_id""",
)
def masked_error(spark: SparkSession, d: str) -> DataFrame:
    mask = F.transform("ref", lambda v: v > 0.5)
    out = _noisy(spark, d).select("vec_id", array_error(F.col("ref"), F.col("given"), mask).alias("e")).select("vec_id", "e.*")
    return rounded(rounded(out, ["mae", "mse"], 8), ["psnr"], 5)


@query(
    "pair_faults",
    """
WITH f AS (SELECT CASE WHEN list_min(embedding) < -0.2 - 1e-6 OR list_max(embedding) > 0.4 + 1e-6 THEN 'reference out of range'
                       WHEN label = 3 THEN 'shapes differ' END AS fault,
                  CASE WHEN list_max(embedding) <= 0.3 THEN 'mask selects nothing' END AS mask_fault FROM embeddings)
SELECT fault, mask_fault, count(*) AS units FROM f GROUP BY ALL""",
)
def pair_faults(spark: SparkSession, d: str) -> DataFrame:
    ref = F.col("embedding")
    pred = F.when(F.col("label") == 3, F.array(F.lit(0.1))).otherwise(F.transform(ref, lambda v: F.lit(0.1)))
    mask = F.transform(ref, lambda v: v > 0.3)
    return (
        table(spark, d, "embeddings")
        .select(pair_fault(ref, pred, -0.2, 0.4).alias("fault"), mask_fault(mask, ref).alias("mask_fault"))
        .groupBy("fault", "mask_fault")
        .agg(F.count("*").alias("units"))
    )


@query(
    "score_faults",
    """
WITH k AS (SELECT vec_id % 6 AS k FROM embeddings)
SELECT CASE k WHEN 0 THEN 'reference not finite' WHEN 1 THEN 'prediction out of range' WHEN 2 THEN 'reference empty'
         WHEN 3 THEN 'shapes differ' WHEN 4 THEN 'prediction not finite' END AS fault, count(*) AS units FROM k GROUP BY k""",
)
def score_faults(spark: SparkSession, d: str) -> DataFrame:
    """Every unit with a fault of its own kind, named by the checks that the scorers fail with."""
    units = _grids(spark, d).withColumn("k", F.col("vec_id") % 6)

    def first(c: Column, value: float) -> Column:
        return F.transform(c, lambda v, i: F.when(i == 0, F.lit(value)).otherwise(v.cast("double")))

    none = F.array().cast("array<double>")
    ref = F.when(F.col("k") == 0, first(F.col("ref"), float("nan"))).when(F.col("k") == 2, none).otherwise(F.col("ref"))
    pred = F.when(F.col("k") == 1, first(F.col("ref"), 7.0)).when(F.col("k") == 3, F.slice("ref", 1, 9))
    pred = pred.when(F.col("k") == 4, first(F.col("ref"), float("inf"))).otherwise(F.col("ref"))
    return units.select(pair_fault(ref, pred).alias("fault")).groupBy("fault").agg(F.count("*").alias("units"))


def _clip(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


#: Methods as array expressions: unchanged, shrunk towards the middle, stretched and clipped.
METHODS = {
    "none": lambda given: given,
    "shrink": lambda given: F.transform(given, lambda v: F.lit(0.8) * v + F.lit(0.1)),
    "stretch": lambda given: F.transform(given, lambda v: _clip(F.lit(1.5) * v - F.lit(0.25))),
}
_METHODS = """methods AS (SELECT vec_id, label, i, y, x, ref, given, m.method,
  CASE m.method WHEN 'none' THEN given WHEN 'shrink' THEN 0.8 * given + 0.1 ELSE least(greatest(1.5 * given - 0.25, 0), 1) END AS restored
  FROM noisy, (VALUES ('none'), ('shrink'), ('stretch')) m(method))"""


@query(
    "score_methods",
    f"""WITH {_NOISY}, {_METHODS}
SELECT vec_id, method, count(*) AS n, round(avg(abs(restored - ref)), 8) AS mae, round(avg((restored - ref) ** 2), 8) AS mse,
       round({_psnr('avg((restored - ref) ** 2)')}, 5) AS psnr FROM methods GROUP BY vec_id, method""",
)
def score_methods(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.score_methods(_noisy(spark, d), ["vec_id"], "given", "ref", METHODS)
    return rounded(rounded(out.drop("input_digest"), ["mae", "mse"], 8), ["psnr"], 5)


@query(
    "shared_inputs",
    f"""WITH {_NOISY}, {_METHODS},
s AS (SELECT vec_id, method, string_agg(given::VARCHAR, ',' ORDER BY i) AS seen FROM methods GROUP BY ALL),
b AS (SELECT vec_id FROM s GROUP BY vec_id HAVING count(DISTINCT seen) > 1)
SELECT 'shared input digest' AS "check", count(*) = 0 AS passed, count(*) AS n_bad, '' AS detail FROM b""",
)
def shared_inputs(spark: SparkSession, d: str) -> DataFrame:
    scored = scoring.score_methods(_noisy(spark, d), ["vec_id"], "given", "ref", METHODS)
    return q.shared_digest(scored, ["vec_id"], "input_digest")


@query(
    "method_comparison",
    f"""WITH {_NOISY}, {_METHODS},
u AS (SELECT vec_id, label, method, avg(abs(restored - ref)) AS mae, {_psnr('avg((restored - ref) ** 2)')} AS psnr FROM methods GROUP BY ALL),
e AS (SELECT label, method, count(*) AS n, avg(mae) AS mae, avg(psnr) AS psnr FROM u GROUP BY ALL),
d AS (SELECT a.method, a.label, a.mae - b.mae AS mae, a.psnr - b.psnr AS psnr FROM e a JOIN e b ON a.label = b.label AND b.method = 'none'
      WHERE a.method <> 'none'),
l AS (SELECT method, metric, value FROM d UNPIVOT (value FOR metric IN (mae, psnr)))
SELECT method, metric, count(*) AS entities, round(avg(value), 6) AS mean_delta,
       count_if(CASE metric WHEN 'psnr' THEN value ELSE -value END > 0) AS improved,
       count_if(CASE metric WHEN 'psnr' THEN value ELSE -value END < 0) AS worsened FROM l GROUP BY ALL""",
)
def method_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Score, average per entity, pair strictly with the unchanged input, count directions."""
    from gaugework.operators.joins import strict_pairs_of

    scored = scoring.score_methods(_noisy(spark, d), ["vec_id", "label"], "given", "ref", METHODS)
    entities = stats.entity_means(scored, ["method", "label"], ["mae", "psnr"])
    bound = table(spark, d, "embeddings").count()
    parts = []
    for name in ("shrink", "stretch"):
        pairs = strict_pairs_of(entities, "label", "method", name, "none", ["mae", "psnr"])
        summary = stats.paired_delta_summary(pairs, ["mae", "psnr"], ("mae",), ("psnr",), bound)
        parts.append(summary.withColumn("method", F.lit(name)))
    out = parts[0].unionByName(parts[1])
    return out.select(
        "method", "metric", F.col("n").alias("entities"), r("mean").alias("mean_delta"), "improved", "worsened"
    )


@query(
    "change_diagnostics",
    f"""WITH {_NOISY},
c AS (SELECT vec_id, label, given, 1.5 * given - 0.25 AS raw, least(greatest(1.5 * given - 0.25, 0), 1) AS kept FROM noisy),
u AS (SELECT vec_id, avg(abs(raw - given)) AS change FROM c GROUP BY vec_id)
SELECT count(DISTINCT vec_id) AS units, count(*) AS cells, round(avg((raw < 0)::INTEGER), 8) AS fraction_below,
       round(avg((raw > 1)::INTEGER), 8) AS fraction_above, round(avg((raw < 0 OR raw > 1)::INTEGER), 8) AS fraction_clamped,
       round(avg((kept = 0)::INTEGER), 8) AS fraction_at_low, round(avg((kept = 1)::INTEGER), 8) AS fraction_at_high,
       count(DISTINCT vec_id) FILTER (NOT isfinite(raw)) AS failures,
       round(avg(abs(raw - given)), 8) AS mean_raw_change, round(avg(abs(kept - given)), 8) AS mean_kept_change,
       round(min(raw), 8) AS raw_min, round(max(raw), 8) AS raw_max,
       round((SELECT quantile_cont(change, 0.05) FROM u), 8) AS unit_change_q05, round((SELECT quantile_cont(change, 0.5) FROM u), 8) AS unit_change_q50,
       round((SELECT quantile_cont(change, 0.95) FROM u), 8) AS unit_change_q95 FROM c""",
)
def change_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    units = _noisy(spark, d).select(
        "vec_id", "given", F.transform("given", lambda v: F.lit(1.5) * v - F.lit(0.25)).alias("raw")
    )
    out = scoring.change_summary(
        scoring.change_diagnostics(units, "given", "raw"), bound=table(spark, d, "embeddings").count()
    )
    return rounded(out, [c for c in out.columns if c not in ("units", "cells", "failures")], 8)


def _taps() -> list[float]:
    return grids.gaussian_taps(WINDOW, SIGMA).tolist()


def _windowed(value: str) -> str:
    """SQL: the weighted window over x, then over y."""
    rows = " + ".join(
        f"{w!r} * lead({value}, {k - WINDOW // 2}) OVER wx" if k >= WINDOW // 2 else f"{w!r} * lag({value}, {WINDOW // 2 - k}) OVER wx"
        for k, w in enumerate(_taps())
    )
    return rows


def _columns_sql(value: str) -> str:
    return " + ".join(
        f"{w!r} * lead({value}, {k - WINDOW // 2}) OVER wy" if k >= WINDOW // 2 else f"{w!r} * lag({value}, {WINDOW // 2 - k}) OVER wy"
        for k, w in enumerate(_taps())
    )


_MAP = f"""
prod AS (SELECT *, ref * ref AS aa, given * given AS bb, ref * given AS ab FROM noisy),
hx AS (SELECT vec_id, label, y, x, ref, given, {", ".join(f"{_windowed(c)} AS {n}" for c, n in (("ref", "a"), ("given", "b"), ("aa", "aa"), ("bb", "bb"), ("ab", "ab")))}
  FROM prod WINDOW wx AS (PARTITION BY vec_id, y ORDER BY x)),
hy AS (SELECT vec_id, label, y, x, ref, given, {", ".join(f"{_columns_sql(c)} AS {c}" for c in ("a", "b", "aa", "bb", "ab"))}
  FROM hx WINDOW wy AS (PARTITION BY vec_id, x ORDER BY y)),
smap AS (SELECT vec_id, label, y, x, ref, given, ((2 * a * b + 0.0001) * (2 * (ab - a * b) + 0.0009)) /
  ((a * a + b * b + 0.0001) * (aa - a * a + bb - b * b + 0.0009)) AS s FROM hy)"""


@query(
    "local_similarity",
    f"""WITH {_NOISY}, {_MAP}
SELECT vec_id, round(avg(s), 8) AS similarity FROM smap WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 GROUP BY vec_id""",
)
def local_similarity(spark: SparkSession, d: str) -> DataFrame:
    s = grids.local_similarity(
        F.col("ref"), F.col("given"), F.col("height"), F.col("width"), WINDOW, SIGMA
    )
    return _noisy(spark, d).select("vec_id", r(s, 8).alias("similarity"))


@query(
    "unit_metrics",
    f"""WITH {_NOISY}, {_MAP},
body AS (SELECT *, NOT (y = 0 AND x < 4) AS m FROM smap),
inner_cells AS (SELECT vec_id, y, x FROM body c WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 AND NOT (y <= 2 AND x < 6)),
s AS (SELECT b.vec_id, avg(s) AS body_ssim FROM body b JOIN inner_cells USING (vec_id, y, x) GROUP BY b.vec_id)
SELECT vec_id, round(avg(abs(given - ref)), 8) AS full_mae, round(avg((given - ref) ** 2), 8) AS full_mse,
       round({_psnr('avg((given - ref) ** 2)')}, 5) AS full_psnr,
       round(avg(CASE WHEN y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 THEN s END), 8) AS full_ssim,
       round(avg(CASE WHEN m THEN abs(given - ref) END), 8) AS body_mae, round(avg(CASE WHEN m THEN (given - ref) ** 2 END), 8) AS body_mse,
       round({_psnr('avg(CASE WHEN m THEN (given - ref) ** 2 END)')}, 5) AS body_psnr, round(any_value(body_ssim), 8) AS body_ssim
FROM body JOIN s USING (vec_id) GROUP BY vec_id""",
)
def unit_metrics(spark: SparkSession, d: str) -> DataFrame:
    body = F.transform("ref", lambda v, i: ~((i < SIDE) & (F.pmod(i, F.lit(SIDE)) < 4)))
    m = grids.unit_metrics(
        F.col("ref"), F.col("given"), F.col("body"), F.col("height"), F.col("width"), WINDOW, SIGMA
    )
    out = _noisy(spark, d).withColumn("body", body).select("vec_id", m.alias("m")).select("vec_id", "m.*")
    short = ["full_psnr", "body_psnr"]
    return rounded(rounded(out, short, 5), [c for c in out.columns if c not in ("vec_id", *short)], 8)


_MASK = """mask AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, ref > 0.45 AS m FROM cells)"""


@query(
    "erode",
    f"""WITH {_CELLS}, {_MASK},
k AS (SELECT a.vec_id, a.y, a.x, count_if(b.m) = 9 AS kept FROM mask a JOIN mask b
      ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)
SELECT vec_id, (count_if(kept)) AS cells, coalesce(string_agg((y * 8 + x)::VARCHAR, ',' ORDER BY y * 8 + x) FILTER (WHERE kept), '') AS kept
FROM k GROUP BY vec_id""",
)
def erode(spark: SparkSession, d: str) -> DataFrame:
    mask = F.transform("ref", lambda v: v > 0.45)
    rows = _grids(spark, d).withColumn("m", mask).select("vec_id", grids.erode(F.col("m"), F.col("height"), F.col("width"), 3).alias("e"))
    return rows.select("vec_id", *_shown("e", "kept"))


def _shown(mask: str, name: str) -> list[Column]:
    places = F.filter(F.transform(mask, lambda m, i: F.when(m, i)), lambda v: v.isNotNull())
    return [
        F.size(places).cast("long").alias("cells"),
        F.array_join(F.transform(places, lambda v: v.cast("string")), ",").alias(name),
    ]


@query(
    "largest_region",
    f"""WITH RECURSIVE {_CELLS}, m AS (SELECT vec_id, i::INTEGER AS i, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x, ref > 0.5 AS m FROM cells),
walk(vec_id, root, i) AS (
  SELECT vec_id, i, i FROM m WHERE m
  UNION
  SELECT w.vec_id, w.root, b.i FROM walk w JOIN m a ON a.vec_id = w.vec_id AND a.i = w.i
  JOIN m b ON b.vec_id = w.vec_id AND b.m AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND b.i <> a.i),
lab AS (SELECT vec_id, i, min(root) AS label FROM walk GROUP BY ALL),
big AS (SELECT vec_id, first(label ORDER BY n DESC, label) AS label FROM (SELECT vec_id, label, count(*) AS n FROM lab GROUP BY ALL) GROUP BY vec_id),
region AS (SELECT m.vec_id, m.i, m.y, m.x, lab.label IS NOT NULL AND lab.label = big.label AS inside
           FROM m JOIN big USING (vec_id) LEFT JOIN lab ON lab.vec_id = m.vec_id AND lab.i = m.i),
outer_cells(vec_id, i) AS (
  SELECT vec_id, i FROM region WHERE NOT inside AND (y IN (0, 7) OR x IN (0, 7))
  UNION
  SELECT o.vec_id, b.i FROM outer_cells o JOIN region a ON a.vec_id = o.vec_id AND a.i = o.i
  JOIN region b ON b.vec_id = o.vec_id AND NOT b.inside AND abs(a.y - b.y) + abs(a.x - b.x) = 1)
SELECT r.vec_id, count(*) AS cells, string_agg(r.i::VARCHAR, ',' ORDER BY r.i) AS region
FROM region r LEFT JOIN outer_cells o ON o.vec_id = r.vec_id AND o.i = r.i WHERE o.i IS NULL GROUP BY r.vec_id""",
)
def largest_region(spark: SparkSession, d: str) -> DataFrame:
    region = grids.largest_region(F.col("ref"), F.col("height"), F.col("width"), 0.5)
    return _grids(spark, d).select("vec_id", region.alias("g")).select("vec_id", *_shown("g", "region"))


@query(
    "resample",
    f"""WITH {_CELLS}, b AS (SELECT vec_id, i // 16 AS y, (i % 8) // 2 AS x, avg(ref) AS v FROM cells GROUP BY ALL)
SELECT vec_id, (y * 4 + x)::INTEGER AS cell, round(v, 8) AS value FROM b""",
)
def resample(spark: SparkSession, d: str) -> DataFrame:
    small = grids.area_average(F.col("ref"), F.col("height"), F.col("width"), 2)
    return _grids(spark, d).select("vec_id", small.alias("s")).select("vec_id", F.posexplode("s").alias("cell", "value")).select(
        "vec_id", "cell", r("value", 8).alias("value")
    )


@query(
    "prepare_units",
    f"""WITH {_CELLS}, cal AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, ref * 200 - 60 AS v FROM cells),
w AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, (least(greatest(v, 10), 70) - 10) / 60 AS v FROM cal),
b AS (SELECT vec_id, y, x, avg(v) AS v FROM w GROUP BY ALL)
SELECT vec_id, 4 AS grid_height, 4 AS grid_width, round(avg(v), 8) AS mean_clean, round(min(v), 8) AS min_clean, round(max(v), 8) AS max_clean
FROM b GROUP BY vec_id""",
)
def prepare_units(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.prepare_unit(
        _grids(spark, d), "ref", "height", "width", slope=200.0, intercept=-60.0, threshold=35.0,
        center=40.0, window_width=60.0, factor=2,
    )
    total = F.aggregate("clean", F.lit(0.0), lambda s, v: s + v)
    return out.select(
        "vec_id", "grid_height", "grid_width", r(total / F.size("clean"), 8).alias("mean_clean"),
        r(F.array_min("clean"), 8).alias("min_clean"), r(F.array_max("clean"), 8).alias("max_clean"),
    )


@query(
    "clip_limited_equalize",
    """
WITH b AS (SELECT l_suppkey, round_even(least(greatest(l_extendedprice / 110000, 0), 1) * 255, 0)::INTEGER AS bin, count(*) AS c FROM lineitem GROUP BY ALL),
t AS (SELECT l_suppkey, sum(c)::BIGINT AS n, greatest(1, floor(2.0 * sum(c) / 256)::BIGINT) AS lim FROM b GROUP BY l_suppkey),
f AS (SELECT t.l_suppkey, n, lim, g.bin::INTEGER AS bin, coalesce(c, 0) AS c FROM t CROSS JOIN range(256) g(bin) LEFT JOIN b ON b.l_suppkey = t.l_suppkey AND b.bin = g.bin),
x AS (SELECT *, (sum(greatest(c - lim, 0)) OVER (PARTITION BY l_suppkey))::BIGINT AS excess FROM f),
s AS (SELECT *, least(c, lim) + excess // 256 + (bin < excess % 256)::INTEGER AS flat FROM x),
l AS (SELECT l_suppkey, bin, c, least(255, round_even(sum(flat) OVER (PARTITION BY l_suppkey ORDER BY bin)::DOUBLE * 255 / n, 0)::INTEGER) AS equalized FROM s)
SELECT l_suppkey, bin, equalized, c AS rows FROM l WHERE c > 0""",
)
def clip_limited_equalize(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(
        "l_suppkey", quantize8(F.col("l_extendedprice") / 110000).alias("bin")
    )
    mapped = grids.clip_limited_equalize(lines, ["l_suppkey"], "bin", 256, 2.0)
    return mapped.groupBy("l_suppkey", "bin", "equalized").agg(F.count("*").alias("rows"))


@query(
    "score_functions",
    f"""WITH {_NOISY},
f AS (SELECT vec_id, label, ref, given, 'none' AS method, given AS restored FROM noisy
      UNION ALL SELECT vec_id, label, ref, given, 'shrink', 0.8 * given + 0.1 FROM noisy)
SELECT vec_id, method, round(avg(abs(restored - ref)), 8) AS full_mae, round({_psnr('avg((restored - ref) ** 2)')}, 5) AS full_psnr
FROM f GROUP BY ALL""",
)
def score_functions(spark: SparkSession, d: str) -> DataFrame:
    """User functions over two-dimensional arrays in Arrow batches."""
    units = _noisy(spark, d).withColumn("body", F.transform("ref", lambda v: F.lit(True)))
    out = scoring.score_functions(
        units, ["vec_id"], "given", "ref", "body", "height", "width",
        {"none": lambda a: a, "shrink": lambda a: 0.8 * a + 0.1}, WINDOW, SIGMA,
    )
    return rounded(rounded(out.select("vec_id", "method", "full_mae", "full_psnr"), ["full_mae"], 8), ["full_psnr"], 5)


@query(
    "training_pairs",
    f"""WITH {_NOISY}
SELECT vec_id::VARCHAR AS sample_key, label::VARCHAR AS subject_id, round(sum(ref), 8) AS clean_total, round(sum(given), 8) AS degraded_total
FROM noisy WHERE label < 5 GROUP BY ALL""",
)
def training_pairs(spark: SparkSession, d: str) -> DataFrame:
    units = _noisy(spark, d).select(
        F.col("given").alias("degraded"),
        F.col("ref").alias("clean"),
        F.col("label").cast("string").alias("subject_id"),
        F.col("vec_id").cast("string").alias("sample_key"),
        F.lit("embeddings").alias("source_archive"),
        F.when(F.col("label") % 2 == 0, "A").otherwise("B").alias("acquisition_group"),
        F.col("vec_id").alias("geometric_slice_index"),
        F.when(F.col("label") < 5, "train").otherwise("test").alias("split"),
    )
    pairs = scoring.training_pairs(units, "split", "train", ["train", "validation"])

    def total(c: str) -> Column:
        return r(F.aggregate(c, F.lit(0.0), lambda s, v: s + v), 8)

    return pairs.select(
        "sample_key", "subject_id", total("clean").alias("clean_total"), total("degraded").alias("degraded_total")
    )


@query(
    "affine_grid",
    f"WITH {_CELLS} SELECT vec_id, round(sum(ref * 2 - 1), 8) AS total FROM cells GROUP BY vec_id",
)
def affine_grid(spark: SparkSession, d: str) -> DataFrame:
    scaled = F.transform("ref", lambda v: affine_rescale(v, 2.0, -1.0))
    return _grids(spark, d).select("vec_id", r(F.aggregate(scaled, F.lit(0.0), lambda s, v: s + v), 8).alias("total"))
