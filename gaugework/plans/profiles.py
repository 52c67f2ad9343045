"""Rollups, distributions, histograms, quantiles, gaps and picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugework.operators import profile, selection
from gaugework.plans.registry import ORACLES, epoch_seconds, natural_sql, query, r, rounded, table, untied


@query(
    "series_rollup",
    """
SELECT user_id, count(*) AS units, first(event_type ORDER BY event_id) AS first_event_type,
       count(DISTINCT event_type) AS distinct_event_type, min(value) AS min_value, max(value) AS max_value,
       round(avg(value) + 1e-7, 4) AS mean_value, bool_or(value > 250) AS any_large, count_if(value < 5) AS count_small
FROM events GROUP BY user_id""",
)
def series_rollup(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    out = profile.series_rollup(
        table(spark, d, "events"), "user_id", "event_id", first=["event_type"], distinct=["event_type"],
        low_high=["value"], means=["value"], any_of={"large": v > 250}, count_if={"small": v < 5},
    )
    return out.withColumn("mean_value", untied("mean_value", 4))


@query(
    "cohort_counters",
    """
SELECT event_type, count(*) AS units, count(DISTINCT user_id) AS entities, count_if(value > 100) AS large,
       round(avg(value), 6) AS mean_value, max(value) AS max_value, bool_and(value > 0) AS all_positive
FROM events GROUP BY event_type""",
)
def cohort_counters(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    out = profile.cohort_counters(
        table(spark, d, "events"), "user_id", ["event_type"], {"large": v > 100}, ["value"], ["value"], {"all_positive": v > 0}
    )
    return rounded(out, ["mean_value"])


_VALUES = """
long AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders
         UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders
         UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR FROM orders)"""


@query(
    "value_distribution",
    f"""
WITH {_VALUES}, c AS (SELECT "column", value, count(*) AS n FROM long GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM c) WHERE rank <= 10""",
)
def value_distribution(spark: SparkSession, d: str) -> DataFrame:
    return profile.value_distribution(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query(
    "outlier_positions",
    """
WITH c AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
s AS (SELECT label, count(*) AS entity_units FROM embeddings GROUP BY label)
SELECT label, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x, count(*) AS units_with_outlier, min(v) AS min_value, max(v) AS max_value,
       bool_and(v > 0.25) AS always_outside, any_value(entity_units) AS entity_units, count(*) = any_value(entity_units) AS in_every_unit
FROM c JOIN s USING (label) WHERE v > 0.2 GROUP BY ALL""",
)
def outlier_positions(spark: SparkSession, d: str) -> DataFrame:
    from gaugework.functions.arrays import outlier_cells

    units = table(spark, d, "embeddings")
    cells = units.select("label", F.explode(outlier_cells(F.col("embedding"), 0.2, 8)).alias("c")).select(
        "label", "c.*", (F.col("c.value") > 0.25).alias("outside")
    )
    return profile.outlier_positions(cells, units, "label", ["y", "x"], "value", "outside")


@query(
    "first_outliers",
    """
WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY i) AS k, count(*) OVER (PARTITION BY vec_id) AS total
      FROM c WHERE v > 0.1)
SELECT vec_id, any_value(total) AS outliers, string_agg((i // 8) || 'x' || (i % 8), ';' ORDER BY i) AS first_cells
FROM o WHERE k <= 4 GROUP BY vec_id""",
)
def first_outliers(spark: SparkSession, d: str) -> DataFrame:
    from gaugework.functions.arrays import outlier_cells

    cells = outlier_cells(F.col("embedding"), 0.1, 8)
    rows = table(spark, d, "embeddings").select("vec_id", F.size(cells).cast("long").alias("outliers"), F.slice(cells, 1, 4).alias("c"))
    shown = F.array_join(F.transform("c", lambda s: F.concat_ws("x", s["y"].cast("string"), s["x"].cast("string"))), ";")
    return rows.where("outliers > 0").select("vec_id", "outliers", shown.alias("first_cells"))


@query(
    "moments",
    """
SELECT l_returnflag, count(*) AS n, round(sum(l_discount), 4) AS sum, round(sum(l_discount * l_discount), 4) AS sum_sq,
       round(sum(abs(l_discount)), 4) AS sum_abs, min(l_discount) AS min, max(l_discount) AS max,
       count_if(l_discount <= 0) AS at_low, count_if(l_discount >= 0.1) AS at_high, round(avg(l_discount), 8) AS mean,
       round(var_pop(l_discount), 8) AS variance FROM lineitem GROUP BY l_returnflag""",
)
def moments(spark: SparkSession, d: str) -> DataFrame:
    out = profile.moments(table(spark, d, "lineitem"), "l_discount", ["l_returnflag"], 0.0, 0.1)
    return rounded(rounded(out, ["sum", "sum_sq", "sum_abs"], 4), ["mean", "variance"], 8)


@query(
    "first_failures",
    "SELECT o_orderkey FROM orders WHERE o_totalprice < 2000 ORDER BY o_orderkey LIMIT 8",
)
def first_failures(spark: SparkSession, d: str) -> DataFrame:
    return profile.first_failures(table(spark, d, "orders"), F.col("o_totalprice") < 2000, "o_orderkey")


_HISTOGRAM = """h AS (SELECT least(greatest(floor(l_extendedprice / (110000.0 / 512)), 0), 511)::INTEGER AS bin, count(*) AS n
FROM lineitem GROUP BY ALL)"""


@query("histogram", f"WITH {_HISTOGRAM} SELECT * FROM h")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.histogram(table(spark, d, "lineitem"), "l_extendedprice", 512, 0.0, 110000.0)


@query(
    "histogram_quantile",
    f"""
WITH {_HISTOGRAM}, c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM h)
SELECT q, min(bin) AS bin, round((min(bin) + 0.5) * 110000.0 / 512, 6) AS value
FROM c, (VALUES (0.05::DOUBLE), (0.5), (0.95)) t(q) WHERE upto >= q * total GROUP BY q""",
)
def histogram_quantile(spark: SparkSession, d: str) -> DataFrame:
    counts = profile.histogram(table(spark, d, "lineitem"), "l_extendedprice", 512, 0.0, 110000.0)
    return rounded(profile.histogram_quantile(counts, 512, [0.05, 0.5, 0.95], 0.0, 110000.0), ["value"])


_PROBS = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


@query(
    "quantiles",
    f"""SELECT l_returnflag, q, round(value, 6) AS value FROM (
  SELECT l_returnflag, unnest([{", ".join(map(str, _PROBS))}])::DOUBLE AS q,
         unnest(quantile_cont(l_extendedprice, [{", ".join(map(str, _PROBS))}])) AS value FROM lineitem GROUP BY l_returnflag)""",
)
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    out = profile.quantile_rows(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", list(_PROBS))
    return rounded(out, ["value"])


_LATENCY = """l AS (SELECT event_type, count(*) AS samples, avg(value) AS mean, stddev_samp(value) AS sd,
  quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, min(value) AS min, max(value) AS max
  FROM events WHERE value > 0 GROUP BY event_type)"""


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Event values as latency samples; a zero is no measurement and would fail the gate."""
    return table(spark, d, "events").where("value > 0").select("event_type", "value")


@query(
    "latency_summary",
    f"""WITH {_LATENCY} SELECT event_type, samples, round(mean, 6) AS mean, round(sd, 6) AS sd, round(p50, 6) AS p50,
    round(p95, 6) AS p95, min, max FROM l""",
)
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    out = profile.latency_summary(
        _samples(spark, d), "event_type", "value", bound=table(spark, d, "events").count()
    )
    return rounded(out, ["mean", "sd", "p50", "p95"])


@query(
    "latency_ratios",
    f"""WITH {_LATENCY} SELECT round(a.p50 / b.p50, 6) AS ratio_p50, round(a.mean / b.mean, 6) AS ratio_mean
FROM l a, l b WHERE a.event_type = 'view' AND b.event_type = 'click'""",
)
def latency_ratios(spark: SparkSession, d: str) -> DataFrame:
    summary = profile.latency_summary(
        _samples(spark, d), "event_type", "value", bound=table(spark, d, "events").count()
    )
    return rounded(profile.latency_ratios(summary, "event_type", "view", "click"), ["ratio_p50", "ratio_mean"])


@query(
    "contract_scan",
    """
SELECT count(*) AS units, count_if(len(embedding) <> 64) AS bad_shape, 0::BIGINT AS bad_finite,
       count_if(list_min(embedding) < -0.3 OR list_max(embedding) > 0.3) AS bad_range, count_if(label NOT BETWEEN 0 AND 7) AS bad_label,
       round(min(list_min(embedding))::DOUBLE, 8) AS observed_min, round(max(list_max(embedding))::DOUBLE, 8) AS observed_max
FROM embeddings""",
)
def contract_scan(spark: SparkSession, d: str) -> DataFrame:
    from gaugework.functions.values import is_finite

    e = F.col("embedding")
    out = profile.contract_scan(
        table(spark, d, "embeddings"),
        {
            "shape": F.size(e) == 64,
            "finite": F.forall(e, is_finite),
            "range": (F.array_min(e) >= -0.3) & (F.array_max(e) <= 0.3),
            "label": F.col("label").between(0, 7),
        },
        F.struct(F.array_min(e).alias("low"), F.array_max(e).alias("high")),
    )
    return out.withColumns({c: r(F.col(c).cast("double"), 8) for c in ("observed_min", "observed_max")})


@query(
    "gap_report",
    """
WITH p AS (SELECT user_id, event_id, value, epoch_us(ts) / 1e6 AS pos FROM events),
l AS (SELECT *, abs(pos - lag(pos) OVER w) AS step, lag(event_id) OVER w <= event_id AS f,
             lag(value) OVER w <= value AS i, lag(value) OVER w >= value AS v
      FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos, event_id)),
g AS (SELECT user_id, count(*) AS units, min(pos) AS min_position, max(pos) AS max_position, min(step) AS min_step, max(step) AS max_step,
             count_if(step = 0) AS duplicate_positions, coalesce(bool_and(f), true) AS file_order_matches,
             coalesce(bool_and(i), true) AS instance_order_matches, coalesce(bool_and(v), true) AS reversed_instance_matches,
             quantile_cont(step, 0.5) AS median_step FROM l GROUP BY user_id)
SELECT user_id, units, round(min_position, 3) AS min_position, round(max_position, 3) AS max_position, round(min_step, 3) AS min_step,
       round(max_step, 3) AS max_step, duplicate_positions, file_order_matches, instance_order_matches, reversed_instance_matches,
       round(median_step, 3) AS median_step,
       abs(min_step - median_step) <= 1e-3 + 1e-5 * median_step AND abs(max_step - median_step) <= 1e-3 + 1e-5 * median_step AS uniform_spacing
FROM g""",
)
def gap_report(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", "value", epoch_seconds("ts").alias("position"))
    out = profile.gap_report(events, "user_id", "position", "event_id", "value")
    return rounded(out, ["min_position", "max_position", "min_step", "max_step", "median_step"], 3)


@query(
    "orientation_report",
    """
WITH e AS (SELECT label, vec_id, CASE WHEN embedding[10] > 0 THEN list_transform(embedding[1:6], lambda v: sign(v)::DOUBLE) END AS o,
       CASE WHEN embedding[11] > 0 THEN embedding[7:9]::DOUBLE[] END AS p, CASE WHEN embedding[12] > 0 THEN vec_id END AS i FROM embeddings),
c AS (SELECT *, o[2] * o[6] - o[3] * o[5] AS x, o[3] * o[4] - o[1] * o[6] AS y, o[1] * o[5] - o[2] * o[4] AS z FROM e),
l AS (SELECT *, nullif(sqrt(x * x + y * y + z * z), 0) AS l FROM c),
n AS (SELECT label, o, p, i, x / l AS x, y / l AS y, z / l AS z FROM l),
g AS (SELECT label, count(*) AS units, count(p) AS p, count(o) AS o, count(i) AS i, count(DISTINCT o) AS d,
       greatest(max(x*x) - min(x*x), max(x*y) - min(x*y), max(x*z) - min(x*z), max(y*y) - min(y*y), max(y*z) - min(y*z),
                max(z*z) - min(z*z)) AS r,
       bool_and(abs(x) <= 0.75 AND abs(y) <= 0.75 AND abs(abs(z) - 1) <= 0.75) AS axial,
       max(abs(p[1] * x + p[2] * y + p[3] * z - p[3])) AS apart FROM n GROUP BY label)
SELECT label, units, round(p / units, 6) AS position_fraction, round(o / units, 6) AS orientation_fraction,
       round(i / units, 6) AS instance_fraction, d AS distinct_orientations, CASE WHEN d > 0 THEN d = 1 END AS orientation_constant,
       r <= 0.75 AS plane_constant, axial AS all_axial, round(apart, 6) AS max_projected_minus_z FROM g""",
)
def orientation_report(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i: F.get("embedding", F.lit(i))
    rows = table(spark, d, "embeddings").select(
        "label",
        F.when(at(9) > 0, F.transform(F.slice("embedding", 1, 6), lambda v: F.signum(v).cast("double"))).alias("orientation"),
        F.when(at(10) > 0, F.slice("embedding", 7, 3)).alias("position"),
        F.when(at(11) > 0, F.col("vec_id")).alias("instance"),
    )
    out = profile.orientation_report(rows, "label", "orientation", "position", "instance", 0.75)
    return rounded(out, ["position_fraction", "orientation_fraction", "instance_fraction", "max_projected_minus_z"])


@query(
    "positional_index",
    """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS index FROM events""",
)
def positional_index(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    return selection.positional_index(events, "user_id", "ts", "event_id").drop("ts")


@query(
    "cohort_extremes",
    """
SELECT event_type, count(*) AS units, count(DISTINCT user_id) AS entities, min(value) AS min_value, max(value) AS max_value,
  round(quantile_cont(value, 0.5), 6) AS median_value FROM events GROUP BY event_type""",
)
def cohort_extremes(spark: SparkSession, d: str) -> DataFrame:
    out = profile.cohort_counters(
        table(spark, d, "events"), "user_id", ["event_type"], maxima=["value"], minima=["value"], medians=["value"]
    )
    return rounded(out, ["median_value"])


@query(
    "known_values",
    """
WITH d AS (SELECT source, lang, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END AS n_chars FROM documents)
SELECT 'source' AS "column", count(source) AS present, count(*) - count(source) AS absent, count(DISTINCT source) AS "values" FROM d
UNION ALL SELECT 'lang', count(lang), count(*) - count(lang), count(DISTINCT lang) FROM d
UNION ALL SELECT 'n_chars', count(n_chars), count(*) - count(n_chars), count(DISTINCT n_chars) FROM d""",
)
def known_values(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").withColumn("n_chars", F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")))
    return profile.known_values(documents, ["source", "lang", "n_chars"])


@query("positional_index_sliced", ORACLES["positional_index"])
def positional_index_sliced(spark: SparkSession, d: str) -> DataFrame:
    """The positional index by the plan for entities that no task can hold, with a small limit."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    return selection.positional_index(events, "user_id", "ts", "event_id", slice_rows=20).drop("ts")


@query("gap_report_sliced", ORACLES["gap_report"])
def gap_report_sliced(spark: SparkSession, d: str) -> DataFrame:
    """The gap report by the same plan; the first query over it covers the other one."""
    events = table(spark, d, "events").select("user_id", "event_id", "value", epoch_seconds("ts").alias("position"))
    out = profile.gap_report(events, "user_id", "position", "event_id", "value", slice_rows=20)
    return rounded(out, ["min_position", "max_position", "min_step", "max_step", "median_step"], 3)


@query(
    "middle_pick",
    f"""
WITH f AS (SELECT o_orderstatus, o_orderpriority, first(o_custkey ORDER BY {natural_sql('o_custkey')}, o_custkey) AS o_custkey
           FROM orders GROUP BY ALL),
k AS (SELECT o.*, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS n
      FROM orders o JOIN f USING (o_orderstatus, o_orderpriority, o_custkey)
      WINDOW w AS (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderdate, o_orderkey))
SELECT o_orderstatus, o_orderpriority, o_custkey, o_orderkey FROM k WHERE k = n // 2""",
)
def middle_pick(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey", "o_orderdate", "o_orderkey")
    out = selection.middle_pick(orders, ["o_orderstatus", "o_orderpriority"], "o_custkey", "o_orderdate", "o_orderkey")
    return out.select("o_orderstatus", "o_orderpriority", "o_custkey", "o_orderkey")


@query(
    "rank_candidates",
    """
WITH c AS (SELECT p_size, p_brand, count(*) AS parts, round(avg(p_retailprice) + 1e-5, 2) AS price FROM part GROUP BY ALL)
SELECT p_size, p_brand, parts, price, row_number() OVER (ORDER BY parts DESC, price DESC, p_size, p_brand) AS selection_rank,
       row_number() OVER (ORDER BY parts DESC, price DESC, p_size, p_brand) = 1 AS selected FROM c""",
)
def rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    candidates = table(spark, d, "part").groupBy("p_size", "p_brand").agg(
        F.count("*").alias("parts"), untied(F.avg("p_retailprice")).alias("price")
    )
    return selection.rank_candidates(candidates, ["parts", "price"], ["p_size", "p_brand"])


@query(
    "smallest_pool",
    "SELECT user_id, count(*) AS units FROM events GROUP BY user_id ORDER BY units, user_id LIMIT 1",
)
def smallest_pool(spark: SparkSession, d: str) -> DataFrame:
    return selection.smallest_pool(table(spark, d, "events"), "user_id")


@query(
    "entity_index",
    f"""
WITH c AS (SELECT source, count(*) AS units FROM documents GROUP BY source)
SELECT source, units, row_number() OVER (ORDER BY {natural_sql('source')}, source) - 1 AS entity_index FROM c""",
)
def entity_index(spark: SparkSession, d: str) -> DataFrame:
    return profile.entity_index(table(spark, d, "documents"), "source")
