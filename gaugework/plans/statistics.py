"""Entity-weighted results, paired comparisons and run comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugework.operators import joins, runs, stats
from gaugework.operators.selection import best_epoch, best_so_far
from gaugework.plans.registry import query, rounded, table, untied

LINE_METRICS = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
METRICS = list(LINE_METRICS)
HIGHER, LOWER = ("quantity", "price"), ("discount", "tax")


def _line_units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_suppkey", *[F.col(c).alias(m) for m, c in LINE_METRICS.items()])


def _suppliers(spark: SparkSession, d: str) -> int:
    """Rows of the supplier table (a footer count): no per-supplier table can be longer."""
    return table(spark, d, "supplier").count()


_SUPPLIER_MEANS = """
SELECT l_suppkey, count(*) AS unit_count, avg(l_quantity) AS quantity, avg(l_extendedprice) AS price,
       avg(l_discount) AS discount, avg(l_tax) AS tax
FROM lineitem {where} GROUP BY l_suppkey"""


@query(
    "entity_weighted",
    f"""
WITH e AS ({_SUPPLIER_MEANS.format(where='')}),
long AS (SELECT metric, value FROM e UNPIVOT (value FOR metric IN (quantity, price, discount, tax)))
SELECT metric, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(quantile_cont(value, 0.5), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max
FROM long GROUP BY metric""",
)
def entity_weighted(spark: SparkSession, d: str) -> DataFrame:
    entities = stats.entity_means(_line_units(spark, d), "l_suppkey", METRICS)
    out = stats.describe_entities(entities, METRICS, bound=_suppliers(spark, d))
    return rounded(out, ["mean", "std", "median", "min", "max"])


@query(
    "entity_table",
    """
SELECT o_custkey, c_mktsegment AS segment, count(*) AS unit_count, round(avg(o_totalprice) + 1e-5, 2) AS mean_price
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
)
def entity_table(spark: SparkSession, d: str) -> DataFrame:
    # Combined per customer first, so the join never sees the orders of a hot customer.
    units = table(spark, d, "orders").select("o_custkey", F.col("o_totalprice").alias("price"))
    segments = table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")
    )
    out = joins.inherit(stats.entity_means(units, "o_custkey", ["price"]), segments, "o_custkey", ["segment"])
    return out.withColumn("mean_price", untied("mean_price"))


@query(
    "constant_carry",
    """
SELECT l_orderkey, l_linestatus, count(*) AS unit_count, round(avg(l_quantity) + 1e-7, 4) AS mean_quantity
FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) > 1)
GROUP BY ALL""",
)
def constant_carry(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose lines agree on their status, with the status carried to the order."""
    from gaugework.operators.constraints import inconsistent_groups

    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus", F.col("l_quantity").alias("quantity"))
    mixed = inconsistent_groups(lines, ["l_orderkey"], ["l_linestatus"])
    sound = joins.orphans(lines, mixed, "l_orderkey")
    out = stats.entity_means(sound, "l_orderkey", ["quantity"], ["l_linestatus"])
    return out.withColumn("mean_quantity", untied("mean_quantity", 4))


@query(
    "pooled_mean",
    """
SELECT metric, units, round(mean, 6) AS mean FROM (
  SELECT count(*) AS units, avg(l_quantity) AS quantity, avg(l_extendedprice) AS price,
         avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem
) UNPIVOT (mean FOR metric IN (quantity, price, discount, tax))""",
)
def pooled_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.pooled_mean(_line_units(spark, d), METRICS), ["mean"])


@query(
    "two_level_mean",
    """
WITH e AS (SELECT user_id, avg(value) AS m, sum(value) AS s, count(value) AS n FROM events GROUP BY user_id)
SELECT count(*) AS entities, sum(n)::BIGINT AS units, round(avg(m), 6) AS entity_weighted,
       round(sum(s) / sum(n), 6) AS pooled FROM e""",
)
def two_level_mean(spark: SparkSession, d: str) -> DataFrame:
    out = stats.two_level_mean(table(spark, d, "events"), "user_id", "value")
    return rounded(out, ["entity_weighted", "pooled"])


@query(
    "stratum_breakdown",
    """
WITH e AS (
  SELECT o_custkey, c_mktsegment AS segment, avg(o_totalprice) AS m
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT segment, grouping(segment)::INTEGER AS is_total, count(*) AS entities, round(avg(m), 4) AS mean_price
FROM e GROUP BY GROUPING SETS ((segment), ())""",
)
def stratum_breakdown(spark: SparkSession, d: str) -> DataFrame:
    # Orders are combined per customer before the segment is attached.
    entities = stats.entity_means(
        table(spark, d, "orders").select("o_custkey", F.col("o_totalprice").alias("price")), "o_custkey", ["price"]
    )
    segments = table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")
    )
    joined = joins.inherit(entities, segments, "o_custkey", ["segment"])
    return rounded(stats.stratum_breakdown(joined, "segment", ["price"]), ["mean_price"], 4)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Returned against accepted lines, per supplier, matched on the supplier's nation."""
    nations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    units = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("R", "A")).select(
        "l_suppkey", "l_returnflag", *[F.col(c).alias(m) for m, c in LINE_METRICS.items()]
    )
    means = stats.entity_means(units, ["l_suppkey", "l_returnflag"], METRICS)
    labelled = joins.inherit(means, nations, "l_suppkey", ["s_nationkey"])
    return joins.strict_pairs_of(labelled, "l_suppkey", "l_returnflag", "R", "A", METRICS, ["s_nationkey"])


_PAIRS = f"""
pairs AS (
  SELECT r.l_suppkey, s_nationkey,
         {", ".join(f"a.{m} AS baseline_{m}, r.{m} AS method_{m}, r.{m} - a.{m} AS delta_{m}" for m in METRICS)}
  FROM ({_SUPPLIER_MEANS.format(where="WHERE l_returnflag = 'R'")}) r
  JOIN ({_SUPPLIER_MEANS.format(where="WHERE l_returnflag = 'A'")}) a USING (l_suppkey)
  JOIN supplier ON s_suppkey = r.l_suppkey)"""


@query(
    "paired_deltas",
    f"""WITH {_PAIRS} SELECT l_suppkey, s_nationkey,
    {", ".join(f"round({p}_{m}, 6) AS {p}_{m}" for m in METRICS for p in ("baseline", "method", "delta"))} FROM pairs""",
)
def paired_deltas(spark: SparkSession, d: str) -> DataFrame:
    out = _pairs(spark, d)
    return rounded(out, [c for c in out.columns if c.split("_")[0] in ("baseline", "method", "delta")])


#: The columns of LINE_METRICS are decimals of two places held as doubles: their sums, and so whether two
#: means are equal, depend on the order of adding. Whole multiples of 1 / SCALE add up exactly.
SCALE = 10_000


def _exact_pairs(spark: SparkSession, d: str) -> DataFrame:
    """:func:`_pairs` with deltas of exact sums, which are 0 where the two means are equal."""
    nations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    units = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("R", "A")).select(
        "l_suppkey",
        "l_returnflag",
        *[F.round(F.col(c) * SCALE).cast("long").alias(m) for m, c in LINE_METRICS.items()],
    )
    means = stats.entity_means(units, ["l_suppkey", "l_returnflag"], METRICS)
    labelled = joins.inherit(means, nations, "l_suppkey", ["s_nationkey"])
    pairs = joins.strict_pairs_of(labelled, "l_suppkey", "l_returnflag", "R", "A", METRICS, ["s_nationkey"])
    return pairs.withColumns({c: F.col(c) / SCALE for c in stats.delta_columns(METRICS)})


_EXACT_MEANS = f"""
SELECT l_suppkey, {", ".join(f"avg(round({c} * {SCALE})::BIGINT) AS {m}" for m, c in LINE_METRICS.items())}
FROM lineitem {{where}} GROUP BY l_suppkey"""
_EXACT_DELTAS = f"""
pairs AS (
  SELECT {", ".join(f"(r.{m} - a.{m}) / {SCALE} AS delta_{m}" for m in METRICS)}
  FROM ({_EXACT_MEANS.format(where="WHERE l_returnflag = 'R'")}) r
  JOIN ({_EXACT_MEANS.format(where="WHERE l_returnflag = 'A'")}) a USING (l_suppkey)
  JOIN supplier ON s_suppkey = r.l_suppkey),
long AS (
  SELECT metric, value, CASE WHEN metric IN ('quantity', 'price') THEN 'higher' ELSE 'lower' END AS direction
  FROM (SELECT {", ".join(f"delta_{m} AS {m}" for m in METRICS)} FROM pairs)
  UNPIVOT (value FOR metric IN (quantity, price, discount, tax)))"""

_DELTAS = f"""
{_PAIRS},
long AS (
  SELECT metric, value, CASE WHEN metric IN ('quantity', 'price') THEN 'higher' ELSE 'lower' END AS direction
  FROM (SELECT {", ".join(f"delta_{m} AS {m}" for m in METRICS)} FROM pairs)
  UNPIVOT (value FOR metric IN (quantity, price, discount, tax)))"""
_BETTER = "(CASE WHEN direction = 'higher' THEN value ELSE -value END) > 0"


@query(
    "paired_summary",
    f"""WITH {_EXACT_DELTAS}
SELECT metric, direction, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(quantile_cont(value, 0.5), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max,
       count_if({_BETTER}) AS improved, count_if(NOT {_BETTER} AND value <> 0) AS worsened,
       count_if(value = 0) AS tied
FROM long GROUP BY metric, direction""",
)
def paired_summary(spark: SparkSession, d: str) -> DataFrame:
    out = stats.paired_delta_summary(_exact_pairs(spark, d), METRICS, LOWER, HIGHER, _suppliers(spark, d))
    return rounded(out, ["mean", "std", "median", "min", "max"])


@query(
    "verdicts",
    f"""WITH {_DELTAS},
s AS (SELECT metric, direction, avg(value) AS value FROM long GROUP BY ALL)
SELECT metric, direction, round(value, 6) AS mean_delta, {_BETTER} AS beats_baseline,
       count_if({_BETTER}) OVER () AS metrics_improved, count(*) OVER () AS metrics_total FROM s""",
)
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    summary = stats.paired_delta_summary(_pairs(spark, d), METRICS, LOWER, HIGHER, _suppliers(spark, d))
    return rounded(stats.verdicts(summary), ["mean_delta"])


@query(
    "linearity_check",
    f"""WITH {_PAIRS}
{" UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg(delta_{m}), 6) AS mean_of_deltas, round(avg(method_{m}) - avg(baseline_{m}), 6) AS difference_of_means, true AS agrees FROM pairs" for m in METRICS)}""",
)
def linearity_check(spark: SparkSession, d: str) -> DataFrame:
    out = stats.linearity_check(_pairs(spark, d), METRICS, 1e-8)
    return rounded(out, ["mean_of_deltas", "difference_of_means"])


@query(
    "pairing_report",
    """
WITH e AS (
  SELECT o_custkey, count_if(o_orderstatus = 'F') AS f, count_if(o_orderstatus = 'O') AS o
  FROM orders GROUP BY o_custkey)
SELECT CASE WHEN f = 0 THEN 'only in baseline' WHEN o = 0 THEN 'only in method'
            WHEN f <> o THEN 'unit_count disagrees' ELSE 'paired' END AS state, count(*) AS entities
FROM e WHERE f + o > 0 GROUP BY ALL""",
)
def pairing_report(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("price", F.col("o_totalprice"))

    def side(status: str) -> DataFrame:
        return stats.entity_means(orders.where(F.col("o_orderstatus") == status), "o_custkey", ["price"])

    return joins.pairing_report(side("F"), side("O"), "o_custkey", ["price"])


# -- runs: order years; methods: order status; metrics: mean price (higher) and its spread (lower)

RUN_LOWER, RUN_HIGHER = ("spread",), ("price",)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """``method, run, metric, value``: customer means per year and status, averaged over customers."""
    units = table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("method"),
        F.year("o_orderdate").alias("run"),
        "o_custkey",
        F.col("o_totalprice").alias("price"),
    )
    entities = stats.entity_means(units, ["method", "run", "o_custkey"], ["price"])
    wide = entities.groupBy("method", "run").agg(
        F.avg("mean_price").alias("price"), F.stddev_samp("mean_price").alias("spread")
    )
    return stats.to_long(wide, ["method", "run"], {"price": "price", "spread": "spread"})


_RUNS = """
ent AS (SELECT o_orderstatus AS method, year(o_orderdate)::INTEGER AS run, o_custkey, avg(o_totalprice) AS m
        FROM orders GROUP BY ALL),
wide AS (SELECT method, run, avg(m) AS price, stddev_samp(m) AS spread FROM ent GROUP BY ALL),
runs AS (SELECT method, run, metric, value FROM wide UNPIVOT (value FOR metric IN (price, spread)))"""
_RUN_PAIRS = f"""{_RUNS},
pairs AS (
  SELECT run, metric, a.value AS a, b.value AS b, CASE metric WHEN 'price' THEN 'higher' ELSE 'lower' END AS direction,
         b.value - a.value AS raw, CASE metric WHEN 'price' THEN b.value - a.value ELSE a.value - b.value END AS oriented
  FROM (SELECT * FROM runs WHERE method = 'F') a JOIN (SELECT * FROM runs WHERE method = 'O') b USING (run, metric)),
summary AS (
  SELECT metric, direction, count(*) AS runs, avg(a) AS mean_a, stddev_samp(a) AS std_a, avg(b) AS mean_b,
         stddev_samp(b) AS std_b, avg(raw) AS mean_raw, stddev_samp(raw) AS std_raw, avg(oriented) AS mean_oriented,
         stddev_samp(oriented) AS std_oriented, min(oriented) AS min_oriented, max(oriented) AS max_oriented,
         count_if(oriented > 0) AS runs_for_b, count_if(oriented < 0) AS runs_for_a, count_if(oriented = 0) AS runs_tied,
         avg(oriented) > 0 AND count_if(oriented > 0) >= 4 AS consistent_for_b,
         avg(oriented) < 0 AND count_if(oriented < 0) >= 4 AS consistent_for_a
  FROM pairs GROUP BY metric, direction)"""


@query(
    "run_spread",
    f"""WITH {_RUNS}
SELECT method, metric, array_to_string(list((round(value)::BIGINT) ORDER BY run), ',') AS run_values, count(*) AS n,
       round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max
FROM runs GROUP BY method, metric""",
)
def run_spread(spark: SparkSession, d: str) -> DataFrame:
    out = runs.run_spread(_runs(spark, d), ["method", "metric"])
    shown = F.array_join(F.transform("values", lambda v: F.round(v).cast("long").cast("string")), ",")
    return rounded(
        out.select("method", "metric", shown.alias("run_values"), "n", "mean", "std", "min", "max"),
        ["mean", "std", "min", "max"],
        4,
    )


_RUN_COLUMNS = ["mean_a", "std_a", "mean_b", "std_b", "mean_raw", "std_raw", "mean_oriented", "std_oriented", "min_oriented", "max_oriented"]


@query(
    "run_paired",
    f"""WITH {_RUN_PAIRS}
SELECT metric, direction, runs, {", ".join(f"round({c}, 4) AS {c}" for c in _RUN_COLUMNS)},
       runs_for_b, runs_for_a, runs_tied, consistent_for_b, consistent_for_a,
       CASE WHEN runs_for_b = runs THEN 'all ' || runs || ' runs favoured O'
            WHEN runs_for_a = runs THEN 'all ' || runs || ' runs favoured F'
            WHEN consistent_for_b THEN 'O was directionally consistent across runs'
            WHEN consistent_for_a THEN 'F was directionally consistent across runs' END AS phrase
FROM summary""",
)
def run_paired(spark: SparkSession, d: str) -> DataFrame:
    pairs = runs.paired_runs(_runs(spark, d), "F", "O", RUN_LOWER, RUN_HIGHER)
    out = runs.paired_run_summary(pairs).withColumn("phrase", runs.permitted_phrase("F", "O"))
    return rounded(
        out.select(
            "metric", "direction", "runs", *_RUN_COLUMNS,
            "runs_for_b", "runs_for_a", "runs_tied", "consistent_for_b", "consistent_for_a", "phrase",
        ),
        _RUN_COLUMNS,
        4,
    )


@query(
    "overall_claim",
    f"""WITH {_RUN_PAIRS}
SELECT count(DISTINCT metric) AS metrics, count_if(consistent_for_a) AS metrics_for_a,
       count_if(consistent_for_b) AS metrics_for_b,
       CASE WHEN count_if(consistent_for_b) = 2 THEN 'O' WHEN count_if(consistent_for_a) = 2 THEN 'F' END AS claim
FROM summary""",
)
def overall_claim(spark: SparkSession, d: str) -> DataFrame:
    summary = runs.paired_run_summary(runs.paired_runs(_runs(spark, d), "F", "O", RUN_LOWER, RUN_HIGHER))
    return runs.overall_claim(summary, "F", "O", ["price", "spread"])


@query(
    "vs_reference",
    f"""WITH {_RUNS},
ref AS (SELECT metric, avg(value) AS reference FROM runs GROUP BY metric),
j AS (SELECT method, metric, CASE metric WHEN 'price' THEN 'higher' ELSE 'lower' END AS direction,
             value - reference AS raw, CASE metric WHEN 'price' THEN 1 ELSE -1 END * (value - reference) AS oriented
      FROM runs JOIN ref USING (metric))
SELECT method, metric, direction, count(*) AS runs, round(avg(raw), 4) AS mean_raw, round(stddev_samp(raw), 4) AS std_raw,
       round(avg(oriented), 4) AS mean_oriented, round(min(oriented), 4) AS min_oriented,
       round(max(oriented), 4) AS max_oriented, count_if(oriented > 0) AS improved, count_if(oriented < 0) AS worsened,
       count_if(oriented = 0) AS tied, count_if(oriented > 0) = count(*) AS all_improved
FROM j GROUP BY method, metric, direction""",
)
def vs_reference(spark: SparkSession, d: str) -> DataFrame:
    long = _runs(spark, d)
    reference = long.groupBy("metric").agg(F.avg("value").alias("value"))
    out = runs.against_reference(long, reference, RUN_LOWER, RUN_HIGHER)
    return rounded(out, ["mean_raw", "std_raw", "mean_oriented", "min_oriented", "max_oriented"], 4)


@query(
    "same_run_partner",
    f"""WITH {_RUNS}
SELECT a.run, a.metric, round(a.value, 4) AS value, round(b.value, 4) AS partner
FROM runs a JOIN runs b ON a.run = b.run AND a.metric = b.metric WHERE a.method = 'P' AND b.method = 'O'""",
)
def same_run_partner(spark: SparkSession, d: str) -> DataFrame:
    long = _runs(spark, d)
    mine = long.where(F.col("method") == "P").drop("method")
    other = long.where(F.col("method") == "O").drop("method")
    out = joins.same_run_partner(mine, other, ["metric"], "run")
    return rounded(out.select("run", "metric", "value", "partner"), ["value", "partner"], 4)


@query(
    "change_between_partitions",
    """
WITH p AS (SELECT event_type AS method, user_id, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'first' ELSE 'second' END AS part,
                  value FROM events),
e AS (SELECT method, part, user_id, avg(value) AS m FROM p GROUP BY ALL),
w AS (SELECT method, part, avg(m) AS v FROM e GROUP BY ALL)
SELECT method, 'value' AS metric, round(max(CASE WHEN part = 'first' THEN v END), 6) AS before,
       round(max(CASE WHEN part = 'second' THEN v END), 6) AS after,
       round(max(CASE WHEN part = 'second' THEN v END) - max(CASE WHEN part = 'first' THEN v END), 6) AS change
FROM w GROUP BY method""",
)
def change_between_partitions(spark: SparkSession, d: str) -> DataFrame:
    half = F.when(F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00")), "first").otherwise("second")
    units = table(spark, d, "events").select(
        F.col("event_type").alias("method"), half.alias("partition"), "user_id", "value"
    )
    entities = stats.entity_means(units, ["method", "partition", "user_id"], ["value"])
    results = entities.groupBy("method", "partition").agg(F.avg("mean_value").alias("value"))
    out = runs.partition_change(results.withColumn("metric", F.lit("value")), "first", "second")
    return rounded(out, ["before", "after", "change"])


# -- histories: run = year, epoch = month of the year from 0, metric = mean price of the month


def _history(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return orders.groupBy(
        F.year("o_orderdate").alias("run"), (F.month("o_orderdate") - 1).alias("epoch")
    ).agg(F.avg("o_totalprice").alias("metric"))


_HISTORY = """h AS (SELECT year(o_orderdate)::INTEGER AS run, (month(o_orderdate) - 1)::INTEGER AS epoch, avg(o_totalprice) AS metric
FROM orders GROUP BY ALL)"""


@query(
    "best_epoch",
    f"""WITH {_HISTORY}
SELECT run, first(epoch ORDER BY metric, epoch) AS best_epoch, round(first(metric ORDER BY metric, epoch), 4) AS best_metric
FROM h WHERE epoch <> 0 GROUP BY run""",
)
def best_epoch_query(spark: SparkSession, d: str) -> DataFrame:
    return rounded(best_epoch(_history(spark, d), ["run"], "epoch", "metric"), ["best_metric"], 4)


@query(
    "best_so_far",
    f"""WITH {_HISTORY}
SELECT run, epoch, round(metric, 4) AS metric,
       coalesce(metric < min(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)
       AS is_best_so_far FROM h""",
)
def best_so_far_query(spark: SparkSession, d: str) -> DataFrame:
    return rounded(best_so_far(_history(spark, d), ["run"], "epoch", "metric"), ["metric"], 4)


@query(
    "coverage_summary",
    """
WITH u AS (SELECT l_suppkey, avg((l_discount > 0.05)::INTEGER) AS discounted, avg((l_quantity > 49)::INTEGER) AS bulky
           FROM lineitem GROUP BY l_suppkey),
long AS (SELECT metric, value FROM u UNPIVOT (value FOR metric IN (discounted, bulky)))
SELECT metric, count(*) AS n, round(min(value) + 1e-7, 4) AS min, round(quantile_cont(value, 0.5) + 1e-7, 4) AS median,
       round(max(value) + 1e-7, 4) AS max, count_if(value = 0) AS zero FROM long GROUP BY metric""",
)
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    from gaugework.functions.values import fraction

    units = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        fraction(F.col("l_discount") > 0.05).alias("discounted"), fraction(F.col("l_quantity") > 49).alias("bulky")
    )
    out = stats.coverage_summary(units, ["discounted", "bulky"], _suppliers(spark, d))
    return out.withColumns({c: untied(c, 4) for c in ("min", "median", "max")})


@query(
    "group_composition",
    """SELECT o_orderstatus AS partition, c_mktsegment AS stratum, count(DISTINCT o_custkey) AS entities
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
)
def group_composition(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("partition")).distinct()
    segments = table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("stratum")
    )
    return stats.group_composition(joins.inherit(pairs, segments, "o_custkey", ["stratum"]), "partition", "stratum")
