"""Comparisons across runs. Runs (and methods and metrics) are few by design; entity tables
are reduced to one value per (method, run, metric) before anything here starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugework.functions.directions import metric_direction, oriented, raw_delta
from gaugework.functions.values import is_finite

#: Runs that must agree before a direction may be called consistent.
MIN_CONSISTENT_RUNS = 4


def _finite(c: str) -> Column:
    return F.when(is_finite(F.col(c)), F.col(c)).otherwise(
        F.raise_error(F.lit(f"{c} is missing or not finite"))
    )


def run_spread(runs: DataFrame, group: list[str], run: str = "run", value: str = "value") -> DataFrame:
    """Values in run order with n, mean, sample SD, min and max; fewer than two runs is an error."""
    spread = runs.withColumn(value, _finite(value)).groupBy(*group).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.array_sort(F.collect_list(F.struct(F.col(run), F.col(value)))).alias("_runs"),
    )
    n = F.when(F.col("n") >= 2, F.col("n")).otherwise(
        F.raise_error(F.lit("a spread over runs needs at least two values"))
    )
    return spread.select(
        *group,
        F.transform("_runs", lambda r: r[value]).alias("values"),
        n.alias("n"),
        "mean",
        "std",
        "min",
        "max",
    )


def paired_runs(
    runs: DataFrame,
    a: str,
    b: str,
    lower: tuple[str, ...],
    higher: tuple[str, ...],
    keys: tuple[str, str] = ("run", "metric"),
    method: str = "method",
    value: str = "value",
) -> DataFrame:
    """Methods ``a`` and ``b`` side by side per (run, metric), with raw and oriented delta.

    The run sets must be equal and every value finite; there is no fallback partner.
    """
    m, v = F.col(method), F.col(value)
    wide = (
        runs.where(m.isin(a, b))
        .groupBy(*keys)
        .agg(
            F.max(F.when(m == a, v)).alias("a"),
            F.max(F.when(m == b, v)).alias("b"),
            F.count_if(m == a).alias("_na"),
            F.count_if(m == b).alias("_nb"),
        )
    )
    paired = (F.col("_na") == 1) & (F.col("_nb") == 1)
    checked = [
        F.when(paired & is_finite(F.col(c)), F.col(c))
        .otherwise(F.raise_error(F.lit("runs are not paired one to one with finite values")))
        .alias(c)
        for c in ("a", "b")
    ]
    direction = metric_direction(F.col("metric"), lower, higher)
    raw = raw_delta(F.col("a"), F.col("b"))
    return (
        wide.select(*keys, *checked)
        .withColumn("direction", direction)
        .withColumn("raw", raw)
        .withColumn("oriented", oriented(F.col("direction"), F.col("raw")))
    )


def paired_run_summary(pairs: DataFrame, min_runs: int = MIN_CONSISTENT_RUNS) -> DataFrame:
    """Per metric: spreads of a, b, raw and oriented values, wins, and the direction rule."""
    spread = [
        agg(c).alias(f"{label}_{c}")
        for c in ("a", "b", "raw", "oriented")
        for label, agg in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    ]
    out = pairs.groupBy("metric", "direction").agg(
        F.count("*").alias("runs"),
        *spread,
        F.count_if(F.col("oriented") > 0).alias("runs_for_b"),
        F.count_if(F.col("oriented") < 0).alias("runs_for_a"),
        F.count_if(F.col("oriented") == 0).alias("runs_tied"),
    )
    mean = F.col("mean_oriented")
    return out.withColumn(
        "consistent_for_b", (mean > 0) & (F.col("runs_for_b") >= min_runs)
    ).withColumn("consistent_for_a", (mean < 0) & (F.col("runs_for_a") >= min_runs))


def permitted_phrase(a: str, b: str) -> Column:
    """The one sentence the counts allow, or null for a split."""
    runs = F.col("runs")

    def all_runs(method: str) -> Column:
        return F.concat(F.lit("all "), runs.cast("string"), F.lit(f" runs favoured {method}"))

    return (
        F.when(F.col("runs_for_b") == runs, all_runs(b))
        .when(F.col("runs_for_a") == runs, all_runs(a))
        .when(F.col("consistent_for_b"), F.lit(f"{b} was directionally consistent across runs"))
        .when(F.col("consistent_for_a"), F.lit(f"{a} was directionally consistent across runs"))
    )


def overall_claim(summary: DataFrame, a: str, b: str, metrics: list[str]) -> DataFrame:
    """A method is called better overall only if every metric agrees; a missing metric fails."""
    named = F.col("metric").isin(*metrics)
    out = summary.agg(
        F.count_distinct(F.when(named, F.col("metric"))).alias("metrics"),
        F.count_if(named & F.col("consistent_for_a")).alias("metrics_for_a"),
        F.count_if(named & F.col("consistent_for_b")).alias("metrics_for_b"),
    )
    full = F.lit(len(metrics))
    complete = F.when(F.col("metrics") == full, F.col("metrics")).otherwise(
        F.raise_error(F.lit("an overall claim needs every metric"))
    )
    return out.select(
        complete.alias("metrics"),
        "metrics_for_a",
        "metrics_for_b",
        F.when(F.col("metrics_for_b") == full, F.lit(b))
        .when(F.col("metrics_for_a") == full, F.lit(a))
        .alias("claim"),
    )


def against_reference(
    runs: DataFrame,
    reference: DataFrame,
    lower: tuple[str, ...],
    higher: tuple[str, ...],
    by: list[str] = ("method",),
) -> DataFrame:
    """Every run against the one deterministic reference value of its metric.

    ``reference`` holds one row per metric, so its size is the number of metrics.
    """
    ref = reference.select("metric", F.col("value").alias("reference"))
    joined = runs.join(ref, "metric", "left").withColumn(
        "direction", metric_direction(F.col("metric"), lower, higher)
    )
    raw = _finite("value") - _finite("reference")
    long = joined.withColumn("raw", raw).withColumn("oriented", oriented(F.col("direction"), raw))
    out = long.groupBy(*by, "metric", "direction").agg(
        F.count("*").alias("runs"),
        F.avg("raw").alias("mean_raw"),
        F.stddev_samp("raw").alias("std_raw"),
        F.avg("oriented").alias("mean_oriented"),
        F.min("oriented").alias("min_oriented"),
        F.max("oriented").alias("max_oriented"),
        F.count_if(F.col("oriented") > 0).alias("improved"),
        F.count_if(F.col("oriented") < 0).alias("worsened"),
        F.count_if(F.col("oriented") == 0).alias("tied"),
    )
    return out.withColumn("all_improved", F.col("improved") == F.col("runs"))


def partition_change(
    results: DataFrame,
    before: str,
    after: str,
    keys: list[str] = ("method", "metric"),
    partition: str = "partition",
    value: str = "value",
) -> DataFrame:
    """The same metric on two partitions; runs of one method are averaged first."""
    p, v = F.col(partition), F.col(value)
    wide = (
        results.where(p.isin(before, after))
        .groupBy(*keys)
        .agg(F.avg(F.when(p == before, v)).alias("before"), F.avg(F.when(p == after, v)).alias("after"))
    )
    return wide.withColumn("change", F.col("after") - F.col("before"))
