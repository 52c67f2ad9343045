"""Hierarchical evaluation statistics: unit -> entity -> whole table.

Every entity counts once, whatever its number of units. Means, spreads and counts are
partial aggregates, so a hot entity is combined on the map side; medians go through
:func:`gaugework.operators.ordering.quantiles`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugework.functions.directions import is_improvement, metric_direction
from gaugework.functions.values import is_finite
from gaugework.operators.constraints import refuse_empty
from gaugework.operators.ordering import aggregate_with_quantiles


def entity_means(
    units: DataFrame,
    entity: str | list[str],
    metrics: list[str],
    carry: list[str] = (),
    count_name: str = "unit_count",
) -> DataFrame:
    """Mean of every metric per entity as ``mean_<metric>`` with the unit count.

    Carried attributes must be constant inside an entity; a second value fails the job.
    Units are combined per (entity, attributes) first: that keeps the pass over the units a
    hash aggregate, and the check then reads one row per entity.
    """
    keys = [entity] if isinstance(entity, str) else list(entity)
    if not carry:
        return units.groupBy(*keys).agg(
            F.count("*").alias(count_name), *[F.avg(m).alias(f"mean_{m}") for m in metrics]
        )
    combined = units.groupBy(*keys, *carry).agg(
        F.count("*").alias("_rows"),
        *[F.sum(F.col(m).cast("double")).alias(f"_sum_{m}") for m in metrics],
        *[F.count(m).alias(f"_n_{m}") for m in metrics],
    )
    label = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    message = F.concat(F.lit(f"inconsistent {'/'.join(carry)} in entity "), label)
    merged = combined.groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in carry],
        F.count("*").alias("_variants"),
        F.sum("_rows").alias(count_name),
        *[
            (F.sum(f"_sum_{m}") / F.nullif(F.sum(f"_n_{m}"), F.lit(0))).alias(f"mean_{m}")
            for m in metrics
        ],
    )
    checked = F.when(F.col("_variants") == 1, F.col(count_name)).otherwise(F.raise_error(message))
    return merged.withColumn(count_name, checked).drop("_variants")


def to_long(wide: DataFrame, keep: list[str], columns: dict[str, str]) -> DataFrame:
    """Unpivot ``{column: metric name}`` to ``metric, value`` rows."""
    named = wide.select(*keep, *[F.col(c).cast("double").alias(m) for c, m in columns.items()])
    return named.unpivot(keep, list(columns.values()), "metric", "value")


_SPREAD = ["n", "mean", "std", "median", "min", "max"]


def _spread(
    long: DataFrame, group: list[str], value: str, bound: int | None, extra: list[Column] = ()
) -> DataFrame:
    aggregates = [
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        *extra,
    ]
    out = aggregate_with_quantiles(long, group, aggregates, value, [0.5], "_q", bound=bound)
    return out.withColumn("median", F.get("_q", F.lit(0))).drop("_q")


def describe(
    long: DataFrame, group: list[str], value: str = "value", bound: int | None = None
) -> DataFrame:
    """count, mean, sample SD (null below two rows), median, min and max per group.

    ``bound``: rows no group can exceed, if known (see :class:`~gaugework.operators.ordering.Ordering`).
    """
    return _spread(long, group, value, bound).select(*group, *_SPREAD)


def describe_entities(
    entities: DataFrame, metrics: list[str], by: list[str] = (), bound: int | None = None
) -> DataFrame:
    """The primary result: :func:`describe` over the entity means, one row per metric."""
    long = to_long(entities, list(by), {f"mean_{m}": m for m in metrics})
    return describe(long, [*by, "metric"], bound=bound)


def pooled_mean(units: DataFrame, metrics: list[str]) -> DataFrame:
    """The secondary result: every unit weighted equally, one row per metric."""
    wide = units.agg(F.count("*").alias("units"), *[F.avg(m).alias(m) for m in metrics])
    return to_long(wide, ["units"], {m: m for m in metrics}).select(
        "metric", "units", F.col("value").alias("mean")
    )


def two_level_mean(units: DataFrame, entity: str, metric: str) -> DataFrame:
    """Mean of entity means, beside the pooled mean, in one pass over the units."""
    per = units.groupBy(entity).agg(
        F.avg(metric).alias("_m"), F.sum(metric).alias("_s"), F.count(metric).alias("_n")
    )
    return per.agg(
        F.count("*").alias("entities"),
        F.sum("_n").alias("units"),
        F.avg("_m").alias("entity_weighted"),
        (F.sum("_s") / F.sum("_n")).alias("pooled"),
    )


def stratum_breakdown(entities: DataFrame, stratum: str, metrics: list[str]) -> DataFrame:
    """Entity-weighted means per stratum and over all (``stratum`` null, ``is_total`` 1)."""
    return (
        entities.groupingSets([[stratum], []], stratum)
        .agg(
            F.grouping(stratum).cast("int").alias("is_total"),
            F.count("*").alias("entities"),
            *[F.avg(f"mean_{m}").alias(f"mean_{m}") for m in metrics],
        )
    )


def delta_columns(metrics: list[str]) -> dict[str, str]:
    return {f"delta_{m}": m for m in metrics}


def paired_delta_summary(
    pairs: DataFrame,
    metrics: list[str],
    lower: tuple[str, ...],
    higher: tuple[str, ...],
    bound: int | None = None,
) -> DataFrame:
    """Distribution of the per-entity deltas and direction-aware counts, one row per metric. A delta
    that is null or not finite and an empty table fail the job."""
    fault = F.coalesce(*[F.when(~is_finite(F.col(d)), F.lit(d)) for d in delta_columns(metrics)])
    message = F.raise_error(F.concat(fault, F.lit(" is not finite"))).cast("boolean")
    pairs = refuse_empty(pairs, "paired deltas")
    pairs = pairs.where(F.when(fault.isNull(), F.lit(True)).otherwise(message))
    long = to_long(pairs, [], delta_columns(metrics)).withColumn(
        "direction", metric_direction(F.col("metric"), lower, higher)
    )
    better = is_improvement(F.col("direction"), F.col("value"))
    counts = [
        F.count_if(better).alias("improved"),
        F.count_if(~better & (F.col("value") != 0)).alias("worsened"),
        F.count_if(F.col("value") == 0).alias("tied"),
    ]
    return _spread(long, ["metric", "direction"], "value", bound, counts).select(
        "metric", "direction", *_SPREAD, "improved", "worsened", "tied"
    )


def verdicts(summary: DataFrame) -> DataFrame:
    """Per metric whether the mean delta beats the baseline, with the tally over all metrics."""
    flagged = summary.select(
        "metric",
        "direction",
        F.col("mean").alias("mean_delta"),
        is_improvement(F.col("direction"), F.col("mean")).alias("beats_baseline"),
    )
    everything = Window.partitionBy(F.lit(0))  # one row per metric
    return flagged.withColumn(
        "metrics_improved", F.count_if("beats_baseline").over(everything)
    ).withColumn("metrics_total", F.count("*").over(everything))


def linearity_check(pairs: DataFrame, metrics: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Mean of the deltas against the difference of the means, one row per metric."""
    wide = pairs.agg(
        *[
            F.struct(
                F.avg(f"delta_{m}").alias("a"),
                (F.avg(f"method_{m}") - F.avg(f"baseline_{m}")).alias("b"),
            ).alias(m)
            for m in metrics
        ]
    )
    long = wide.select(
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])
        ).alias("r")
    )
    return long.select(
        F.col("r.metric").alias("metric"),
        F.col("r.v.a").alias("mean_of_deltas"),
        F.col("r.v.b").alias("difference_of_means"),
        (F.abs(F.col("r.v.a") - F.col("r.v.b")) <= F.lit(tolerance)).alias("agrees"),
    )


def coverage_summary(units: DataFrame, fractions: list[str], bound: int | None = None) -> DataFrame:
    """min, median, max and zero count of coverage fractions, one row per column."""
    long = to_long(units, [], {c: c for c in fractions})
    zero = F.count_if(F.col("value") == 0).alias("zero")
    return _spread(long, ["metric"], "value", bound, [zero]).select(
        "metric", "n", "min", "median", "max", "zero"
    )


def group_composition(entities: DataFrame, partition: str, stratum: str) -> DataFrame:
    """Entities per partition and stratum."""
    return entities.groupBy(partition, stratum).agg(F.count("*").alias("entities"))
