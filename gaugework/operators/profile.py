"""Cohort profiling: rollups, counters, distributions, moments, histograms, quantiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugework.functions import geometry
from gaugework.functions.values import is_finite
from gaugework.operators.ordering import (
    SLICE_ROWS,
    Ordering,
    aggregate_with_quantiles,
    largest_group,
    quantiles,
)


def series_rollup(
    units: DataFrame,
    entity: str,
    order: str,
    first: list[str] = (),
    distinct: list[str] = (),
    low_high: list[str] = (),
    means: list[str] = (),
    any_of: dict[str, Column] | None = None,
    count_if: dict[str, Column] | None = None,
) -> DataFrame:
    """Per-entity facts in one aggregate. ``first`` is the value on the lowest ``order`` row."""
    return units.groupBy(entity).agg(
        F.count("*").alias("units"),
        *[F.min_by(c, order).alias(f"first_{c}") for c in first],
        *[F.count_distinct(c).alias(f"distinct_{c}") for c in distinct],
        *[agg(c).alias(f"{label}_{c}") for c in low_high for label, agg in (("min", F.min), ("max", F.max))],
        *[F.avg(c).alias(f"mean_{c}") for c in means],
        *[F.bool_or(F.coalesce(c, F.lit(False))).alias(f"any_{n}") for n, c in (any_of or {}).items()],
        *[F.count_if(c).alias(f"count_{n}") for n, c in (count_if or {}).items()],
    )


def cohort_counters(
    units: DataFrame,
    entity: str,
    by: list[str] = (),
    counts: dict[str, Column] | None = None,
    means: list[str] = (),
    maxima: list[str] = (),
    all_of: dict[str, Column] | None = None,
    minima: list[str] = (),
    medians: list[str] = (),
) -> DataFrame:
    """Counts, distinct entities, conditional counts and null-tolerant mean/min/median/max/all. The
    medians are exact, by :func:`gaugework.operators.ordering.quantiles`."""
    if medians:
        out = cohort_counters(units, entity, by, counts, means, maxima, all_of, minima)
        for c in medians:
            found = quantiles(units, list(by), c, [0.5], "_q").select(
                *[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.get("_q", F.lit(0)).alias(f"median_{c}")
            )
            same = [out[b].eqNullSafe(found[f"_b{i}"]) for i, b in enumerate(by)] or [F.lit(True)]
            # One row per group on both sides.
            out = out.join(found, reduce(lambda a, b: a & b, same), "left").drop(*[f"_b{i}" for i in range(len(by))])
        return out
    grouped = units.groupBy(*by)
    return grouped.agg(
        F.count("*").alias("units"),
        F.count_distinct(entity).alias("entities"),
        *[F.count_if(c).alias(n) for n, c in (counts or {}).items()],
        *[F.avg(c).alias(f"mean_{c}") for c in means],
        *[F.min(c).alias(f"min_{c}") for c in minima],
        *[F.max(c).alias(f"max_{c}") for c in maxima],
        *[F.bool_and(c).alias(n) for n, c in (all_of or {}).items()],
    )


def known_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: rows with a value, rows without, and distinct values, in one pass."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    long = df.select(F.explode(entries).alias("r")).select("r.*")
    return long.groupBy("column").agg(
        F.count("value").alias("present"),
        F.count_if(F.col("value").isNull()).alias("absent"),
        F.count_distinct("value").alias("values"),
    )


def value_distribution(df: DataFrame, columns: list[str], top: int | None = 10) -> DataFrame:
    """Counts per (column, value), nulls left out; with ``top``, the most frequent per column.

    Ties are broken by value. The rank filter becomes a per-task limit before the shuffle,
    so a column with very many values still sends only ``top`` rows per task.
    """
    long = df.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
            )
        ).alias("r")
    ).select("r.*")
    counts = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    if top is None:
        return counts
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def outlier_positions(
    cells: DataFrame, units: DataFrame, entity: str, coordinate: list[str], value: str, outside: str
) -> DataFrame:
    """Per (entity, coordinate): units with an outlier there, value range, all-outside flag,
    and whether every unit of the entity has one."""
    sizes = units.groupBy(entity).agg(F.count("*").alias("entity_units"))
    found = cells.groupBy(entity, *coordinate).agg(
        F.count("*").alias("units_with_outlier"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.bool_and(outside).alias("always_outside"),
    )
    return found.join(sizes, entity, "left").withColumn(
        "in_every_unit", F.col("units_with_outlier") == F.col("entity_units")
    )


def moments(df: DataFrame, value: str, group: list[str] = (), low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Mergeable moments with population variance and counts at or beyond the bounds."""
    x = F.col(value).cast("double")
    sums = df.groupBy(*group).agg(
        F.count(x).alias("n"),
        F.sum(x).alias("sum"),
        F.sum(x * x).alias("sum_sq"),
        F.sum(F.abs(x)).alias("sum_abs"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.count_if(x <= low).alias("at_low"),
        F.count_if(x >= high).alias("at_high"),
    )
    n = F.nullif(F.col("n"), F.lit(0))
    mean = F.col("sum") / n
    return sums.withColumn("mean", mean).withColumn(
        "variance", F.greatest(F.col("sum_sq") / n - mean * mean, F.lit(0.0))
    )


def first_failures(df: DataFrame, bad: Column, key: str, limit: int = 8) -> DataFrame:
    """The first failing keys in key order; each task keeps at most ``limit``."""
    return df.where(bad).select(key).orderBy(key).limit(limit)


def histogram(df: DataFrame, value: str, bins: int, low: float = 0.0, high: float = 1.0, group: list[str] = ()) -> DataFrame:
    """Fixed-width counts with the index clamped into range."""
    place = F.floor((F.col(value).cast("double") - F.lit(low)) / F.lit((high - low) / bins))
    clamped = F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.where(is_finite(F.col(value))).groupBy(*group, clamped.alias("bin")).agg(F.count("*").alias("n"))


def histogram_quantile(counts: DataFrame, bins: int, probs: list[float], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Centre of the first bin whose running count reaches ``q * n``; at most ``bins`` rows in."""
    one = Window.partitionBy(F.lit(0))
    upto = F.sum("n").over(one.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    running = counts.groupBy("bin").agg(F.sum("n").alias("n")).select(
        "bin",
        upto.alias("upto"),
        F.sum("n").over(one).alias("total"),
    )
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    return (
        running.withColumn("q", wanted)
        .where(F.col("upto") >= F.col("q") * F.col("total"))
        .groupBy("q")
        .agg(F.min("bin").alias("bin"))
        .withColumn("value", F.lit(low) + (F.col("bin") + F.lit(0.5)) * F.lit((high - low) / bins))
    )


def quantile_rows(df: DataFrame, group: list[str], value: str, probs: list[float], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Exact quantiles, one row per (group, q)."""
    out = quantiles(df, group, value, probs, "_q")
    labels = F.array(*[F.lit(float(p)) for p in probs])
    return out.select(
        *group,
        F.explode(F.zip_with(labels, "_q", lambda p, v: F.struct(p.alias("q"), v.alias("value")))).alias("_r"),
    ).select(*group, "_r.q", "_r.value")


def latency_summary(
    df: DataFrame,
    group: str,
    value: str,
    expected: int | None = None,
    slice_rows: int = SLICE_ROWS,
    bound: int | None = None,
) -> DataFrame:
    """mean, SD, p50, p95, min, max per group. Every sample must be finite and positive, and
    with ``expected`` the sample count must be exact; otherwise the job fails."""
    x = F.col(value)
    aggregates = [
        F.count("*").alias("samples"),
        F.count_if(~(is_finite(x) & (x > 0))).alias("_bad"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    ]
    stats = aggregate_with_quantiles(
        df, [group], aggregates, value, [0.5, 0.95], "_q", slice_rows, bound
    )
    wrong = F.col("_bad") > 0
    if expected is not None:
        wrong = wrong | (F.col("samples") != expected)
    checked = F.when(~wrong, F.col("samples")).otherwise(
        F.raise_error(F.concat(F.lit("unusable samples of "), F.col(group)))
    )
    return stats.select(
        group,
        checked.alias("samples"),
        "mean",
        "sd",
        F.get("_q", F.lit(0)).alias("p50"),
        F.get("_q", F.lit(1)).alias("p95"),
        "min",
        "max",
    )


def latency_ratios(summary: DataFrame, group: str, numerator: str, denominator: str) -> DataFrame:
    """p50 and mean of one method over another, from a summary with one row per method."""
    g = F.col(group)
    picks = [
        F.max(F.when(g == name, F.col(c))).alias(f"_{side}_{c}")
        for side, name in (("n", numerator), ("d", denominator))
        for c in ("p50", "mean")
    ]
    return summary.agg(*picks).select(
        (F.col("_n_p50") / F.col("_d_p50")).alias("ratio_p50"),
        (F.col("_n_mean") / F.col("_d_mean")).alias("ratio_mean"),
    )


def contract_scan(df: DataFrame, checks: dict[str, Column], value_range: Column | None = None) -> DataFrame:
    """Failure count per contract in one pass, with the observed range."""
    extra = []
    if value_range is not None:
        extra = [F.min(value_range["low"]).alias("observed_min"), F.max(value_range["high"]).alias("observed_max")]
    return df.agg(
        F.count("*").alias("units"),
        *[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"bad_{n}") for n, c in checks.items()],
        *extra,
    )


def gap_report(
    units: DataFrame,
    entity: str,
    position: str,
    file: str,
    instance: str,
    tolerance: float = 1e-3,
    relative: float = 1e-5,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Spacing and order facts per entity, from one ordering by position.

    Order agreement needs no second sort: files are in position order exactly when no row's
    file sorts before its predecessor's, and likewise for instances. The spacing test is
    against the median step, within ``tolerance + relative * |median|``.
    """
    largest = largest_group(units, [entity], slice_rows)
    rows = Ordering(
        units.select(entity, position, file, instance), [entity], [position, file], slice_rows, largest
    ).previous([position, file, instance])
    step = F.abs(F.col(position) - F.col(f"prev_{position}"))
    rows = rows.withColumn("_step", step)
    def in_order(prev: Column, here: Column) -> Column:
        return F.coalesce(F.bool_and(prev <= here), F.lit(True))

    aggregates = [
        F.count("*").alias("units"),
        F.min(position).alias("min_position"),
        F.max(position).alias("max_position"),
        F.min("_step").alias("min_step"),
        F.max("_step").alias("max_step"),
        F.count_if(F.col("_step") == 0).alias("duplicate_positions"),
        in_order(F.col(f"prev_{file}"), F.col(file)).alias("file_order_matches"),
        in_order(F.col(f"prev_{instance}"), F.col(instance)).alias("instance_order_matches"),
        in_order(F.col(instance), F.col(f"prev_{instance}")).alias("reversed_instance_matches"),
    ]
    facts = aggregate_with_quantiles(
        rows, [entity], aggregates, "_step", [0.5], "_q", slice_rows, largest
    ).withColumn("median_step", F.get("_q", F.lit(0))).drop("_q")
    near = F.lit(tolerance) + F.lit(relative) * F.abs("median_step")
    uniform = (F.abs(F.col("min_step") - F.col("median_step")) <= near) & (
        F.abs(F.col("max_step") - F.col("median_step")) <= near
    )
    return facts.withColumn("uniform_spacing", uniform)


def orientation_report(
    units: DataFrame,
    entity: str,
    orientation: str,
    position: str,
    instance: str,
    tolerance: float = geometry.AXIAL_TOLERANCE,
) -> DataFrame:
    """Presence of the geometry and constancy of the plane per entity (the rest of W3).

    ``orientation`` holds six direction cosines, ``position`` a point; either may be null, and so
    may the normal of an orientation that spans no plane. ``orientation_constant`` is exact;
    ``plane_constant`` holds when all normals agree within ``tolerance`` up to their sign: the
    products of two components do not see the sign, so their ranges tell, and no vectors are
    compared. Both are null, as ``all_axial``, where an entity has no value to judge by. Units are
    added up per different orientation first, so a large entity does not meet in one task.
    """
    rows = units.select(entity, orientation, position, instance).withColumn("_n", geometry.plane_normal(F.col(orientation)))
    z = F.get(position, F.lit(2)).cast("double")
    apart = F.abs(geometry.projected_position(F.col(position), F.col("_n")) - z)
    per_orientation = rows.groupBy(entity, orientation).agg(
        F.count("*").alias("_units"),
        F.count(position).alias("_positions"),
        F.count(instance).alias("_instances"),
        F.max(apart).alias("_apart"),
    ).withColumn("_n", geometry.plane_normal(F.col(orientation)))
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    products = [F.get("_n", F.lit(i)) * F.get("_n", F.lit(j)) for i, j in pairs]
    ranges = [F.max(p) - F.min(p) for p in products]
    share = lambda n: F.sum(n) / F.sum("_units")
    return per_orientation.groupBy(entity).agg(
        F.sum("_units").alias("units"),
        share("_positions").alias("position_fraction"),
        share(F.when(F.col(orientation).isNotNull(), F.col("_units")).otherwise(0)).alias("orientation_fraction"),
        share("_instances").alias("instance_fraction"),
        F.count(orientation).alias("distinct_orientations"),
        F.when(F.count(orientation) > 0, F.count(orientation) == 1).alias("orientation_constant"),
        (F.greatest(*ranges) <= F.lit(tolerance)).alias("plane_constant"),
        F.bool_and(geometry.is_axial(F.col("_n"), tolerance)).alias("all_axial"),
        F.max("_apart").alias("max_projected_minus_z"),
    )


def entity_index(units: DataFrame, entity: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Entities with their unit count and position in natural order."""
    from gaugework.functions.keys import natural_key
    from gaugework.operators.ordering import rank

    counts = units.groupBy(entity).agg(F.count("*").alias("units"))
    keyed = counts.withColumn("_natural", natural_key(entity))
    return rank(keyed, [], ["_natural", entity], "entity_index", slice_rows, units.count(), materialize=True).drop("_natural")
