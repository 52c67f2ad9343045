"""Joins that refuse to lose rows: strict pairing, inheritance, alignment, agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gaugework.functions.values import is_finite
from gaugework.local import pinned
from gaugework.operators.constraints import refuse_empty
from gaugework.operators.ordering import MAX_SLICES, SLICE_ROWS, rank


def lookup_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """``rows`` with the columns of ``lookup`` (one row per key), also when a key is hot.

    A plain join without a hint while no key exceeds ``slice_rows``: small lookups are
    broadcast on their measured size. Otherwise the rows of every hot key are spread over
    parts by content and input split, and its lookup row is repeated once per part.
    """
    total = rows.count()
    if total <= slice_rows:
        return rows.join(lookup, keys, how)
    step = max(slice_rows, -(-total // MAX_SLICES))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    # At most total / step keys can be that large, so at most MAX_SLICES.
    hot = pinned(
        sizes.where(F.col("_n") > step).select(*keys, F.ceil(F.col("_n") / F.lit(step)).alias("_parts"))
    )
    if hot.isEmpty():
        return rows.join(lookup, keys, how)
    mixed = F.xxhash64(*rows.columns, F.spark_partition_id())
    # A null key has no partner, so its rows may go anywhere.
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    part = F.when(no_key, F.pmod(mixed, F.lit(MAX_SLICES))).otherwise(
        F.coalesce(F.pmod(mixed, F.col("_parts")), F.lit(0).cast("long"))
    )
    spread = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", part).drop("_parts")
    last = F.coalesce(F.col("_parts"), F.lit(1).cast("long")) - 1
    repeated = lookup.join(F.broadcast(hot), keys, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("long"), last))
    ).drop("_parts")
    return spread.join(repeated, [*keys, "_part"], how).drop("_part")


def _one_per_key(lookup: DataFrame, keys: list[str], columns: list[str], what: str) -> DataFrame:
    """``lookup`` reduced to one row per key; a key that comes twice fails the job when it is met.
    The aggregate stands where the join deals the lookup anyway."""
    one = lookup.groupBy(*keys).agg(F.count("*").alias("_copies"), *[F.any_value(c).alias(c) for c in columns])
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    message = F.raise_error(F.concat(F.lit(f"{what} is repeated: "), key)).cast("boolean")
    # A filter, so that the check stays where a column is not used.
    return one.where(F.when(F.col("_copies") == 1, F.lit(True)).otherwise(message)).drop("_copies")


def inherit(
    units: DataFrame, entities: DataFrame, entity: str, attributes: list[str], slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Units with the attributes of their entity; a unit without entity, or an entity that comes
    twice, fails the job."""
    lookup = _one_per_key(entities, [entity], attributes, "an entity").withColumn("_known", F.lit(True))
    joined = lookup_join(units, lookup, [entity], "left", slice_rows)
    message = F.raise_error(F.concat(F.lit("unit of unknown entity "), F.coalesce(F.col(entity).cast("string"), F.lit("null"))))
    return joined.where(F.when(F.col("_known"), F.lit(True)).otherwise(message.cast("boolean"))).drop("_known")


def inherited_mismatches(
    units: DataFrame, entities: DataFrame, entity: str, attribute: str, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """One row: units checked and units whose attribute differs from their entity's."""
    lookup = _one_per_key(entities, [entity], [attribute], "an entity").withColumnRenamed(attribute, "_expected")
    return lookup_join(units, lookup, [entity], "left", slice_rows).agg(
        F.count("*").alias("units"),
        F.count_if(~F.col(attribute).eqNullSafe(F.col("_expected"))).alias("mismatched"),
    )


def _unique_side(df: DataFrame, key: str, columns: list[str], label: str) -> DataFrame:
    """One row per key with its row count; grouped by the join key, so no extra shuffle."""
    return df.groupBy(key).agg(
        F.count("*").alias(f"_{label}_n"),
        *[F.any_value(c).alias(f"_{label}_{c}") for c in columns],
    )


def _full_pairs(
    method: DataFrame, baseline: DataFrame, key: str, metrics: list[str], must_match: list[str]
) -> DataFrame:
    columns = [*must_match, *[f"mean_{m}" for m in metrics]]
    for label, side in (("method", method), ("baseline", baseline)):
        missing = [c for c in [key, *columns] if c not in side.columns]
        if missing:
            raise ValueError(f"{label} table lacks column(s) {missing}")
    return _unique_side(method, key, columns, "m").join(
        _unique_side(baseline, key, columns, "b"), key, "full_outer"
    )


def _pair_fault(must_match: list[str]) -> Column:
    alone = (
        F.when(F.col("_m_n").isNull(), F.lit("only in baseline"))
        .when(F.col("_b_n").isNull(), F.lit("only in method"))
        .when(F.col("_m_n") > 1, F.lit("repeated in method"))
        .when(F.col("_b_n") > 1, F.lit("repeated in baseline"))
    )
    return reduce(
        lambda acc, c: acc.when(
            ~F.col(f"_m_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(f"{c} disagrees")
        ),
        must_match,
        alone,
    )


def _metric_fault(fault: Column, metrics: list[str]) -> Column:
    """``fault``, or the first metric that is null or not finite on a side."""
    sides = [F.when(~is_finite(F.col(f"_{s}_mean_{m}")), F.lit(f"{m} is not finite")) for m in metrics for s in "mb"]
    return F.coalesce(fault, *sides)


def _checked_pairs(joined: DataFrame, key: str, metrics: list[str], must_match: list[str]) -> DataFrame:
    fault = _metric_fault(_pair_fault(must_match), metrics)
    message = F.concat(F.lit("not paired: "), F.col(key).cast("string"), F.lit(" "), fault)
    columns = []
    for m in metrics:
        b, x = F.col(f"_b_mean_{m}"), F.col(f"_m_mean_{m}")
        columns += [b.alias(f"baseline_{m}"), x.alias(f"method_{m}"), (x - b).alias(f"delta_{m}")]
    # The check is a filter, so it cannot be pruned away with an unused column.
    return joined.where(F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(message))).select(
        key, *[F.col(f"_m_{c}").alias(c) for c in must_match], *columns
    )


def strict_pairs_of(
    entities: DataFrame,
    key: str,
    method: str,
    name: str,
    baseline: str,
    metrics: list[str],
    must_match: list[str] = ("unit_count",),
) -> DataFrame:
    """:func:`strict_pairs` of two methods held in one table with a ``method`` column.

    Both sides come from one pass; the same faults fail the job.
    """
    columns = [*must_match, *[f"mean_{m}" for m in metrics]]
    sides = {"m": F.col(method) == name, "b": F.col(method) == baseline}
    chosen = refuse_empty(entities.where(F.col(method).isin(name, baseline)), f"{name} and {baseline}")
    both = chosen.groupBy(key).agg(
        *[F.nullif(F.count_if(is_side), F.lit(0)).alias(f"_{s}_n") for s, is_side in sides.items()],
        *[
            F.max(F.when(is_side, F.col(c))).alias(f"_{s}_{c}")
            for s, is_side in sides.items()
            for c in columns
        ],
    )
    return _checked_pairs(both, key, metrics, list(must_match))


def strict_pairs(
    method: DataFrame,
    baseline: DataFrame,
    key: str,
    metrics: list[str],
    must_match: list[str] = ("unit_count",),
) -> DataFrame:
    """``baseline_x, method_x, delta_x`` per entity; anything short of 1:1, a metric that is not
    finite and an empty side fail the job."""
    must_match = list(must_match)
    method, baseline = refuse_empty(method, "method table"), refuse_empty(baseline, "baseline table")
    return _checked_pairs(_full_pairs(method, baseline, key, metrics, must_match), key, metrics, must_match)


def pairing_report(
    method: DataFrame,
    baseline: DataFrame,
    key: str,
    metrics: list[str],
    must_match: list[str] = ("unit_count",),
) -> DataFrame:
    """Count of entities per pairing fault (``paired`` for the good ones)."""
    joined = _full_pairs(method, baseline, key, metrics, list(must_match))
    state = F.coalesce(_pair_fault(list(must_match)), F.lit("paired"))
    return joined.groupBy(state.alias("state")).agg(F.count("*").alias("entities"))


def missing_and_extra(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys by side: in both, only left, only right; each side is deduplicated first."""
    sides = left.select(F.col(key), F.lit(1).alias("_s")).unionByName(
        right.select(F.col(key), F.lit(2).alias("_s"))
    )
    return (
        sides.groupBy(key)
        .agg(F.bit_or("_s").alias("_s"))
        .groupBy(
            F.when(F.col("_s") == 1, F.lit("left_only"))
            .when(F.col("_s") == 2, F.lit("right_only"))
            .otherwise(F.lit("both"))
            .alias("side")
        )
        .agg(F.count("*").alias("keys"))
    )


def orphans(units: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Units whose key has no entity."""
    return units.join(entities.select(key), key, "left_anti")


def members_elsewhere(
    rows: DataFrame, members: DataFrame, entity: str, partition: str, wanted: str
) -> DataFrame:
    """Rows whose entity is in the set but whose partition is not the wanted one."""
    return rows.where(~F.col(partition).eqNullSafe(F.lit(wanted))).join(
        members.select(entity), entity, "left_semi"
    )


def positional_alignment(
    left: DataFrame,
    right: DataFrame,
    left_order: list[str],
    right_order: list[str],
    key: str,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Compare the i-th keys of two ordered tables; a length difference counts as mismatches."""
    a = rank(left, [], left_order, "_pos", slice_rows).select("_pos", F.col(key).alias("_l"))
    b = rank(right, [], right_order, "_pos", slice_rows).select("_pos", F.col(key).alias("_r"))
    joined = a.withColumn("_hl", F.lit(1)).join(b.withColumn("_hr", F.lit(1)), "_pos", "full_outer")
    return joined.agg(
        F.count("_hl").alias("left_rows"),
        F.count("_hr").alias("right_rows"),
        F.count_if(
            ~F.col("_l").eqNullSafe(F.col("_r")) | F.col("_hl").isNull() | F.col("_hr").isNull()
        ).alias("order_mismatches"),
    ).withColumn("identical_order", F.col("order_mismatches") == 0)


def witness_agreement(
    witnesses: DataFrame, keys: list[str], required: int, witness: str = "witness", value: str = "value"
) -> DataFrame:
    """Per key: distinct witnesses present, distinct values, and whether enough of them agree."""
    return (
        witnesses.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count_distinct(witness).alias("witnesses"),
            F.min(value).alias("_low"),
            F.max(value).alias("_high"),
        )
        .select(
            *keys,
            "witnesses",
            ((F.col("witnesses") >= required) & (F.col("_low") == F.col("_high"))).alias("agree"),
        )
    )


def candidate_grid(units: DataFrame, candidates: list[dict], name: str = "candidate") -> DataFrame:
    """Every unit with every candidate parameter set, after the shared unit columns are computed.

    The parameter sets are literals in one array, so the expansion is a narrow explode.
    """
    literal = F.array(
        *[F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in candidates]
    )
    return units.withColumn(name, F.explode(literal))


def same_run_partner(
    results: DataFrame, partners: DataFrame, keys: list[str], run: str, value: str = "value"
) -> DataFrame:
    """Each result with the partner of the same run; a missing or repeated partner fails the job."""
    other = _one_per_key(partners, [*keys, run], [value], "a partner").withColumnRenamed(value, "partner")
    joined = results.join(other.withColumn("_found", F.lit(True)), [*keys, run], "left")
    message = F.raise_error(F.concat(F.lit("no partner for run "), F.coalesce(F.col(run).cast("string"), F.lit("null"))))
    return joined.where(F.when(F.col("_found"), F.lit(True)).otherwise(message.cast("boolean"))).drop("_found")
