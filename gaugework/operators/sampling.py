"""Exactly balanced, reproducible sampling epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugework.functions.keys import keyed_digest, natural_key
from gaugework.local import local_rows
from gaugework.operators import constraints
from gaugework.operators.joins import lookup_join
from gaugework.operators.ordering import SLICE_ROWS, rank, sequence_digest

ALGORITHM = "entity_balanced_v1"


def epoch_quotas(
    units: DataFrame,
    entity: str,
    epoch: int,
    size: int | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Draws per entity: equal shares, the remainder rotating through the natural order.

    Columns ``entity, pool, entity_index, quota``. An epoch smaller than the number of
    entities is refused.
    """
    if epoch < 0:
        raise ValueError(f"epoch must not be negative, got {epoch}")
    pools = units.groupBy(entity).agg(F.count("*").alias("pool"))
    n, draws = _epoch_shape(pools, size)
    keyed = pools.withColumn("_natural", natural_key(entity))
    ranked = rank(keyed, [], ["_natural", entity], "entity_index", slice_rows, n, materialize=True)
    ranked = ranked.drop("_natural")
    share, left = divmod(draws, n)
    start = (epoch * left) % n
    extra = F.pmod(F.col("entity_index") - F.lit(start), F.lit(n)) < left
    return ranked.select(
        entity, "pool", "entity_index", (F.lit(share).cast("long") + extra.cast("long")).alias("quota")
    )


def _epoch_shape(pools: DataFrame, size: int | None) -> tuple[int, int]:
    """Entities and draws of an epoch."""
    row = pools.agg(F.count("*").alias("n"), F.sum("pool").alias("units")).first()
    draws = row["units"] if size is None else size
    if not row["n"] or draws < row["n"]:
        raise ValueError(f"an epoch of {draws} draws is smaller than the number of entities {row['n']}")
    return row["n"], draws


def entity_draws(
    units: DataFrame, entity: str, unit: str, seed: int, epoch: int, size: int | None = None, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Every draw as ``entity, unit, pass, draw``: full keyed permutations before any repeat.

    Draw ``d`` is position ``d % pool`` of pass ``d // pool``. A pool larger than its quota is
    permuted once and cut, so only one pass of a hot entity is ordered.
    """
    quotas = epoch_quotas(units, entity, epoch, size, slice_rows)
    rows = lookup_join(units.select(entity, unit), quotas, [entity], "inner", slice_rows)
    passes = rows.withColumn(
        "pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("pool"))))
    )
    shuffled = passes.withColumn(
        "_hash", keyed_digest(ALGORITHM, seed, epoch, F.col(entity), F.col("pass"), F.col(unit))
    )
    # A pass holds the whole pool once, so the largest pool bounds every group.
    largest = units.count()
    if largest > slice_rows:
        largest = quotas.agg(F.max("pool")).first()[0]
    ranked = rank(shuffled, [entity, "pass"], ["_hash", unit], "_rank", slice_rows, largest, materialize=True)
    draw = F.col("pass") * F.col("pool") + F.col("_rank")
    return ranked.withColumn("draw", draw).where(F.col("draw") < F.col("quota")).select(
        entity, unit, "pass", "draw"
    )


def balanced_epoch(
    units: DataFrame, entity: str, unit: str, seed: int, epoch: int, size: int | None = None, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """The epoch in its final mixed order: ``position, entity, unit, pass, draw``.

    A pure function of (algorithm, seed, epoch) and the pools; row order and layout of the
    input do not matter.
    """
    draws = entity_draws(units, entity, unit, seed, epoch, size, slice_rows)
    mixed = draws.withColumn(
        "_mix", keyed_digest(ALGORITHM, seed, epoch, "order", F.col(entity), F.col("draw"))
    )
    draws_made = units.count() if size is None else size
    return rank(mixed, [], ["_mix", entity, "draw"], "position", slice_rows, draws_made, materialize=True).drop("_mix")


def epoch_report(epoch: DataFrame, units: DataFrame, entity: str, unit: str) -> DataFrame:
    """One row: draws, entities, draws per entity, unique units, repeats and undrawn units."""
    drawn = epoch.groupBy(entity, unit).agg(F.count("*").alias("n"))
    per = drawn.groupBy(entity).agg(F.sum("n").alias("draws"), F.count("*").alias("unique"))
    counts = per.agg(
        F.sum("draws").alias("draws"),
        F.count("*").alias("entities"),
        F.min("draws").alias("min_draws"),
        F.max("draws").alias("max_draws"),
        F.sum("unique").alias("unique_units"),
    ).withColumn("repeats", F.col("draws") - F.col("unique_units"))
    return counts.select(
        "draws", "entities", "min_draws", "max_draws", "unique_units", "repeats",
        (F.lit(units.count()) - F.col("unique_units")).alias("undrawn"),
    )


def draw_distribution(epoch: DataFrame, entity: str) -> DataFrame:
    """How many entities got how many draws."""
    per = epoch.groupBy(entity).agg(F.count("*").alias("draws"))
    return per.groupBy("draws").agg(F.count("*").alias("entities"))


def rotation_totals(units: DataFrame, entity: str, epochs: int, size: int | None = None) -> DataFrame:
    """Quota per entity summed over consecutive epochs, with the number of extra draws.

    Closed form: no epoch is drawn.
    """
    pools = units.groupBy(entity).agg(F.count("*").alias("pool"))
    n, draws = _epoch_shape(pools, size)
    share, left = divmod(draws, n)
    extras = F.aggregate(
        F.array(*[F.lit((e * left) % n) for e in range(epochs)]),
        F.lit(0).cast("long"),
        lambda acc, start: acc
        + (F.pmod(F.col("entity_index") - start, F.lit(n)) < left).cast("long"),
    )
    return epoch_quotas(units, entity, 0, size).select(
        entity, extras.alias("extra_draws"), (F.lit(epochs * share) + extras).alias("total_draws")
    )


def epoch_audit(
    units: DataFrame, entity: str, unit: str, seed: int, epoch: int, size: int | None = None
) -> DataFrame:
    """Constraint report: same inputs repeat the sequence, other epochs and seeds change it,
    and the shortest pool is fully covered before any repeat."""

    draws_made = units.count() if size is None else size

    def digest(s: int, e: int) -> str:
        drawn = balanced_epoch(units, entity, unit, s, e, size)
        return sequence_digest(drawn, ["position"], unit, rows=draws_made, dense=True).first()["digest"]

    spark, base = units.sparkSession, digest(seed, epoch)
    results = [
        ("same seed and epoch repeat", digest(seed, epoch) == base),
        ("another epoch differs", digest(seed, epoch + 1) != base),
        ("another seed differs", digest(seed + 1, epoch) != base),
    ]
    smallest = units.groupBy(entity).agg(F.count("*").alias("pool")).orderBy("pool", entity).limit(1)
    draws = entity_draws(units, entity, unit, seed, epoch, size).where(F.col("pass") == 0)
    first_pass = draws.join(F.broadcast(smallest), entity).agg(  # one row on the right
        F.count_distinct(unit).alias("covered"), F.count("*").alias("drawn")
    ).first()
    results.append(("first pass repeats nothing", first_pass["covered"] == first_pass["drawn"]))
    rows = [(name, bool(ok), 0 if ok else 1, "") for name, ok in results]
    return local_rows(spark, rows, constraints.REPORT_SCHEMA)
