"""Picking rows: positional index, middle row, candidate ranking, epoch selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugework.functions.keys import natural_key
from gaugework.functions.values import is_finite
from gaugework.operators.constraints import refuse_empty
from gaugework.operators.ordering import SLICE_ROWS, Ordering, rank


def positional_index(
    units: DataFrame,
    entity: str,
    position: str,
    key: str,
    name: str = "index",
    slice_rows: int = SLICE_ROWS,
    bound: int | None = None,
    materialize: bool = False,
) -> DataFrame:
    """0-based rank inside the entity by position; equal positions fall back to the key."""
    return rank(units, [entity], [position, key], name, slice_rows, bound, materialize)


def middle_pick(
    units: DataFrame, group: list[str], entity: str, position: str, key: str, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """The middle unit (``n // 2``) of the first entity, in natural order, of every group."""
    keyed = units.groupBy(*group, entity).agg(F.count("*").alias("_n"))
    first = keyed.groupBy(*group).agg(
        F.min_by(F.struct(entity, "_n"), F.struct(natural_key(entity), F.col(entity))).alias("_f")
    ).select(*group, F.col(f"_f.{entity}").alias(entity), F.col("_f._n").alias("_n"))
    rows = units.join(first, [*group, entity])
    ranked = rank(rows, group, [position, key], "_rank", slice_rows, units.count(), materialize=True)
    return ranked.where(F.col("_rank") == F.floor(F.col("_n") / 2)).drop("_rank", "_n")


def rank_candidates(
    candidates: DataFrame, metrics: list[str], parameters: list[str], slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Best first by metrics (higher wins, in order), then gentler parameters.

    Adds ``selection_rank`` and ``selected``; a repeated parameter set, a metric that is null or not
    finite and a table without candidates fail the job.
    """
    candidates = refuse_empty(candidates, "candidates")
    repeats = candidates.groupBy(*parameters).agg(F.count("*").alias("_copies"), *[F.any_value(c).alias(c) for c in candidates.columns if c not in parameters])
    keyed = repeats.select("*", *[(-F.col(m)).alias(f"_neg_{m}") for m in metrics])
    order = [*[f"_neg_{m}" for m in metrics], *parameters]
    ranked = Ordering(keyed, [], order, slice_rows, materialize=True).rank("_rank")
    place = F.when(F.col("_copies") == 1, F.col("_rank") + 1).otherwise(
        F.raise_error(F.lit("a parameter set is repeated"))
    )
    for m in metrics:
        place = F.when(is_finite(F.col(m)), place).otherwise(
            F.raise_error(F.lit(f"{m} of a candidate is null or not finite"))
        )
    return ranked.select(
        *candidates.columns, place.alias("selection_rank"), (F.col("_rank") == 0).alias("selected")
    )


def best_epoch(
    history: DataFrame, run: list[str], epoch: str, metric: str, zero_eligible: bool = False
) -> DataFrame:
    """Lowest metric per run, earliest epoch on ties; epoch 0 is not eligible.

    Gaps, repeats and non-finite metrics of eligible epochs fail the job.
    """
    e, m = F.col(epoch), F.col(metric)
    eligible = F.lit(True) if zero_eligible else e != 0
    facts = history.groupBy(*run).agg(
        F.min(F.when(eligible, F.struct(m.alias("metric"), e.alias("epoch")))).alias("_best"),
        F.count("*").alias("_rows"),
        F.count_distinct(epoch).alias("_epochs"),
        (F.max(e) - F.min(e) + 1).alias("_span"),
        F.count_if(eligible & ~is_finite(m)).alias("_bad"),
    )
    sound = (
        (F.col("_rows") == F.col("_epochs"))
        & (F.col("_span") == F.col("_epochs"))
        & (F.col("_bad") == 0)
        & F.col("_best").isNotNull()
    )
    best = F.when(sound, F.col("_best.epoch")).otherwise(
        F.raise_error(F.lit("history has gaps, repeats, non-finite metrics or no eligible epoch"))
    )
    return facts.select(*run, best.alias("best_epoch"), F.col("_best.metric").alias("best_metric"))


def best_so_far(
    history: DataFrame, run: list[str], epoch: str, metric: str, name: str = "is_best_so_far", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Flag rows that set a strict new minimum of their run; a null or non-finite value is never
    best and hides no later one."""
    finite = F.coalesce(is_finite(F.col(metric)), F.lit(False))
    keyed = history.withColumn("_neg", F.when(finite, -F.col(metric)))
    looked = Ordering(keyed, run, [epoch], slice_rows, materialize=True).previous_max("_neg", "_peak")
    flag = F.col("_neg").isNotNull() & F.coalesce(F.col("_neg") > F.col("_peak"), F.lit(True))
    return looked.withColumn(name, flag).drop("_neg", "_peak")


def smallest_pool(units: DataFrame, entity: str) -> DataFrame:
    """The entity with the fewest units, ties by id."""
    return units.groupBy(entity).agg(F.count("*").alias("units")).orderBy("units", entity).limit(1)


def probe_rows(df: DataFrame, order: list[str], k: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``k`` rows evenly spread over the ordered table (every row when there are no more)."""
    from gaugework.functions.keys import probe_positions

    n = df.count()
    ranked = rank(df, [], order, "position", slice_rows, bound=n)
    wanted = probe_positions(F.lit(n), k)
    return ranked.where(F.array_contains(wanted, F.col("position").cast("long")))
