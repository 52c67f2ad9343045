"""Integrity gates as data-quality constraints.

Every check yields ``check, passed, n_bad, detail``; a report collects all of them before
anything fails. Row-level checks of one table share a single aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T
from gaugework.local import local_rows

REPORT_SCHEMA = T.StructType(
    [
        T.StructField("check", T.StringType()),
        T.StructField("passed", T.BooleanType()),
        T.StructField("n_bad", T.LongType()),
        T.StructField("detail", T.StringType()),
    ]
)


class ConstraintError(ValueError):
    """One or more constraints do not hold."""


def _report(bad: DataFrame, check: str, detail: Column | str = "") -> DataFrame:
    """A one-row report from a one-row frame with ``n_bad``."""
    text = detail if isinstance(detail, Column) else F.lit(detail)
    return bad.select(
        F.lit(check).alias("check"),
        (F.coalesce(F.col("n_bad"), F.lit(0)) == 0).alias("passed"),
        F.coalesce(F.col("n_bad"), F.lit(0)).cast("long").alias("n_bad"),
        text.cast("string").alias("detail"),
    )


def combine(reports: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), reports)


def require(report: DataFrame) -> None:
    """Raise with every failed check. A report has one row per check, so it is small."""
    failed = report.where(~F.col("passed")).orderBy("check").collect()
    if failed:
        raise ConstraintError(
            "; ".join(f"{r['check']}: {r['n_bad']} bad {r['detail'] or ''}".strip() for r in failed)
        )


def required_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Schema check; reads no data."""
    missing = [c for c in columns if c not in df.columns]
    row = ("required columns", not missing, len(missing), ",".join(missing))
    return local_rows(df.sparkSession, [row], REPORT_SCHEMA)


def projection(df: DataFrame, allow: list[str], deny: list[str] = ()) -> DataFrame:
    """Exactly the allowed columns in order; a denied column in the result is refused."""
    leaking = sorted(set(allow) & set(deny))
    missing = [c for c in allow if c not in df.columns]
    if leaking or missing:
        raise ConstraintError(f"projection leaks {leaking}, lacks {missing}")
    return df.select(*allow)


def rows(df: DataFrame, good: dict[str, Column], key: str | None = None) -> DataFrame:
    """Row-level conditions in one pass; null counts as bad. ``detail`` names the first bad key."""
    bad = {name: ~F.coalesce(cond, F.lit(False)) for name, cond in good.items()}
    names = list(good)
    first = [
        F.min(F.when(bad[n], F.col(key))).cast("string") if key else F.lit("")
        for n in names
    ]
    one = df.agg(
        *[F.count_if(bad[n]).alias(f"_n{i}") for i, n in enumerate(names)],
        *[F.coalesce(first[i], F.lit("")).alias(f"_d{i}") for i in range(len(names))],
    )
    stacked = F.array(
        *[
            F.struct(
                F.lit(n).alias("check"),
                (F.col(f"_n{i}") == 0).alias("passed"),
                F.col(f"_n{i}").alias("n_bad"),
                F.col(f"_d{i}").alias("detail"),
            )
            for i, n in enumerate(names)
        ]
    )
    return one.select(F.explode(stacked).alias("r")).select("r.*")


def from_counts(df: DataFrame, bad: dict[str, Column]) -> DataFrame:
    """A report from aggregates that each count something bad, all in one pass."""
    names = list(bad)
    one = df.agg(*[F.coalesce(bad[n], F.lit(0)).cast("long").alias(f"_n{i}") for i, n in enumerate(names)])
    stacked = F.array(
        *[
            F.struct(
                F.lit(n).alias("check"),
                (F.col(f"_n{i}") == 0).alias("passed"),
                F.col(f"_n{i}").alias("n_bad"),
                F.lit("").alias("detail"),
            )
            for i, n in enumerate(names)
        ]
    )
    return one.select(F.explode(stacked).alias("r")).select("r.*")


def not_empty(df: DataFrame, check: str = "not empty") -> DataFrame:
    return _report(df.limit(1).agg((1 - F.count("*")).alias("n_bad")), check)


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*columns).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def unique(df: DataFrame, columns: list[str], check: str | None = None) -> DataFrame:
    bad = duplicates(df, columns).agg(F.count("*").alias("n_bad"))
    return _report(bad, check or f"unique {','.join(columns)}")


def inconsistent_groups(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Groups in which a column has more than one value (null is a value)."""
    variants = df.select(*group, F.struct(*columns).alias("_v")).distinct()
    return variants.groupBy(*group).agg(F.count("*").alias("variants")).where(F.col("variants") > 1)


def constant(df: DataFrame, group: list[str], columns: list[str], check: str | None = None) -> DataFrame:
    bad = inconsistent_groups(df, group, columns).agg(F.count("*").alias("n_bad"))
    return _report(bad, check or f"constant {','.join(columns)} per {','.join(group)}")


def domain(df: DataFrame, column: str, allowed: list, check: str | None = None) -> DataFrame:
    """Values outside the domain; null is outside."""
    outside = ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return _report(df.agg(F.count_if(outside).alias("n_bad")), check or f"domain {column}")


def expected_counts(
    df: DataFrame, group: str, expected: dict[str, int], total: int | None = None, check: str = "expected counts"
) -> DataFrame:
    """Exact rows per group and in total; groups that are missing or unplanned count as bad."""
    wanted = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    counts = df.groupBy(F.col(group).cast("string").alias("_g")).agg(F.count("*").alias("_n"))
    plan = local_rows(df.sparkSession, [(k,) for k in expected], "_g string")
    both = counts.join(plan.withColumn("_planned", F.lit(True)), "_g", "full_outer").select(
        F.coalesce("_n", F.lit(0)).alias("_n"), F.get(F.array(wanted[F.col("_g")]), F.lit(0)).alias("_w")
    )
    off = ~F.col("_n").eqNullSafe(F.col("_w").cast("long"))
    target = F.lit(sum(expected.values()) if total is None else total)
    bad = both.agg((F.count_if(off) + F.when(F.sum("_n") == target, 0).otherwise(1)).alias("n_bad"))
    return _report(bad, check)


def same_keys(left: DataFrame, right: DataFrame, columns: list[str], check: str = "same keys") -> DataFrame:
    """Set equality, in one pass over both sides."""
    sides = left.select(*columns, F.lit(1).alias("_s")).unionByName(
        right.select(*columns, F.lit(2).alias("_s"))
    )
    bad = sides.groupBy(*columns).agg(F.bit_or("_s").alias("_s")).agg(
        F.count_if(F.col("_s") == 1).alias("l"), F.count_if(F.col("_s") == 2).alias("r")
    )
    bad = bad.withColumn("n_bad", F.col("l") + F.col("r"))
    return _report(bad, check, F.concat(F.lit("missing "), F.col("l"), F.lit(", extra "), F.col("r")))


def shared_digest(df: DataFrame, key: list[str], digest: str, check: str = "shared input digest") -> DataFrame:
    """All methods of one unit must have seen the same input."""
    bad = (
        df.groupBy(*key)
        .agg(F.min(digest).alias("a"), F.max(digest).alias("b"), F.count(digest).alias("n"), F.count("*").alias("m"))
        .agg(F.count_if((F.col("a") != F.col("b")) | (F.col("n") != F.col("m"))).alias("n_bad"))
    )
    return _report(bad, check)


def plan_gaps(plan: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Planned combinations without a result; results are reduced to their few keys first."""
    return plan.select(*keys).distinct().join(results.select(*keys).distinct(), keys, "left_anti")


def unplanned(plan: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Result combinations outside the plan."""
    return results.select(*keys).distinct().join(plan.select(*keys), keys, "left_anti")


def planned(plan: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    missing = plan_gaps(plan, results, keys).agg(F.count("*").alias("n_bad"))
    extra = unplanned(plan, results, keys).agg(F.count("*").alias("n_bad"))
    return combine([_report(missing, "plan complete"), _report(extra, "nothing unplanned")])


def leaking_entities(df: DataFrame, entity: str, partition: str) -> DataFrame:
    """Entities found in more than one partition."""
    pairs = df.select(entity, partition).distinct()
    return pairs.groupBy(entity).agg(F.count("*").alias("partitions")).where(F.col("partitions") > 1)


def no_leakage(df: DataFrame, entity: str, partition: str) -> DataFrame:
    bad = leaking_entities(df, entity, partition).agg(F.count("*").alias("n_bad"))
    return _report(bad, "no entity in two partitions")


def only_partitions(df: DataFrame, partition: str, allowed: list[str]) -> DataFrame:
    """Sealed-partition gate on the metadata frame: sealed and unlabelled rows are both bad.

    Run it (and :func:`require` it) on the manifest before any content is read.
    """
    return domain(df, partition, allowed, f"only partitions {','.join(allowed)}")


def refuse_empty(df: DataFrame, what: str) -> DataFrame:
    """``df``, whose use fails the job if it has no row. The check is a branch of the same plan that
    looks for one row."""
    first = df.limit(1).agg(F.count("*").alias("_n"))
    message = F.raise_error(F.lit(f"{what}: no rows")).cast("boolean")
    guard = first.where(F.when(F.col("_n") == 0, message).otherwise(F.lit(False)))
    return df.unionAll(guard.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))


def require_open(df: DataFrame, partition: str, allowed: list[str]) -> DataFrame:
    """``df`` whose rows fail the job unless their label is an open partition; a row without a label
    fails too. For rows that reach a reader by any other route than :func:`open_partition`."""
    if partition not in df.columns:
        raise ConstraintError(f"the rows have no column {partition!r}, so their partition is not known")
    label = F.col(partition)
    fault = F.concat(F.lit("sealed or unknown partition: "), F.coalesce(label.cast("string"), F.lit("no label")))
    is_open = F.coalesce(label.isin(*allowed), F.lit(False))
    # A filter, so that the check stays where later steps drop the label.
    return df.where(F.when(is_open, F.lit(True)).otherwise(F.raise_error(fault).cast("boolean")))


def open_partition(df: DataFrame, partition: str, wanted: str, allowed: list[str]) -> DataFrame:
    """The rows of one open partition; the filter reaches the scan."""
    if wanted not in allowed:
        raise ConstraintError(f"partition {wanted!r} is not open; open are {allowed}")
    return df.where(F.col(partition) == wanted)


def within_tolerance(
    left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float, check: str = "two routes agree"
) -> DataFrame:
    """Two routes to the same value, key by key; a key on one side only is bad."""
    a = left.select(*keys, F.col(value).alias("_a"))
    b = right.select(*keys, F.col(value).alias("_b"))
    near = F.abs(F.col("_a") - F.col("_b")) <= F.lit(tolerance)
    bad = a.join(b, keys, "full_outer").agg(
        F.count_if(~F.coalesce(near, F.lit(False))).alias("n_bad")
    )
    return _report(bad, check)


def same_bytes(left: DataFrame, right: DataFrame, keys: list[str], digest: str, check: str = "identical content") -> DataFrame:
    """Two pipelines gave the same content, compared by digest."""
    a = left.select(*keys, F.col(digest).alias("_a"))
    b = right.select(*keys, F.col(digest).alias("_b"))
    bad = a.join(b, keys, "full_outer").agg(
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_a") != F.col("_b"))).alias("n_bad")
    )
    return _report(bad, check)


def recorded_choice(recorded: DataFrame, recomputed: DataFrame, keys: list[str], choice: str) -> DataFrame:
    """The recorded selection equals the one computed again from its evidence."""
    a = recorded.select(*keys, F.col(choice).alias("_a"))
    b = recomputed.select(*keys, F.col(choice).alias("_b"))
    bad = a.join(b, keys, "full_outer").agg(
        F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_bad")
    )
    return _report(bad, "recorded choice equals recomputed choice")


def pooled_sources(sources: dict[str, DataFrame], entity: str) -> DataFrame:
    """Union of sources with a ``source`` column."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def clashing_entities(pooled: DataFrame, entity: str, source: str = "source") -> DataFrame:
    """Entity ids that come from more than one source."""
    return (
        pooled.groupBy(entity)
        .agg(F.count_distinct(source).alias("sources"))
        .where(F.col("sources") > 1)
    )

