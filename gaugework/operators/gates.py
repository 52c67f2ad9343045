"""Integrity gates of several tables in one pass over each.

A report built check by check reads its table once per check. Here the checks are declared first;
every row of a table then gives one entry per check it takes part in (a key, a value, a measure),
and the entries of all tables are grouped together by check and key. A table is read once however
many checks it has, and a check across tables, such as equal key sets, needs no join: the entries
of both sides meet in one group. Entries are added up before they move, so a key with very many
rows costs a row per task; a row-level condition gives an entry only where it fails.

For conditions on a table that is written or scored anyway, :class:`RowGates` counts failures with
``DataFrame.observe`` while that pass runs, and reads nothing again.

A report has the columns ``check, passed, n_bad, detail`` of :mod:`gaugework.operators.constraints`,
one row per check in the order they were declared. Null keys and null values are values like any
other; a null condition fails; a check without rows passes, unless it asks for rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from gaugework.local import local_rows
from gaugework.operators.constraints import REPORT_SCHEMA

ENTRY = "struct<c: int, k: string, v: string, side: tinyint, m: double>"


@dataclass(frozen=True)
class _Check:
    name: str
    #: Bad keys (0 or 1 each, or rows) as an expression over the sums of a group.
    bad: Column
    #: Of a key the sums know: whether it counts towards ``wanted`` keys.
    seen: Column | None = None
    #: Keys that have to be there; each one missing is bad.
    wanted: int = 0
    #: Rows that all keys together have to have.
    total: int | None = None
    sides: bool = False


def _text(df: DataFrame, name: str) -> Column:
    """A column as text that is equal exactly where the column is."""
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(F.struct(column), {"ignoreNullFields": "false"})
    return column.cast("string")


def _key(df: DataFrame, names: list[str]) -> Column:
    """Several columns as one text that is equal exactly where all of them are: one row of plain fields
    groups faster than arrays. A single column is its own text."""
    if len(names) == 1:
        return _text(df, names[0])
    parts = []
    for name in names:
        text = _text(df, name)
        if not isinstance(df.schema[name].dataType, (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType)):
            text = F.concat(F.length(text).cast("string"), F.lit(":"), text)
        parts += [F.coalesce(text, F.lit("N")), F.lit(",")]
    return F.concat(*parts) if parts else F.lit("")


class Gates:
    """Declare tables and checks, then take the :meth:`report`."""

    def __init__(self) -> None:
        self._tables: list[tuple[DataFrame, list[Column]]] = []
        self._checks: list[_Check] = []

    def table(self, df: DataFrame) -> GatedTable:
        self._tables.append((df, []))
        return GatedTable(self, len(self._tables) - 1)

    def _declare(self, check: _Check) -> int:
        self._checks.append(check)
        return len(self._checks) - 1

    def same_keys(
        self, left: GatedTable, left_keys: list[str], right: GatedTable, right_keys: list[str], check: str = "same keys"
    ) -> None:
        """Both tables have the same keys; those of ``left`` alone count as missing."""
        number = self._declare(_Check(check, (F.col("s") != 3).cast("long"), sides=True))
        left._entry(number, left_keys, side=1)
        right._entry(number, right_keys, side=2)

    def planned(self, plan: GatedTable, plan_keys: list[str], results: GatedTable, keys: list[str]) -> None:
        """Every planned key has a result and no other key has one."""
        missing = self._declare(_Check("plan complete", (F.col("s") == 1).cast("long")))
        extra = self._declare(_Check("nothing unplanned", (F.col("s") == 2).cast("long")))
        for number in (missing, extra):
            plan._entry(number, plan_keys, side=1)
            results._entry(number, keys, side=2)

    def report(self) -> DataFrame:
        if not self._checks:
            raise ValueError("no check is declared")
        entries = reduce(
            DataFrame.unionAll,
            [df.select(F.explode(F.array_compact(F.array(*e))).alias("e")).select("e.*") for df, e in self._tables if e],
        )
        groups = (
            entries.groupBy("c", "k", "v")
            .agg(
                F.count("*").alias("n"), F.bit_or("side").alias("s"),
                F.sum("m").alias("sum"), F.count("m").alias("count"),
            )
            .withColumn("avg", F.col("sum") / F.nullif("count", F.lit(0)))
            .groupBy("c", "k")
            .agg(
                F.sum("n").alias("n"), F.count("*").alias("variants"), F.bit_or("s").alias("s"),
                F.sum("sum").alias("sum"), F.sum("count").alias("count"),
                F.sum(F.col("avg") * F.col("count")).alias("weighted"),
            )
        )
        bad, seen = F.lit(0).cast("long"), F.lit(0).cast("long")
        for i, check in enumerate(self._checks):
            here = F.col("c") == i
            bad = F.when(here, check.bad).otherwise(bad)
            if check.seen is not None:
                seen = F.when(here, check.seen.cast("long")).otherwise(seen)
        per_check = groups.groupBy("c").agg(
            F.sum(bad).alias("bad"), F.sum(seen).alias("seen"), F.sum("n").alias("rows"),
            F.count_if(F.col("s") == 1).alias("left"), F.count_if(F.col("s") == 2).alias("right"),
        )
        rows = [(i, c.name, c.wanted, c.total, c.sides) for i, c in enumerate(self._checks)]
        spark = self._tables[0][0].sparkSession
        listed = local_rows(spark, rows, "c int, check string, wanted long, total long, sides boolean")
        none = F.lit(0).cast("long")
        # One row per check on both sides.
        both = listed.join(F.broadcast(per_check), "c", "left")
        off = F.col("total").isNotNull() & (F.coalesce("rows", none) != F.col("total"))
        n_bad = F.coalesce("bad", none) + F.col("wanted") - F.coalesce("seen", none) + off.cast("long")
        sides = F.concat(
            F.lit("missing "), F.coalesce("left", none), F.lit(", extra "), F.coalesce("right", none)
        )
        return both.select(
            "check",
            (n_bad == 0).alias("passed"),
            n_bad.alias("n_bad"),
            F.when(F.col("sides"), sides).otherwise("").alias("detail"),
        )


class GatedTable:
    """The checks of one table; every method declares one and returns the table."""

    def __init__(self, gates: Gates, number: int) -> None:
        self._gates, self._number = gates, number

    @property
    def _df(self) -> DataFrame:
        return self._gates._tables[self._number][0]

    def _entry(
        self, check: int, keys: list[str], values: list[str] = (), side: int = 0, measure: str | None = None, where: Column | None = None
    ) -> None:
        entry = F.struct(
            F.lit(check).alias("c"),
            _key(self._df, keys).alias("k"),
            _key(self._df, list(values)).alias("v"),
            F.lit(side).cast("tinyint").alias("side"),
            (F.col(f"`{measure}`") if measure else F.lit(None)).cast("double").alias("m"),
        ).cast(ENTRY)
        self._gates._tables[self._number][1].append(entry if where is None else F.when(where, entry))

    def unique(self, columns: list[str], check: str | None = None) -> GatedTable:
        """No key comes twice."""
        name = check or f"unique {','.join(columns)}"
        self._entry(self._gates._declare(_Check(name, (F.col("n") > 1).cast("long"))), columns)
        return self

    def constant(self, group: list[str], columns: list[str], check: str | None = None) -> GatedTable:
        """The columns have one value in each group."""
        name = check or f"constant {','.join(columns)} per {','.join(group)}"
        self._entry(self._gates._declare(_Check(name, (F.col("variants") > 1).cast("long"))), group, columns)
        return self

    def no_leakage(self, entity: str, partition: str) -> GatedTable:
        """No entity in two partitions."""
        return self.constant([entity], [partition], "no entity in two partitions")

    def rows(self, good: dict[str, Column]) -> GatedTable:
        """Conditions on single rows; null fails."""
        for name, condition in good.items():
            number = self._gates._declare(_Check(name, F.col("n")))
            self._entry(number, [], where=~F.coalesce(condition, F.lit(False)))
        return self

    def domain(self, column: str, allowed: list, check: str | None = None) -> GatedTable:
        """Only the allowed values; null is outside."""
        return self.rows({check or f"domain {column}": F.col(f"`{column}`").isin(*allowed)})

    def only_partitions(self, partition: str, allowed: list[str]) -> GatedTable:
        """Sealed and unlabelled rows are both bad."""
        return self.domain(partition, allowed, f"only partitions {','.join(allowed)}")

    def not_empty(self, check: str = "not empty") -> GatedTable:
        number = self._gates._declare(_Check(check, F.lit(0).cast("long"), F.lit(True), 1))
        self._entry(number, [])
        return self

    def expected_counts(
        self, group: str, expected: dict[str, int], total: int | None = None, check: str = "expected counts"
    ) -> GatedTable:
        """Exact rows per group and in total; a missing or unplanned group is bad."""
        value = F.col("k")
        planned = value.isin(*expected) if expected else F.lit(False)
        wanted = reduce(lambda a, kv: F.when(value == kv[0], kv[1]).otherwise(a), expected.items(), F.lit(-1))
        off = (~F.col("n").eqNullSafe(wanted.cast("long"))).cast("long")
        target = sum(expected.values()) if total is None else total
        number = self._gates._declare(_Check(check, off, F.coalesce(planned, F.lit(False)), len(expected), target))
        self._entry(number, [group])
        return self

    def two_routes(
        self, group: list[str], value: str, within: list[str], tolerance: float, check: str = "two routes agree"
    ) -> GatedTable:
        """The mean of a group over all its rows equals the weighted mean of the means of its parts,
        which the columns ``within`` name."""
        near = F.abs(F.col("weighted") / F.col("count") - F.col("sum") / F.col("count")) <= tolerance
        number = self._gates._declare(_Check(check, (~F.coalesce(near, F.col("count") == 0)).cast("long")))
        self._entry(number, group, within, measure=value)
        return self


class RowGates:
    """Row conditions that are counted by the pass that reads the rows anyway.

    ``df = gates.watch(df)`` before the action, ``gates.report(spark)`` after it: the counts are those
    of the first action on ``df``, and no row is read for them again."""

    def __init__(self, good: dict[str, Column], key: str | None = None) -> None:
        """``key``: the column whose least bad value goes into ``detail``."""
        self._names, self._good, self._key = list(good), good, key
        self._seen = Observation()

    def watch(self, df: DataFrame) -> DataFrame:
        found = [F.count(F.lit(1)).alias("rows")]
        for i, name in enumerate(self._names):
            bad = ~F.coalesce(self._good[name], F.lit(False))
            found.append(F.count_if(bad).alias(f"bad_{i}"))
            if self._key:
                found.append(F.min(F.when(bad, F.col(self._key))).cast("string").alias(f"key_{i}"))
        return df.observe(self._seen, *found)

    @property
    def n_rows(self) -> int:
        """Rows that the pass has read."""
        return self._seen.get["rows"]

    def report(self, spark: SparkSession) -> DataFrame:
        counts = self._seen.get
        rows = [
            (n, counts[f"bad_{i}"] == 0, counts[f"bad_{i}"], counts.get(f"key_{i}") or "")
            for i, n in enumerate(self._names)
        ]
        return local_rows(spark, rows, REPORT_SCHEMA)
