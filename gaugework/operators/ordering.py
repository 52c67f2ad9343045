"""Order-dependent operators that hold when one group has most of the rows.

A window partitioned by the group puts the whole group into one task. The operators here
use that plan only after a count shows that no group exceeds ``slice_rows``. Otherwise the
large groups are cut into slices at order values picked by hash from the data itself, each
task orders one slice, and a small table of slice totals carries ranks, running sums and
previous rows across the cuts. Slice limits are plain values inside the plan, so a task
that is run again after an executor loss gives the same rows the same slice.

The cuts, the slice totals and the rows are read separately. Pass ``materialize=True`` where
the input is derived (joined, aggregated): a sliced plan then computes it once, into a
checkpoint. That also settles order values that are floating-point aggregates, whose last
digits depend on the order of summation.

``order`` columns must be ascending and, together, unique within a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugework.functions.keys import SEQUENCE_PRIME, from_order_key, order_key, sequence_term
from gaugework.local import pinned
from gaugework.session import ensure_checkpoint_dir

#: Rows of one group a single task may order.
SLICE_ROWS = 1_000_000
#: Upper bound on slices, hence on the size of the broadcast slice limits.
MAX_SLICES = 65_536
#: Order values picked per slice. A slice ends at the last of them, so that slices are nearly equal.
PICKS = 32

def _null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def largest_group(df: DataFrame, group: list[str], slice_rows: int = SLICE_ROWS) -> int:
    """Rows in the largest group; the group-wise count runs only if the total is not enough."""
    total = df.count()
    if total <= slice_rows or not group:
        return total
    sizes = df.groupBy(*group).agg(F.count("*").alias("_n"))
    return sizes.agg(F.max("_n")).first()[0]


class Ordering:
    """The rows of every group in order. Build once, then rank, accumulate or look back."""

    def __init__(
        self,
        df: DataFrame,
        group: list[str],
        order: list[str],
        slice_rows: int = SLICE_ROWS,
        bound: int | None = None,
        materialize: bool = False,
    ) -> None:
        """``bound``: a number of rows no group can exceed, where the caller has one for free
        (the rows of a base table, say). A small bound saves counting ``df`` itself."""
        self._drop = [] if group else ["_all"]
        self.df = df if group else df.withColumn("_all", F.lit(0))
        self.group = list(group) or ["_all"]
        self.order = list(order)
        self.bounds = self._slice_bounds(slice_rows, bound, materialize)
        self._labelled = self._sliced()
        # Named explicitly: rows that arrive hashed on the group alone (after a join, say) would
        # satisfy the window and leave a large group in one task. Slice totals need no such
        # shuffle, they are combined where the rows lie.
        self.rows = self._labelled.repartition(*self.group, "_slice") if self.is_sliced else self._labelled

    @property
    def is_sliced(self) -> bool:
        return self.bounds is not None

    def _slice_bounds(
        self, slice_rows: int, bound: int | None, materialize: bool
    ) -> DataFrame | None:
        """Order values at which to cut each large group, or None when no group is large."""
        if bound is not None and bound <= slice_rows:
            return None
        total = self.df.count() if bound is None else None
        if total is not None and total <= slice_rows:
            return None
        if materialize:
            ensure_checkpoint_dir(self.df.sparkSession)
            self.df = self.df.checkpoint()
        df, single = self.df, self.group == ["_all"]
        if total is None:
            total = bound if single else df.count()
        limit = max(slice_rows, -(-total // (MAX_SLICES // 2)))
        # Slices of half the limit on average, as each has some rows more or less.
        step = max(limit // 2, 1)
        apart = max(step // PICKS, 1)
        names = [F.col(g).alias(f"_g{i}") for i, g in enumerate(self.group)]
        picked = df.where(F.pmod(F.xxhash64(*self.group, *self.order), F.lit(apart)) == 0)
        if not single:
            sizes = df.groupBy(*self.group).agg(F.count("*").alias("_n"))
            # At most total / limit groups can be that large, so at most MAX_SLICES / 2.
            large = pinned(sizes.where(F.col("_n") > limit))
            if large.isEmpty():
                return None
            named = large.select(*names)
            pairs = [(g, f"_g{i}") for i, g in enumerate(self.group)]
            picked = picked.join(F.broadcast(named), _null_safe(picked, named, pairs), "left_semi")
        every = step // apart
        ends = F.filter(
            F.array_sort(F.collect_set(F.struct(*self.order))), lambda _, i: F.pmod(i + 1, F.lit(every)) == 0
        )
        return pinned(picked.groupBy(*names).agg(ends.alias("_cuts")))

    def _sliced(self) -> DataFrame:
        if self.bounds is None:
            return self.df.withColumn("_slice", F.lit(0))
        pairs = [(g, f"_g{i}") for i, g in enumerate(self.group)]
        joined = self.df.join(
            F.broadcast(self.bounds), _null_safe(self.df, self.bounds, pairs), "left"
        ).drop(*[b for _, b in pairs])
        here = F.struct(*self.order)
        # Binary search for the number of cuts at or below this row.
        most = self.bounds.agg(F.max(F.size("_cuts"))).first()[0] or 1
        steps = [1 << k for k in range(most.bit_length() - 1, -1, -1)]
        position = F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda low, step: F.when(
                F.get(F.col("_cuts"), low + step - 1) <= here, low + step
            ).otherwise(low),
        )
        return joined.withColumn("_slice", position).drop("_cuts")

    def _window(self):
        return Window.partitionBy(*self.group, "_slice").orderBy(*self.order)

    def _attach(self, rows: DataFrame, carried: DataFrame, columns: list[str]) -> DataFrame:
        """Join per-slice values (only slices after the first, so at most MAX_SLICES rows)."""
        keys = [*self.group, "_slice"]
        later = carried.where(F.col("_slice") > 0).select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *columns
        )
        pairs = [(k, f"_k{i}") for i, k in enumerate(keys)]
        return rows.join(F.broadcast(later), _null_safe(rows, later, pairs), "left").drop(
            *[b for _, b in pairs]
        )

    def _finish(self, df: DataFrame) -> DataFrame:
        return df.drop("_slice", *self._drop)

    def _earlier(self, per_slice: DataFrame) -> DataFrame:
        w = Window.partitionBy(*self.group).orderBy("_slice")
        return per_slice.withColumn(
            "_carried_sum", F.sum("_here").over(w.rowsBetween(Window.unboundedPreceding, -1))
        )

    def rank(self, name: str = "rank") -> DataFrame:
        """0-based position of every row in its group."""
        rows = self.rows.withColumn(name, F.row_number().over(self._window()).cast("long") - 1)
        if not self.is_sliced:
            return self._finish(rows)
        per_slice = self._labelled.groupBy(*self.group, "_slice").agg(F.count("*").alias("_here"))
        rows = self._attach(rows, self._earlier(per_slice), ["_carried_sum"])
        return self._finish(
            rows.withColumn(name, F.col(name) + F.coalesce("_carried_sum", F.lit(0))).drop("_carried_sum")
        )

    def running_sum(self, value: str, name: str) -> DataFrame:
        """Inclusive running sum of ``value`` in order."""
        w = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = self.rows.withColumn(name, F.sum(value).over(w))
        if not self.is_sliced:
            return self._finish(rows)
        per_slice = self._labelled.groupBy(*self.group, "_slice").agg(F.sum(value).alias("_here"))
        rows = self._attach(rows, self._earlier(per_slice), ["_carried_sum"])
        return self._finish(
            rows.withColumn(name, F.col(name) + F.coalesce("_carried_sum", F.lit(0))).drop("_carried_sum")
        )

    def with_group_total(self, value: str, running: str, total: str) -> DataFrame:
        """:meth:`running_sum` as ``running``, beside the sum over the whole group as ``total``."""
        w = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*self.group, "_slice")
        rows = self.rows.select(
            "*", F.sum(value).over(w).alias(running), F.sum(value).over(whole).alias(total)
        )
        if not self.is_sliced:
            return self._finish(rows)
        per_slice = self._labelled.groupBy(*self.group, "_slice").agg(F.sum(value).alias("_here"))
        rows = self._attach(rows, self._earlier(per_slice), ["_carried_sum"])
        rows = rows.withColumn(running, F.col(running) + F.coalesce("_carried_sum", F.lit(0))).drop("_carried_sum")
        # Totals of the sliced groups only; every other group lies in one slice.
        named = self.bounds.select(*[f"_g{i}" for i in range(len(self.group))])
        pairs = [(g, f"_g{i}") for i, g in enumerate(self.group)]
        sums = (
            per_slice.join(F.broadcast(named), _null_safe(per_slice, named, pairs), "left_semi")
            .groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(self.group)])
            .agg(F.sum("_here").alias("_sum"))
        )
        rows = rows.join(F.broadcast(sums), _null_safe(rows, sums, pairs), "left")
        rows = rows.withColumn(total, F.coalesce("_sum", total)).drop("_sum", *[b for _, b in pairs])
        return self._finish(rows)

    def previous(self, columns: list[str], prefix: str = "prev_") -> DataFrame:
        """Values of the row before, null for the first row of a group."""
        w = self._window()
        rows = self.rows.select("*", *[F.lag(c).over(w).alias(prefix + c) for c in columns])
        if not self.is_sliced:
            return self._finish(rows)
        rows = rows.withColumn("_first", F.row_number().over(w) == 1)
        last = self._labelled.groupBy(*self.group, "_slice").agg(
            F.max_by(F.struct(*columns), F.struct(*self.order)).alias("_last")
        )
        across = Window.partitionBy(*self.group).orderBy("_slice")
        carried = last.withColumn("_carried_row", F.lag("_last").over(across))
        rows = self._attach(rows, carried, ["_carried_row"])
        for c in columns:
            rows = rows.withColumn(
                prefix + c, F.when(F.col("_first"), F.col("_carried_row")[c]).otherwise(F.col(prefix + c))
            )
        return self._finish(rows.drop("_first", "_carried_row"))

    def previous_max(self, value: str, name: str) -> DataFrame:
        """Largest ``value`` on any earlier row of the group, null for the first row."""
        w = self._window().rowsBetween(Window.unboundedPreceding, -1)
        rows = self.rows.withColumn(name, F.max(value).over(w))
        if not self.is_sliced:
            return self._finish(rows)
        top = self._labelled.groupBy(*self.group, "_slice").agg(F.max(value).alias("_top"))
        across = Window.partitionBy(*self.group).orderBy("_slice")
        carried = top.withColumn(
            "_carried_peak", F.max("_top").over(across.rowsBetween(Window.unboundedPreceding, -1))
        )
        rows = self._attach(rows, carried, ["_carried_peak"])
        return self._finish(rows.withColumn(name, F.greatest(name, "_carried_peak")).drop("_carried_peak"))


def rank(
    df: DataFrame,
    group: list[str],
    order: list[str],
    name: str = "rank",
    slice_rows: int = SLICE_ROWS,
    bound: int | None = None,
    materialize: bool = False,
) -> DataFrame:
    """0-based position within the group (or over the whole table for an empty group)."""
    return Ordering(df, group, order, slice_rows, bound, materialize).rank(name)


#: Bits of an order key that each of three histograms looks at; the first has sign and exponent.
RADIX_BITS = (22, 21, 21)


def quantiles(
    df: DataFrame,
    group: list[str],
    value: str,
    probs: list[float],
    name: str = "quantiles",
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group as an array column; nulls are left out.

    One plan for groups of every size, a radix selection: rows are counted by the leading bits of
    an order-preserving key, which is a partial aggregate; the counts of a group, 2^22 at most, say
    in which bucket each wanted rank lies; the rows of those buckets are counted by the next bits,
    and once more. After three counts a bucket is one value. No group is collected or sorted, and
    rows never move: what moves is counts.
    """
    if sum(RADIX_BITS) != 64:
        raise ValueError("the histograms have to cover 64 bits")
    keys = [f"_g{i}" for i in range(len(group))] or ["_g0"]
    named = [F.col(g).alias(k) for g, k in zip(group, keys, strict=False)] or [F.lit(0).alias("_g0")]
    rows = df.where(F.col(value).isNotNull()).select(*named, order_key(value).alias("_key"))
    shifts = [64 - sum(RADIX_BITS[: i + 1]) for i in range(3)]
    digits = [F.shiftright("_key", shifts[0])] + [
        F.shiftright("_key", s).bitwiseAND(F.lit((1 << b) - 1)) for s, b in zip(shifts[1:], RADIX_BITS[1:], strict=True)
    ]
    rows = rows.select(*keys, *[d.cast("int").alias(f"_d{i}") for i, d in enumerate(digits)])

    # Ranks that the quantiles are read from, once per group.
    def ranks(total: Column) -> Column:
        places = [F.lit(float(p)) * (total - 1) for p in probs]
        both = [f(place).cast("long") for place in places for f in (F.floor, F.ceil)]
        return F.array_distinct(F.array(*both)) if both else F.array().cast("array<long>")

    wanted = None
    for level in range(3):
        known = [*keys, *[f"_d{i}" for i in range(level)]]
        if wanted is not None:
            pairs = [(k, f"_w{k}") for k in known]
            there = wanted.select(*[F.col(k).alias(w) for k, w in pairs])
            rows = rows.join(there, _null_safe(rows, there, pairs), "left_semi")
        counts = rows.groupBy(*known, f"_d{level}").agg(F.count("*").alias("_n"))
        w = Window.partitionBy(*known).orderBy(f"_d{level}")
        upto = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counts = counts.select(*known, f"_d{level}", "_n", upto.alias("_upto"))
        if wanted is None:
            total = F.sum("_n").over(Window.partitionBy(*keys))
            counts = counts.withColumn("_total", total).withColumn(
                "_ranks", F.transform(ranks(F.col("_total")), lambda r: F.struct(r.alias("rank"), r.alias("left")))
            )
        else:
            pairs = [(k, f"_w{k}") for k in known]
            there = wanted.select(*[F.col(k).alias(x) for k, x in pairs], "_total", "_ranks")
            counts = counts.join(there, _null_safe(counts, there, pairs)).drop(*[x for _, x in pairs])
        before = F.col("_upto") - F.col("_n")
        here = F.filter("_ranks", lambda r: (r["left"] >= before) & (r["left"] < F.col("_upto")))
        here = F.transform(here, lambda r: F.struct(r["rank"].alias("rank"), (r["left"] - before).alias("left")))
        wanted = counts.select(*known, f"_d{level}", "_total", here.alias("_ranks")).where(F.size("_ranks") > 0)
    key = F.lit(0).cast("long")
    for level, shift in enumerate(shifts):
        key = key + F.shiftleft(F.col(f"_d{level}").cast("long"), shift)
    found = wanted.select(*keys, "_total", F.explode("_ranks.rank").alias("_rank"), from_order_key(key).alias("_value"))
    read = found.groupBy(*keys, "_total").agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at")
    )
    parts = []
    for p in probs:
        place = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = (F.element_at("_at", f(place).cast("long")) for f in (F.floor, F.ceil))
        parts.append(F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place))))
    back = [F.col(k).alias(g) for g, k in zip(group, keys, strict=False)]
    return read.select(*back, F.array(*parts).cast("array<double>").alias(name))


def aggregate_with_quantiles(
    df: DataFrame,
    group: list[str],
    aggregates: list[Column],
    value: str,
    probs: list[float],
    name: str = "quantiles",
    slice_rows: int = SLICE_ROWS,
    bound: int | None = None,
) -> DataFrame:
    """Aggregates and exact quantiles of ``value`` per group: one pass while groups are small."""
    if bound is None or bound > slice_rows:
        bound = largest_group(df, group, slice_rows)
    if bound <= slice_rows:
        return df.groupBy(*group).agg(*aggregates, F.percentile(value, probs).alias(name))
    keyed = df if group else df.withColumn("_all", F.lit(0))
    keys = list(group) or ["_all"]
    points = quantiles(keyed, keys, value, probs, name)
    facts = keyed.groupBy(*keys).agg(*aggregates)
    cond = _null_safe(facts, points, [(k, k) for k in keys])
    joined = facts.join(points, cond, "left").drop(*[points[k] for k in keys])
    return joined if group else joined.drop("_all")


def sequence_check(df: DataFrame, position: str, key: str) -> DataFrame:
    """One row (``rows``, ``check``) that tells sequences apart without ordering them: the sum of
    :func:`gaugework.functions.keys.sequence_term` over 0-based positions, a partial aggregate. Equal
    sequences have equal checks; a swapped, dropped or changed key changes it but for one case in two
    thousand million. An empty table has 0 rows and the check 0."""
    hashed = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 12), 16, 10).cast("long")
    term = sequence_term(position, hashed)
    total = F.pmod(F.sum(term.cast("decimal(10,0)")), F.lit(SEQUENCE_PRIME))
    return df.agg(F.count("*").alias("rows"), F.coalesce(total.cast("long"), F.lit(0).cast("long")).alias("check"))


def sequences_differ(left: DataFrame, right: DataFrame, position: str, key: str) -> DataFrame:
    """One row comparing two sequences in one plan, nothing ordered and nothing joined: rows of each
    side, how many positions hold different keys or are missing on a side, and the first of them."""
    sides = left.select(F.col(position).alias("_p"), F.col(key).cast("string").alias("_k"), F.lit(1).alias("_s"))
    sides = sides.unionAll(right.select(F.col(position), F.col(key).cast("string"), F.lit(2)))
    # A pair that both sides have cancels; what is left stands on one side only.
    odd = sides.groupBy("_p", "_k").agg(
        F.count_if(F.col("_s") == 1).alias("_l"), F.count_if(F.col("_s") == 2).alias("_r")
    )
    places = odd.groupBy("_p").agg(
        F.sum("_l").alias("_l"), F.sum("_r").alias("_r"), F.bool_or(F.col("_l") != F.col("_r")).alias("_off")
    )
    none = F.lit(0).cast("long")
    return places.agg(
        F.coalesce(F.sum("_l"), none).alias("left_rows"),
        F.coalesce(F.sum("_r"), none).alias("right_rows"),
        F.count_if("_off").alias("different_positions"),
        F.min(F.when(F.col("_off"), F.col("_p"))).alias("first_difference"),
    )


def sequence_digest(
    df: DataFrame,
    order: list[str],
    key: str,
    block: int = 4096,
    slice_rows: int = SLICE_ROWS,
    rows: int | None = None,
    dense: bool = False,
) -> DataFrame:
    """One row with ``rows`` (counted unless given) and the ``digest`` of the keys in order.

    The digest is a tree, for every length: blocks of ``block`` keys are hashed by SHA-256, each key
    followed by the separator, and the block digests are hashed the same way, level by level, until
    one is left. One block is a tree of one leaf, the empty sequence is a leaf without keys. No task
    sees more than one block at a time. ``dense`` states that the single ``order`` column already
    holds the positions 0, 1, 2, …
    """
    rows = df.count() if rows is None else rows
    columns = df.select(*dict.fromkeys([*order, key]))
    if dense:
        ranked = columns.withColumn("_pos", F.col(order[0]))
    else:
        ranked = rank(columns, [], order, "_pos", slice_rows, rows)
    level = ranked.select(F.col("_pos"), F.col(key).cast("string").alias("_text"))

    def fold(frame: DataFrame) -> DataFrame:
        return (
            frame.groupBy(F.floor(F.col("_pos") / F.lit(block)).alias("_pos"))
            .agg(F.array_sort(F.collect_list(F.struct("_pos", "_text"))).alias("_items"))
            .select(
                "_pos",
                F.sha2(
                    F.array_join(
                        F.transform("_items", lambda s: F.concat(s["_text"], F.lit("\x1f"))), ""
                    ),
                    256,
                ).alias("_text"),
            )
        )

    level, left = fold(level), -(-rows // block)
    while left > 1:
        level, left = fold(level), -(-left // block)
    # One row is left, or none.
    digest = F.coalesce(F.max("_text"), F.sha2(F.lit(""), 256))
    return level.agg(digest.alias("digest")).select(F.lit(rows).cast("long").alias("rows"), "digest")


def canonical_order(df: DataFrame, entity: str, position: str, name: str = "position", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Dense position in the canonical order: natural entity order, then ``position``."""
    from gaugework.functions.keys import natural_key

    keyed = df.withColumn("_natural", natural_key(entity))
    return rank(keyed, [], ["_natural", entity, position], name, slice_rows).drop("_natural")
