"""Array-form unit metrics and checks, as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gaugework.functions.values import RANGE_TOLERANCE, psnr


def differences(ref: Column, pred: Column, mask: Column | None = None) -> Column:
    """``pred - ref`` per cell; with a mask, only the cells it selects."""
    delta = F.zip_with(ref, pred, lambda a, b: b.cast("double") - a.cast("double"))
    if mask is None:
        return delta
    kept = F.zip_with(delta, mask, lambda d, m: F.when(m, d))
    return F.filter(kept, lambda d: d.isNotNull())


def array_error(
    ref: Column,
    pred: Column,
    mask: Column | None = None,
    data_range: float = 1.0,
    low: float = 0.0,
    high: float | None = None,
) -> Column:
    """``struct(n, mae, mse, psnr)`` over all or the masked cells; nulls if the mask selects none.

    One walk over the arrays adds up the errors and counts cells that may not be scored: null, not
    finite, outside ``low`` to ``high`` (the data range), on one side only, or under no mask value.
    Such cells, null arrays and empty ones fail the job with the reason that :func:`pair_fault` or
    :func:`mask_fault` names.
    """
    top = low + data_range if high is None else high

    def fit(v: Column) -> Column:
        x = v.cast("double")
        # Not a number is larger than every limit.
        return (x >= F.lit(low - RANGE_TOLERANCE)) & (x <= F.lit(top + RANGE_TOLERANCE))

    cells = F.zip_with(ref, pred, lambda a, b: F.when(fit(a) & fit(b), b.cast("double") - a.cast("double")))
    if mask is None:
        cells = F.transform(cells, lambda d: F.struct(d.alias("d"), F.lit(True).alias("m")))
    else:
        cells = F.zip_with(cells, mask, lambda d, m: F.struct(d.alias("d"), m.alias("m")))
    zero = F.struct(
        F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("a"), F.lit(0.0).alias("s"), F.lit(False).alias("bad")
    )

    def step(acc: Column, c: Column) -> Column:
        counts = F.coalesce(c["m"], F.lit(False)) & c["d"].isNotNull()
        d = F.when(counts, c["d"]).otherwise(0.0)
        return F.struct(
            (acc["n"] + counts.cast("long")).alias("n"),
            (acc["a"] + F.abs(d)).alias("a"),
            (acc["s"] + d * d).alias("s"),
            (acc["bad"] | c["d"].isNull() | c["m"].isNull()).alias("bad"),
        )

    reason = pair_fault(ref, pred, low, top)
    if mask is not None:
        reason = F.coalesce(reason, mask_fault(mask, ref))
    message = F.concat(F.lit("arrays may not be scored: "), F.coalesce(reason, F.lit("unknown")))
    kind = "struct<n: bigint, mae: double, mse: double, psnr: double>"

    def read(t: Column) -> Column:
        mse = F.when(t["n"] > 0, t["s"] / t["n"])
        error = F.struct(
            t["n"].alias("n"),
            F.when(t["n"] > 0, t["a"] / t["n"]).alias("mae"),
            mse.alias("mse"),
            psnr(mse, data_range).alias("psnr"),
        )
        unfit = t.isNull() | t["bad"] | (F.size(ref) <= 0) | (F.size(pred) <= 0)
        return F.when(unfit, F.raise_error(message).cast(kind)).otherwise(error)

    return F.transform(F.array(F.aggregate(cells, zero, step)), read)[0]


def array_fault(
    c: Column, low: float = 0.0, high: float = 1.0, slack: float = RANGE_TOLERANCE
) -> Column:
    """First reason an array is unusable: ``empty``, ``not finite``, ``out of range``; else null."""
    bad = F.exists(
        c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == F.lit(float("inf")))
    )
    return (
        F.when(c.isNull() | (F.size(c) <= 0), F.lit("empty"))
        .when(bad, F.lit("not finite"))
        .when(
            (F.array_min(c) < F.lit(low - slack)) | (F.array_max(c) > F.lit(high + slack)),
            F.lit("out of range"),
        )
    )


def pair_fault(ref: Column, pred: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """First reason two arrays may not be compared, or null."""
    return F.coalesce(
        F.concat(F.lit("reference "), array_fault(ref, low, high)),
        F.concat(F.lit("prediction "), array_fault(pred, low, high)),
        F.when(F.size(ref) != F.size(pred), F.lit("shapes differ")),
    )


def mask_fault(mask: Column, ref: Column) -> Column:
    """First reason a mask may not select cells of ``ref``, or null."""
    return (
        F.when(mask.isNull() | (F.size(mask) != F.size(ref)), F.lit("mask shape differs"))
        .when(F.exists(mask, lambda m: m.isNull()), F.lit("mask not boolean"))
        .when(~F.exists(mask, lambda m: m), F.lit("mask selects nothing"))
    )


def outlier_cells(c: Column, ceiling: float, width: int, cap: int | None = None) -> Column:
    """Cells above a ceiling in row-major order, as ``array<struct<y,x,value>>``."""
    cells = F.filter(
        F.transform(
            c,
            lambda v, i: F.struct(
                F.floor(i / F.lit(width)).cast("int").alias("y"),
                F.pmod(i, F.lit(width)).cast("int").alias("x"),
                v.cast("double").alias("value"),
            ),
        ),
        lambda s: s["value"] > F.lit(ceiling),
    )
    return cells if cap is None else F.slice(cells, 1, cap)
