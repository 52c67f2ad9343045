"""Scalar value operators: calibration, normalisation, quantisation, keyed noise, metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from gaugework.functions.keys import digest_uniform, keyed_digest

# Slack around the allowed range, eight-bit maximum, publication places.
RANGE_TOLERANCE = 1e-6
EIGHT_BIT_MAX = 255.0
PUBLISHED_PLACES = 10


def affine_rescale(x: Column, slope: Column | float, intercept: Column | float) -> Column:
    """``x * slope + intercept`` after promotion to double."""
    slope = slope if isinstance(slope, Column) else F.lit(float(slope))
    intercept = intercept if isinstance(intercept, Column) else F.lit(float(intercept))
    return x.cast("double") * slope + intercept


def calibration(
    lut_type: Column,
    slope: Column,
    intercept: Column,
    modality: Column | None = None,
    wanted_unit: str = "HU",
    wanted_modality: str = "CT",
    has_lut: Column | None = None,
) -> Column:
    """How a unit is to be calibrated, as ``struct(method, error)``.

    A lookup table decides first and must be in the wanted unit; otherwise slope and
    intercept are both needed. Exactly one of ``method`` and ``error`` is set, so a bad
    unit goes to quarantine instead of getting a default.
    """
    lut = lut_type.isNotNull() if has_lut is None else F.coalesce(has_lut, F.lit(False))
    missing = F.array_join(
        F.filter(
            F.array(
                F.when(slope.isNull(), F.lit("slope")),
                F.when(intercept.isNull(), F.lit("intercept")),
            ),
            lambda v: v.isNotNull(),
        ),
        " and ",
    )
    wrong_modality = (
        F.lit(False) if modality is None else ~F.coalesce(modality == wanted_modality, F.lit(False))
    )
    error = (
        F.when(wrong_modality, F.lit("wrong modality"))
        .when(
            lut & ~F.coalesce(lut_type == wanted_unit, F.lit(False)),
            F.concat(F.lit("lookup table unit "), F.coalesce(lut_type, F.lit("absent"))),
        )
        .when(~lut & (missing != ""), F.concat(F.lit("missing "), missing))
    )
    method = F.when(error.isNull(), F.when(lut, F.lit("lookup")).otherwise(F.lit("affine")))
    return F.struct(method.alias("method"), error.alias("error"))


def window_normalize(x: Column, center: float, width: float) -> Column:
    """Clip to ``center ± width/2`` and map linearly onto [0, 1]."""
    if not width > 0:
        raise ValueError(f"window width must be positive, got {width}")
    low, high = center - width / 2.0, center + width / 2.0
    clipped = F.least(F.greatest(x.cast("double"), F.lit(low)), F.lit(high))
    return (clipped - F.lit(low)) / F.lit(high - low)


def is_finite(x: Column) -> Column:
    """True for a present value that is neither NaN nor infinite."""
    number = x.cast("double")
    return F.coalesce(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), F.lit(False))


def in_range(x: Column, low: float = 0.0, high: float = 1.0, slack: float = RANGE_TOLERANCE) -> Column:
    """Finite and within the range, allowing only numerical slack; nothing is repaired."""
    return is_finite(x) & x.between(F.lit(low - slack), F.lit(high + slack))


def quantize8(x: Column) -> Column:
    """Half-to-even rounding of a [0, 1] value to 0..255."""
    clipped = F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0))
    return F.rint(clipped * F.lit(EIGHT_BIT_MAX)).cast("int")


def dequantize8(q: Column) -> Column:
    return q.cast("double") / F.lit(EIGHT_BIT_MAX)


def signal_scale(x: Column, floor: float, signal: float) -> Column:
    """Signal-dependent spread ``floor + signal * sqrt(max(x, 0))``."""
    return F.lit(floor) + F.lit(signal) * F.sqrt(F.greatest(x.cast("double"), F.lit(0.0)))


def keyed_normal(*fields: Column | str | int) -> Column:
    """A standard normal value that is a pure function of the fields (Box-Muller)."""
    digest = keyed_digest(*fields)
    radius = F.sqrt(F.lit(-2.0) * F.ln(digest_uniform(digest, 0)))
    return radius * F.cos(F.lit(2.0 * math.pi) * digest_uniform(digest, 1))


def keyed_noise(
    x: Column,
    *fields: Column | str | int,
    floor: float,
    signal: float,
    low: float = 0.0,
    high: float = 1.0,
) -> Column:
    """``x`` plus signal-scaled keyed noise, clipped: same key, same noise, whatever the order."""
    noisy = x.cast("double") + signal_scale(x, floor, signal) * keyed_normal(*fields)
    return F.least(F.greatest(noisy, F.lit(low)), F.lit(high))


def sentinel_flag(x: Column, sentinel: Column, limit: Column) -> Column:
    """Equal to the sentinel, or inside its range; null when no sentinel is declared."""
    bound = F.coalesce(limit, sentinel)
    return F.when(
        sentinel.isNotNull(), x.between(F.least(sentinel, bound), F.greatest(sentinel, bound))
    )


def is_strict_integer(x: Column) -> Column:
    """An integral finite number; NaN, infinities, fractions and null are refused."""
    return is_finite(x) & (x == F.floor(x))


def strict_integer(x: Column) -> Column:
    """The value as long, failing the job when it is not a strict integer."""
    return F.when(is_strict_integer(x), x.cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("not an integer: "), F.coalesce(x.cast("string"), F.lit("null"))))
    )


def fraction(condition: Column) -> Column:
    """Aggregate: share of rows meeting the condition (null counts as not met)."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def psnr(mse: Column, data_range: float = 1.0) -> Column:
    """``10 log10(range² / mse)`` in decibels; infinity for identical inputs."""
    safe = F.when(mse == 0, F.lit(None).cast("double")).otherwise(mse)
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(
        F.lit(10.0) * F.log10(F.lit(data_range * data_range) / safe)
    )


def published(c: Column, places: int = PUBLISHED_PLACES) -> Column:
    """Round for publication."""
    return F.round(c, places)
