"""Which way a metric improves, and what a difference therefore means."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Improvement direction per metric family.
LOWER_FAMILIES = ("mae", "mse")
HIGHER_FAMILIES = ("psnr", "ssim")


def metric_direction(
    metric: Column,
    lower: tuple[str, ...] = LOWER_FAMILIES,
    higher: tuple[str, ...] = HIGHER_FAMILIES,
) -> Column:
    """``lower`` or ``higher`` from the family suffix; an unknown family fails the job."""
    family = F.substring_index(metric, "_", -1)
    return (
        F.when(family.isin(*lower), F.lit("lower"))
        .when(family.isin(*higher), F.lit("higher"))
        .otherwise(F.raise_error(F.concat(F.lit("no direction known for metric "), metric)))
    )


def raw_delta(baseline: Column, method: Column) -> Column:
    """``method - baseline`` in the metric's own sign."""
    return method - baseline


def oriented(direction: Column, delta: Column) -> Column:
    """The delta with positive always meaning the method did better."""
    return F.when(direction == "higher", delta).otherwise(-delta)


def is_improvement(direction: Column, delta: Column) -> Column:
    """Strictly better; neither an exact tie nor NaN, which Spark sorts last, is an improvement."""
    return (oriented(direction, delta) > 0) & ~F.isnan(delta)
