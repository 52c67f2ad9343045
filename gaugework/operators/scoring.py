"""Side-by-side scoring: prepare each unit once, give every method the identical input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gaugework.functions.arrays import array_error, pair_fault
from gaugework.functions.keys import typed_array_digest
from gaugework.functions.values import affine_rescale, window_normalize
from gaugework.operators import grids
from gaugework.operators.constraints import open_partition, projection
from gaugework.operators.ordering import SLICE_ROWS, aggregate_with_quantiles


def prepare_unit(
    df: DataFrame,
    stored: str,
    height: str,
    width: str,
    slope: Column | float,
    intercept: Column | float,
    threshold: float,
    center: float,
    window_width: float,
    factor: int,
) -> DataFrame:
    """Calibrate, take the mask from the calibrated values, window, then resample and clip.

    The order is part of the meaning: the mask must not depend on the display window. Adds
    ``clean``, ``body``, ``grid_height`` and ``grid_width``.
    """
    h, w = F.col(height), F.col(width)
    calibrated = df.withColumn("_cal", F.transform(stored, lambda v: affine_rescale(v, slope, intercept)))
    masked = calibrated.withColumn("_mask", grids.largest_region(F.col("_cal"), h, w, threshold))
    shown = masked.withColumn(
        "_win", F.transform("_cal", lambda v: window_normalize(v, center, window_width))
    )
    small = shown.withColumn("_small", grids.area_average(F.col("_win"), h, w, factor)).withColumn(
        "body", _shrink_mask(F.col("_mask"), h, w, factor)
    )
    clean = F.transform("_small", lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))
    return (
        small.withColumn("clean", clean)
        .withColumn("grid_height", F.floor(h / F.lit(factor)).cast("int"))
        .withColumn("grid_width", F.floor(w / F.lit(factor)).cast("int"))
        .drop("_cal", "_mask", "_win", "_small")
    )


def _shrink_mask(mask: Column, h: Column, w: Column, factor: int) -> Column:
    """Nearest sampling of a mask by an integer factor, as an index pick."""
    cells = F.sequence(F.lit(0), F.floor(h / factor) * F.floor(w / factor) - 1)
    out_w = F.floor(w / F.lit(factor))
    return F.transform(
        cells,
        lambda i: F.get(mask, (F.floor(i / out_w) * factor * w + F.pmod(i, out_w) * factor).cast("int")),
    )


#: The fields of a training pair, and names that must never be among them.
PAIR_FIELDS = (
    "degraded",
    "clean",
    "subject_id",
    "sample_key",
    "source_archive",
    "acquisition_group",
    "geometric_slice_index",
)
FORBIDDEN_PAIR_FIELDS = (
    "body_mask",
    "evaluation_mask",
    "ssim_interior_mask",
    "interior_mask",
    "clean_hu",
    "image_hu",
    "segmentation",
    "mask",
    "split",
    "dicom_path",
    "absolute_path",
    "series_instance_uid",
    "study_instance_uid",
    "sop_instance_uid",
)


def training_pairs(
    units: DataFrame, partition: str, wanted: str, allowed: list[str], fields: tuple[str, ...] = PAIR_FIELDS
) -> DataFrame:
    """The supervised pairs of one open partition: exactly the pair fields, never resampled.

    Both arrays must be finite and in range; a bad pair fails the job.
    """
    rows = open_partition(units, partition, wanted, allowed)
    pairs = projection(rows, list(fields), list(FORBIDDEN_PAIR_FIELDS))
    fault = pair_fault(F.col("clean"), F.col("degraded"))
    message = F.concat(F.lit("unusable pair "), F.col("sample_key"), F.lit(": "), fault)
    return pairs.where(F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(message)))


def score_methods(
    units: DataFrame,
    keep: list[str],
    given: str,
    reference: str,
    methods: dict[str, Callable[[Column], Column]],
    mask: str | None = None,
) -> DataFrame:
    """One metric row per (unit, method) for methods that are array expressions.

    Every method is a function of the input column alone, so it cannot see the reference.
    All methods sit in one array of the same row: the unit is read and prepared once, and
    ``input_digest`` shows that all of them had the same input.
    """
    restored = F.array(
        *[
            F.struct(F.lit(name).alias("method"), fn(F.col(given)).alias("restored"))
            for name, fn in methods.items()
        ]
    )
    kept = [*keep, reference, *([mask] if mask else [])]
    rows = units.select(
        *kept,
        typed_array_digest(units, given).alias("input_digest"),
        F.explode(restored).alias("_scored"),
    )
    error = array_error(F.col(reference), F.col("_scored.restored"), F.col(mask) if mask else None)
    return rows.select(
        *keep, "input_digest", F.col("_scored.method").alias("method"), error.alias("_error")
    ).select(*keep, "method", "input_digest", "_error.n", "_error.mae", "_error.mse", "_error.psnr")


def score_functions(
    units: DataFrame,
    keep: list[str],
    given: str,
    reference: str,
    body: str,
    height: str,
    width: str,
    functions: dict[str, Callable[[np.ndarray], np.ndarray]],
    window: int = grids.WINDOW,
    sigma: float = grids.SIGMA,
) -> DataFrame:
    """One row of eight metrics per (unit, method) for user functions ``array -> array``.

    A function gets a read-only copy of the two-dimensional input and nothing else. It must
    return the same shape.
    """
    schema = T.StructType(
        [
            *units.select(*keep, reference, body, height, width).schema.fields,
            T.StructField("method", T.StringType()),
            T.StructField("input_digest", T.StringType()),
            T.StructField("restored", T.ArrayType(T.DoubleType())),
        ]
    )
    passed = [*keep, reference, body, height, width]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            inputs = [
                np.asarray(v, dtype=float).reshape(h, w)
                for v, h, w in zip(batch[given], batch[height], batch[width])
            ]
            for name, fn in functions.items():
                restored = []
                for grid in inputs:
                    shown = grid.copy()
                    shown.flags.writeable = False
                    result = np.asarray(fn(shown), dtype=float)
                    if result.shape != grid.shape:
                        raise ValueError(f"{name} changed the shape {grid.shape} to {result.shape}")
                    restored.append(result.ravel().tolist())
                yield batch[passed].assign(
                    method=name, input_digest=batch["input_digest"], restored=restored
                )[schema.names]

    digested = units.select(
        *passed, given, typed_array_digest(units, given).alias("input_digest")
    ) if given not in passed else units.select(
        *passed, typed_array_digest(units, given).alias("input_digest")
    )
    rows = digested.mapInPandas(apply, schema)
    metrics = grids.unit_metrics(
        F.col(reference), F.col("restored"), F.col(body), F.col(height), F.col(width), window, sigma
    )
    return rows.select(*keep, "method", "input_digest", metrics.alias("_metrics")).select(
        *keep, "method", "input_digest", "_metrics.*"
    )


def change_diagnostics(
    units: DataFrame, given: str, raw: str, low: float = 0.0, high: float = 1.0
) -> DataFrame:
    """Per unit: what a method asked for, and what survived clipping; never merged.

    ``cells, below, above, clamped, sum_raw, sum_kept, raw_min, raw_max`` as a struct-free row, with
    the cells that end exactly at a limit (``at_low, at_high``) and those that are not finite
    (``not_finite``; NaN is neither below nor above, an infinity is also beyond its limit).
    """
    clip = lambda v: F.least(F.greatest(v, F.lit(low)), F.lit(high))
    zero = F.struct(
        F.lit(0).cast("long").alias("below"),
        F.lit(0).cast("long").alias("above"),
        F.lit(0).cast("long").alias("at_low"),
        F.lit(0).cast("long").alias("at_high"),
        F.lit(0).cast("long").alias("not_finite"),
        F.lit(0.0).alias("raw"),
        F.lit(0.0).alias("kept"),
    )
    pairs = F.zip_with(
        given, raw, lambda g, r: F.struct(g.cast("double").alias("g"), r.cast("double").alias("r"))
    )
    totals = F.aggregate(
        pairs,
        zero,
        lambda a, p: F.struct(
            (a["below"] + (p["r"] < low).cast("long")).alias("below"),
            (a["above"] + (~F.isnan(p["r"]) & (p["r"] > high)).cast("long")).alias("above"),
            (a["at_low"] + (p["r"] <= low).cast("long")).alias("at_low"),
            (a["at_high"] + (~F.isnan(p["r"]) & (p["r"] >= high)).cast("long")).alias("at_high"),
            (a["not_finite"] + (F.isnan(p["r"]) | (F.abs(p["r"]) == float("inf"))).cast("long")).alias("not_finite"),
            (a["raw"] + F.abs(p["r"] - p["g"])).alias("raw"),
            (a["kept"] + F.abs(clip(p["r"]) - p["g"])).alias("kept"),
        ),
    )
    return units.select(
        "*",
        F.size(raw).cast("long").alias("cells"),
        F.array_min(raw).alias("raw_min"),
        F.array_max(raw).alias("raw_max"),
        totals.alias("_t"),
    ).select(
        *units.columns, "cells", "raw_min", "raw_max",
        F.col("_t.below").alias("below"),
        F.col("_t.above").alias("above"),
        (F.col("_t.below") + F.col("_t.above")).alias("clamped"),
        *[F.col(f"_t.{c}").alias(c) for c in ("at_low", "at_high", "not_finite")],
        F.col("_t.raw").alias("sum_raw"),
        F.col("_t.kept").alias("sum_kept"),
    )


def change_summary(
    diagnostics: DataFrame,
    by: list[str] = (),
    probs: tuple[float, ...] = (0.05, 0.5, 0.95),
    slice_rows: int = SLICE_ROWS,
    bound: int | None = None,
) -> DataFrame:
    """Pooled fractions and mean changes, with quantiles of the per-unit raw change; ``failures``
    counts the units with a cell that is not finite."""
    cells = F.sum("cells")
    aggregates = [
        F.count("*").alias("units"),
        cells.alias("cells"),
        (F.sum("below") / cells).alias("fraction_below"),
        (F.sum("above") / cells).alias("fraction_above"),
        (F.sum("clamped") / cells).alias("fraction_clamped"),
        (F.sum("at_low") / cells).alias("fraction_at_low"),
        (F.sum("at_high") / cells).alias("fraction_at_high"),
        F.count_if(F.col("not_finite") > 0).alias("failures"),
        (F.sum("sum_raw") / cells).alias("mean_raw_change"),
        (F.sum("sum_kept") / cells).alias("mean_kept_change"),
        F.min("raw_min").alias("raw_min"),
        F.max("raw_max").alias("raw_max"),
    ]
    per_unit = diagnostics.withColumn("_change", F.col("sum_raw") / F.col("cells"))
    out = aggregate_with_quantiles(
        per_unit, list(by), aggregates, "_change", list(probs), "_q", slice_rows, bound
    )
    names = [f"unit_change_q{int(p * 100):02d}" for p in probs]
    return out.select("*", *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)]).drop("_q")
