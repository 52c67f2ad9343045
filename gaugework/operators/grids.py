"""Neighbourhood operators on grids.

A grid is one row: row-major ``array<double>`` plus ``height`` and ``width``. A grid is
bounded by its own size, so neighbourhood work is a narrow, shuffle-free Arrow stage:
the batch's grids of equal shape are stacked and treated by whole-array numpy
operations, never cell by cell. Table-shaped grid work (equalisation) stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gaugework.functions.values import RANGE_TOLERANCE
from gaugework.operators.joins import lookup_join
from gaugework.operators.ordering import SLICE_ROWS

# The standard similarity constants and the default window.
K1, K2 = 0.01, 0.03
WINDOW, SIGMA = 11, 1.5

METRIC_TYPE = T.StructType(
    [
        T.StructField(name, T.DoubleType())
        for name in (
            "full_mae", "full_mse", "full_psnr", "full_ssim",
            "body_mae", "body_mse", "body_psnr", "body_ssim",
        )
    ]
)


def _stacks(heights: pd.Series, widths: pd.Series) -> Iterator[tuple[np.ndarray, int, int]]:
    """Row numbers of the batch by grid shape."""
    shapes = pd.DataFrame({"h": heights.to_numpy(), "w": widths.to_numpy()})
    for (h, w), rows in shapes.groupby(["h", "w"], sort=False).indices.items():
        yield rows, int(h), int(w)


def _stack(values: pd.Series, rows: np.ndarray, h: int, w: int, kind: type) -> np.ndarray:
    picked = values.iloc[rows]
    sizes = {len(v) for v in picked}
    if sizes != {h * w}:
        raise ValueError(f"a {h}x{w} grid cannot hold {sorted(sizes - {h * w})} cells")
    return np.stack([np.asarray(v, dtype=kind) for v in picked]).reshape(len(rows), h, w)


def gaussian_taps(window: int, sigma: float) -> np.ndarray:
    """Normalised weights of an odd window."""
    if window < 3 or window % 2 == 0:
        raise ValueError(f"window must be odd and at least 3, got {window}")
    x = np.arange(window) - window // 2
    weights = np.exp(-0.5 * (x / sigma) ** 2)
    return weights / weights.sum()


def _smooth(a: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Separable weighted window over the last two axes, interior only."""
    k = len(taps)
    rows = sum(t * a[:, i : a.shape[1] - k + 1 + i, :] for i, t in enumerate(taps))
    return sum(t * rows[:, :, i : rows.shape[2] - k + 1 + i] for i, t in enumerate(taps))


def _similarity(x: np.ndarray, y: np.ndarray, taps: np.ndarray, data_range: float) -> np.ndarray:
    """Local similarity on the interior, from windowed population moments."""
    mx, my = _smooth(x, taps), _smooth(y, taps)
    vx = _smooth(x * x, taps) - mx * mx
    vy = _smooth(y * y, taps) - my * my
    vxy = _smooth(x * y, taps) - mx * my
    c1, c2 = (K1 * data_range) ** 2, (K2 * data_range) ** 2
    return ((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx**2 + my**2 + c1) * (vx + vy + c2))


def _erode(mask: np.ndarray, k: int) -> np.ndarray:
    """True where the whole k x k neighbourhood is true; outside counts as false."""
    r = k // 2
    padded = np.pad(mask, ((0, 0), (r, r), (r, r)))
    h, w = mask.shape[1:]
    rows = np.logical_and.reduce([padded[:, i : i + h, :] for i in range(k)])
    return np.logical_and.reduce([rows[:, :, i : i + w] for i in range(k)])


def _components(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Smallest cell index of the component of every cell; an out-of-range index outside."""
    n, h, w = mask.shape
    none = n * h * w
    label = np.where(mask, np.arange(none).reshape(n, h, w), none)
    shifts = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    parent = np.append(label.ravel(), none)
    while True:
        grid = parent[:-1].reshape(n, h, w)
        best = grid.copy()
        for dy, dx in shifts:
            a = (slice(None), slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
            b = (slice(None), slice(dy, h), slice(max(0, dx), w - max(0, -dx)))
            both = mask[a] & mask[b]
            low = np.where(both, np.minimum(best[a], best[b]), none)
            best[a] = np.where(both, np.minimum(best[a], low), best[a])
            best[b] = np.where(both, np.minimum(best[b], low), best[b])
        # Give the smaller label to the old representative too, then follow labels to the end.
        flat = np.append(best.ravel(), none)
        np.minimum.at(flat, parent, flat.copy())
        flat[none] = none
        while True:
            shorter = flat[flat]
            if np.array_equal(shorter, flat):
                break
            flat = shorter
        if np.array_equal(flat, parent):
            return flat[:-1].reshape(n, h, w)
        parent = flat


def _fill(mask: np.ndarray) -> np.ndarray:
    """Add background that no 4-connected path links to the outside."""
    ground = np.pad(~mask, ((0, 0), (1, 1), (1, 1)), constant_values=True)
    label = _components(ground, diagonal=False)
    outside = label == label[:, :1, :1]
    return mask | ~outside[:, 1:-1, 1:-1]


def _largest(mask: np.ndarray, fill_holes: bool) -> np.ndarray:
    n, h, w = mask.shape
    label = _components(mask, diagonal=True).reshape(n, h * w)
    sizes = np.bincount(label.ravel(), minlength=n * h * w + 1)
    sizes[n * h * w] = 0
    # argmax takes the first cell of the largest size: the lowest label on ties.
    winner = np.take_along_axis(label, sizes[label].argmax(axis=1)[:, None], axis=1)
    region = ((label == winner) & mask.reshape(n, h * w)).reshape(n, h, w)
    return _fill(region) if fill_holes else region


def _lists(result: list) -> pd.Series:
    return pd.Series(result, dtype=object)


def _grid_udf(kernel: Callable[[np.ndarray], np.ndarray], kind: type, returns: str):
    """A one-grid kernel over stacked batches as a pandas UDF on (values, height, width)."""

    @F.pandas_udf(returns)
    def run(values: pd.Series, heights: pd.Series, widths: pd.Series) -> pd.Series:
        out: list = [None] * len(values)
        for rows, h, w in _stacks(heights, widths):
            done = kernel(_stack(values, rows, h, w, kind))
            for i, r in enumerate(rows):
                out[r] = done[i].ravel().tolist()
        return _lists(out)

    return run


def erode(mask: Column, height: Column, width: Column, k: int = WINDOW) -> Column:
    """Keep cells whose whole ``k x k`` neighbourhood is in the mask; the result may be empty."""
    if k < 3 or k % 2 == 0:
        raise ValueError(f"window must be odd and at least 3, got {k}")
    return _grid_udf(lambda m: _erode(m, k), bool, "array<boolean>")(mask, height, width)


def largest_region(
    values: Column, height: Column, width: Column, threshold: float, fill_holes: bool = True
) -> Column:
    """Mask of the largest 8-connected region above the threshold, holes filled.

    Equal sizes resolve to the region met first in row-major order. A grid with no cell above
    the threshold fails the job.
    """

    def kernel(v: np.ndarray) -> np.ndarray:
        mask = v > threshold
        if not mask.reshape(len(mask), -1).any(axis=1).all():
            raise ValueError(f"a grid has no cell above {threshold}")
        return _largest(mask, fill_holes)

    return _grid_udf(kernel, float, "array<boolean>")(values, height, width)


def area_average(values: Column, height: Column, width: Column, factor: int) -> Column:
    """Shrink by an integer factor, averaging every ``factor x factor`` block."""

    def kernel(v: np.ndarray) -> np.ndarray:
        n, h, w = v.shape
        if h % factor or w % factor:
            raise ValueError(f"a {h}x{w} grid does not divide by {factor}")
        return v.reshape(n, h // factor, factor, w // factor, factor).mean(axis=(2, 4))

    return _grid_udf(kernel, float, "array<double>")(values, height, width)


def nearest(mask: Column, height: Column, width: Column, to_height: int, to_width: int) -> Column:
    """Nearest sampling of a mask to a new size (the cell at ``floor(i * old / new)``)."""

    def kernel(m: np.ndarray) -> np.ndarray:
        n, h, w = m.shape
        ys = np.minimum(np.arange(to_height) * h // to_height, h - 1)
        xs = np.minimum(np.arange(to_width) * w // to_width, w - 1)
        return m[:, ys][:, :, xs]

    return _grid_udf(kernel, bool, "array<boolean>")(mask, height, width)


def _refuse_unfit(values: np.ndarray, name: str, data_range: float) -> None:
    """Stop on grids that may not be scored, by the rules of ``functions.arrays.array_fault``."""
    if values.size and not np.isfinite(values).all():
        raise ValueError(f"{name} is not finite")
    if values.size and (values.min() < -RANGE_TOLERANCE or values.max() > data_range + RANGE_TOLERANCE):
        raise ValueError(f"{name} is out of range")


def local_similarity(
    ref: Column,
    pred: Column,
    height: Column,
    width: Column,
    window: int = WINDOW,
    sigma: float = SIGMA,
    data_range: float = 1.0,
) -> Column:
    """Mean local similarity over the interior the window covers completely. Values that are not
    finite or outside the data range fail the job, as grids of another size than stated do."""
    taps = gaussian_taps(window, sigma)

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, hs: pd.Series, ws: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        for rows, h, w in _stacks(hs, ws):
            if min(h, w) < window:
                raise ValueError(f"a {h}x{w} grid is smaller than the window {window}")
            x, y = _stack(a, rows, h, w, float), _stack(b, rows, h, w, float)
            _refuse_unfit(x, "reference", data_range)
            _refuse_unfit(y, "prediction", data_range)
            out[rows] = _similarity(x, y, taps, data_range).mean(axis=(1, 2))
        return pd.Series(out)

    return run(ref, pred, height, width)


def unit_metrics(
    ref: Column,
    pred: Column,
    mask: Column,
    height: Column,
    width: Column,
    window: int = WINDOW,
    sigma: float = SIGMA,
    data_range: float = 1.0,
) -> Column:
    """All eight metrics of a unit; the similarity map is computed once for both regions.

    The masked similarity averages cells whose whole window lies in the mask. Values that are not
    finite or outside the data range and an empty mask fail the job; a mask thinner than the window gives null there, for the caller to handle.
    """
    taps, r = gaussian_taps(window, sigma), window // 2

    @F.pandas_udf(METRIC_TYPE)
    def run(a: pd.Series, b: pd.Series, m: pd.Series, hs: pd.Series, ws: pd.Series) -> pd.DataFrame:
        out = np.full((len(a), 8), np.nan)
        for rows, h, w in _stacks(hs, ws):
            if min(h, w) < window:
                raise ValueError(f"a {h}x{w} grid is smaller than the window {window}")
            x, y = _stack(a, rows, h, w, float), _stack(b, rows, h, w, float)
            _refuse_unfit(x, "reference", data_range)
            _refuse_unfit(y, "prediction", data_range)
            body = _stack(m, rows, h, w, bool)
            cells = body.sum(axis=(1, 2))
            if (cells == 0).any():
                raise ValueError("a mask selects no cell")
            delta = y - x
            similar = _similarity(x, y, taps, data_range)
            inner = _erode(body, window)[:, r : h - r, r : w - r]
            seen = inner.sum(axis=(1, 2))
            full_mse = (delta**2).mean(axis=(1, 2))
            body_mse = (delta**2 * body).sum(axis=(1, 2)) / cells
            with np.errstate(divide="ignore", invalid="ignore"):
                out[rows] = np.column_stack(
                    [
                        np.abs(delta).mean(axis=(1, 2)),
                        full_mse,
                        10 * np.log10(data_range**2 / full_mse),
                        similar.mean(axis=(1, 2)),
                        (np.abs(delta) * body).sum(axis=(1, 2)) / cells,
                        body_mse,
                        10 * np.log10(data_range**2 / body_mse),
                        (similar * inner).sum(axis=(1, 2)) / seen,
                    ]
                )
        frame = pd.DataFrame(out, columns=METRIC_TYPE.names)
        return frame.astype(object).where(frame.notna(), None)

    return run(ref, pred, mask, height, width)


def explode_grid(df: DataFrame, key: list[str], values: str, width: str) -> DataFrame:
    """Long form ``key, y, x, v``."""
    cells = df.select(*key, F.col(width).alias("_w"), F.posexplode(values).alias("_i", "v"))
    return cells.select(
        *key,
        F.floor(F.col("_i") / F.col("_w")).cast("int").alias("y"),
        F.pmod(F.col("_i"), F.col("_w")).cast("int").alias("x"),
        "v",
    )


def clip_limited_equalize(
    df: DataFrame,
    group: list[str],
    bin_column: str,
    bins: int = 256,
    clip: float = 2.0,
    name: str = "equalized",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Map quantised values through the clipped cumulative histogram of their group.

    Bins are capped at ``clip`` times the mean bin height (at least one), the excess is spread
    evenly, the first bins taking the remainder, and the running count is scaled to
    ``bins - 1``. The lookup is joined on (group, bin), and a hot cell is spread further. A bin that
    is null or outside 0 to ``bins - 1`` fails the job.
    """
    inside = F.coalesce(F.col(bin_column).between(0, bins - 1), F.lit(False))
    outside = F.concat(F.lit(f"outside the {bins} bins: "), F.coalesce(F.col(bin_column).cast("string"), F.lit("null")))
    df = df.where(F.when(inside, F.lit(True)).otherwise(F.raise_error(outside).cast("boolean")))
    cells = df.groupBy(*group, F.col(bin_column).alias("_bin")).agg(F.count("*").alias("_c"))
    # One histogram per group: at most ``bins`` entries.
    packed = cells.groupBy(*group).agg(
        F.sum("_c").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_bin", "_c"))).alias("_h")
    )
    limit = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(float(clip)) * F.col("_n") / F.lit(bins)))
    zero = F.lit(0).cast("long")
    excess = F.aggregate(F.map_values("_h"), zero, lambda s, c: s + F.greatest(c - limit, zero))
    filled = packed.select(*group, "_n", "_h", limit.alias("_limit"), excess.alias("_excess")).select(
        *group, "_n", "_h", "_limit", "_excess", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("_bin")
    )
    flat = (
        F.least(F.coalesce(F.try_element_at("_h", "_bin"), zero), F.col("_limit"))
        + F.floor(F.col("_excess") / F.lit(bins))
        + (F.col("_bin") < F.pmod(F.col("_excess"), F.lit(bins))).cast("long")
    )
    # Still hashed by group: this window sorts ``bins`` rows per group without a shuffle.
    w = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    lut = filled.withColumn("_flat", flat).select(
        *group,
        F.col("_bin").alias(bin_column),
        F.least(
            F.lit(bins - 1), F.rint(F.sum("_flat").over(w) * F.lit(float(bins - 1)) / F.col("_n")).cast("int")
        ).alias(name),
    )
    return lookup_join(df, lut, [*group, bin_column], "left", slice_rows)
