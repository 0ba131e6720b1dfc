"""Rasters held as arrays (row-major) with fixed height and width, filtered inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf


def cell_means(raster: Column, height: int, width: int, rows: int, cols: int) -> Column:
    """Means of rows x cols boxes with integer bounds, row-major."""
    cells = []
    for r in range(rows):
        for c in range(cols):
            at = [y * width + x + 1 for y in range(r * height // rows, (r + 1) * height // rows) for x in range(c * width // cols, (c + 1) * width // cols)]
            total = F.aggregate(F.transform(F.array(*map(F.lit, at)), lambda i: F.element_at(raster, i).cast("double")), F.lit(0.0), lambda a, b: a + b)
            cells.append(total / len(at))
    return F.array(*cells)


def gradients(raster: Column, width: int) -> tuple[Column, Column]:
    """First differences to the left and upper neighbour, 0 at the border."""
    value = lambda i: F.get(raster, i).cast("double")
    dx = F.transform(raster, lambda v, i: F.when(i % width == 0, 0.0).otherwise(v.cast("double") - value(F.greatest(i - 1, F.lit(0)))))
    dy = F.transform(raster, lambda v, i: F.when(i < width, 0.0).otherwise(v.cast("double") - value(F.greatest(i - width, F.lit(0)))))
    return dx, dy


def overlap(prior: Column, semantic: Column, level: float) -> list[Column]:
    """How many prior samples reach level, and how many do in both."""
    pairs = F.arrays_zip(prior.alias("a"), semantic.alias("b"))
    count = lambda test: F.size(F.filter(pairs, test)).cast("long")
    return [count(lambda p: p["a"] >= level), count(lambda p: (p["a"] >= level) & (p["b"] >= level))]


def fused(value: Column, prior: Column, semantic: Column) -> Column:
    """Per sample max(value, min(prior, semantic))."""
    low = F.zip_with(prior, semantic, lambda p, s: F.least(p, s))
    return F.zip_with(value, low, lambda v, m: F.greatest(v, m))


_STACK = 512  # rasters that are filtered at a time


def _udf(f: Callable[..., np.ndarray], height: int, width: int, kinds: tuple = (np.float64,)) -> Callable[..., Column]:
    """A column function over rasters of one size: f gets one (n, height, width) array for each column; other sizes and nulls give null."""
    n = height * width

    @pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            columns = (columns,) if isinstance(columns, pd.Series) else columns
            fits = np.array([all(x is not None and len(x) == n for x in row) for row in zip(*columns, strict=True)], dtype=bool)
            out = np.full(len(fits), None, dtype=object)
            for part in np.array_split(np.flatnonzero(fits), max(1, -(-int(fits.sum()) // _STACK))):
                if len(part):
                    found = f(*(np.stack(c.iloc[part].to_numpy()).astype(k).reshape(-1, height, width) for c, k in zip(columns, kinds, strict=True)))
                    for i, row in zip(part.tolist(), found.reshape(len(part), n), strict=True):
                        out[i] = row
            yield pd.Series(out)

    return run


def _windows(x: np.ndarray, radius: int, **pad) -> np.ndarray:
    """The square around each sample of a stack."""
    padded = np.pad(x, ((0, 0), (radius, radius), (radius, radius)), **pad)
    return np.lib.stride_tricks.sliding_window_view(padded, (2 * radius + 1,) * 2, axis=(1, 2))


def _box_mean(x: np.ndarray, radius: int) -> np.ndarray:
    return _windows(x, radius, mode="edge").mean(axis=(3, 4))


# Kernels: functions of stacks (n, height, width), used on whole rasters here and on tiles with a halo.


def box_blur_kernel(radius: int) -> Callable[..., np.ndarray]:
    def f(x: np.ndarray, valid: np.ndarray) -> np.ndarray:
        valid = valid.astype(bool)
        total = _windows(np.where(valid, x, 0.0), radius).sum(axis=(3, 4))
        return total / np.maximum(_windows(valid.astype(np.int64), radius).sum(axis=(3, 4)), 1)

    return f


def disc_maximum_kernel(radius: int) -> Callable[..., np.ndarray]:
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    disc = y * y + x * x <= radius * radius
    return lambda v: np.where(disc, _windows(v, radius, constant_values=-np.inf), -np.inf).max(axis=(3, 4))


def guided_kernel(radius: int, epsilon: float) -> Callable[..., np.ndarray]:
    """A sample depends on those within twice the radius."""

    def f(x: np.ndarray) -> np.ndarray:
        mean = _box_mean(x, radius)
        variance = _box_mean(x * x, radius) - mean * mean
        a = variance / (variance + epsilon)
        return _box_mean(a, radius) * x + _box_mean(mean * (1 - a), radius)

    return f


def bilateral_kernel(radius: int, space: float, tone: float) -> Callable[..., np.ndarray]:
    reach = np.arange(-radius, radius + 1)
    near = np.exp(-0.5 * (reach / space) ** 2)

    def along(x: np.ndarray, guide: np.ndarray) -> np.ndarray:
        views = lambda v: np.lib.stride_tricks.sliding_window_view(np.pad(v, ((0, 0), (0, 0), (radius, radius)), mode="edge"), 2 * radius + 1, axis=2)
        w = near * np.exp(-0.5 * ((views(guide) - guide[..., None]) / tone) ** 2)
        return (w * views(x)).sum(axis=3) / w.sum(axis=3)

    def f(x: np.ndarray, guide: np.ndarray) -> np.ndarray:
        turned = np.swapaxes(guide, 1, 2)
        return np.swapaxes(along(np.swapaxes(along(x, guide), 1, 2), turned), 1, 2)

    return f


def box_blur(height: int, width: int, radius: int) -> Callable[[Column, Column], Column]:
    """(raster, valid) -> mean of the valid samples in a square, those beyond the border left out; 0 where there is none."""
    return _udf(box_blur_kernel(radius), height, width, (np.float64, bool))


def disc_maximum(height: int, width: int, radius: int) -> Callable[[Column], Column]:
    """Largest sample within a circle."""
    return _udf(disc_maximum_kernel(radius), height, width)


def guided(height: int, width: int, radius: int, epsilon: float) -> Callable[[Column], Column]:
    """Self-guided filter: local lines a * x + b from box means, averaged."""
    return _udf(guided_kernel(radius, epsilon), height, width)


def bilateral(height: int, width: int, radius: int = 12, space: float = 4.0, tone: float = 0.5) -> Callable[[Column, Column], Column]:
    """(raster, guide) -> separable smoothing weighted by distance and by the guide's difference, rows then columns; edges repeat.

    The guide stays the same in both passes.
    """
    return _udf(bilateral_kernel(radius, space, tone), height, width, (np.float64, np.float64))


def gain_raster(height: int, width: int, map_height: int, map_width: int, gamma: float, low: float, high: float, weight: float, base_offset: float, alternate_offset: float) -> Callable[[Column, Column], Column]:
    """(linear samples, 8-bit gain codes of another size) -> samples with the gain applied, codes read bilinearly at pixel centres."""

    def places(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        first = np.minimum(at.astype(np.int64), max(0, m - 2))
        return first, np.minimum(first + 1, m - 1), at - first

    (y0, y1, fy), (x0, x1, fx) = places(height, map_height), places(width, map_width)

    @pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for base, codes in batches:
            out = []
            for b, c in zip(base, codes, strict=True):
                if b is None or c is None or len(b) != height * width or len(c) != map_height * map_width:
                    out.append(None)
                    continue
                grid = np.asarray(c, np.float64).reshape(map_height, map_width)
                rows = grid[y0] * (1 - fy)[:, None] + grid[y1] * fy[:, None]
                code = rows[:, x0] * (1 - fx) + rows[:, x1] * fx
                gain = low + (code / 255) ** (1 / gamma) * (high - low)
                out.append(((np.asarray(b, np.float64).reshape(height, width) + base_offset) * 2.0 ** (gain * weight) - alternate_offset).ravel())
            yield pd.Series(out)

    return run


def area_resample(raster: Column, height: int, width: int, rows: int, cols: int) -> Column:
    """Coverage-weighted means over fractional footprints, row-major: shares of edge samples count in part."""

    def spans(n: int, m: int) -> list[list[tuple[int, float]]]:
        out = []
        for k in range(m):
            low, high = k * n / m, (k + 1) * n / m
            out.append([(i, min(high, i + 1) - max(low, i)) for i in range(int(low), min(n, int(np.ceil(high)))) if min(high, i + 1) - max(low, i) > 1e-12])
        return out

    cells = []
    for down in spans(height, rows):
        for across in spans(width, cols):
            parts = [F.get(raster, F.lit(y * width + x)).cast("double") * (wy * wx) for y, wy in down for x, wx in across]
            cells.append(sum(parts[1:], parts[0]) / sum(wy * wx for _, wy in down for _, wx in across))
    return F.array(*cells)


def lut_trilinear(edge: int, nodes: np.ndarray) -> Callable[[Column, Column, Column], Column]:
    """A 3-D table (edge**3 nodes of three values, first axis fastest) read at r, g, b in [0, 1], clamped."""
    table = np.asarray(nodes, dtype=np.float64).reshape(edge, edge, edge, 3)  # b, g, r

    @pandas_udf("array<double>")
    def run(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.Series:
        at = np.clip(np.stack([b, g, r], axis=1).astype(np.float64), 0, 1) * (edge - 1)
        low = np.minimum(at.astype(np.int64), edge - 2)
        f = at - low
        out = np.zeros((len(at), 3))
        for corner in range(8):
            step = np.array([corner >> 2 & 1, corner >> 1 & 1, corner & 1])
            weight = np.prod(np.where(step, f, 1 - f), axis=1)
            i = low + step
            out += weight[:, None] * table[i[:, 0], i[:, 1], i[:, 2]]
        return pd.Series(list(out))

    return run


def pack_half(raster: Column) -> Column:
    """Arrays of numbers as little-endian half floats; null where one does not fit."""

    @pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            halves = [None if v is None else np.asarray(v, dtype=np.float64).astype("<f2") for v in values]
        return pd.Series([None if h is None or not np.isfinite(h).all() else h.tobytes() for h in halves])

    return run(raster)


def unpack_half(data: Column) -> Column:
    @pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or len(d) % 2 else np.frombuffer(d, "<f2").astype(np.float32) for d in values])

    return run(data)
