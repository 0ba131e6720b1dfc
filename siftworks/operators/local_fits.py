"""Weighted fits in the cells of a lattice: moments by cell and plane, solved in stacks.

A pixel belongs to four cells by its place, as in bilinear reading, and to all planes by its
brightness.  In every (cell, plane) a quadratic form of the colour is fitted to what the pixel
should change by.  A task adds up the products of its pixels, one small table a raster, before
anything is shuffled; Spark sums the tables; the small systems are solved many at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftworks.operators.lattice import LONG, OUTPUTS, PLANES, SHORT, TERMS, UNIT

# Width of a plane in steps between planes; ridge of a cell, and its factor for quadratic terms; parameters and bounds of a refinement.
SIGMA = 2.5
RIDGE, LEAST_RIDGE, QUADRATIC = 1e-5, 1e-9, 10.0
PARAMETERS, HUBER, REFINE_RIDGE, REFINE_BOUND = 12, 12.0, 1e-6, 1 / 32
UPPER = tuple((i, j) for i in range(TERMS) for j in range(i, TERMS))
_SUMS = len(UPPER) + TERMS * OUTPUTS
_CHUNK, _RASTERS = 2048, 32


def spot(pixel: Column | np.ndarray, extent: Column | int, count: int):
    """Where a pixel lies among count slots, from 0 to 1: slots have an even pitch, and pixels beyond the outer centres stay there."""
    if isinstance(pixel, Column):
        step = F.ceil(extent / count)
        pitch = (step + step % 2).cast("double")
        first = pitch / 2 - 1
        held = F.greatest(first, F.least(first + pitch * (count - 1), pixel.cast("double")))
        return (0.5 + (held - first) * (count - 1) / F.greatest(F.lit(1.0), pitch * (count - 1))) / count
    step = -(-extent // count)
    pitch = float(step + step % 2)
    first = pitch / 2 - 1
    held = np.clip(pixel, first, first + pitch * (count - 1))
    return (0.5 + (held - first) * (count - 1) / max(1.0, pitch * (count - 1))) / count


def _slots(pixel: np.ndarray, extent: np.ndarray | int, count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    at = spot(pixel, extent, count) * count
    low = np.clip(np.floor(at), 0, count - 1).astype(np.int64)
    high = np.minimum(low + 1, count - 1)
    part = np.where(low == high, 0.0, np.clip(at - low, 0.0, 1.0))
    return [(low, 1 - part), (high, part)]


def corners(y: np.ndarray, x: np.ndarray, rows: int, cols: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(cell_x, cell_y, share) of each pixel, four times."""
    return [(cx, cy, wx * wy) for cy, wy in _slots(y, rows, SHORT) for cx, wx in _slots(x, cols, LONG)]


def basis_of(rgb: np.ndarray) -> np.ndarray:
    r, g, b = rgb.T
    return np.stack([np.ones_like(r), r, g, b, r * r, r * g, r * b, g * g, g * b, b * b], axis=1)


def plane_weights(rgb: np.ndarray) -> np.ndarray:
    """Shares of the planes, by brightness: halfway between the mean and the largest channel."""
    bright = 0.5 * (rgb.mean(axis=1) + rgb.max(axis=1))
    away = (bright[:, None] - (np.arange(PLANES) + 1) / (PLANES + 1)) * PLANES
    weight = np.exp(-0.5 * (away / SIGMA) ** 2)
    total = weight.sum(axis=1, keepdims=True)
    return np.divide(weight, total, out=np.zeros_like(weight), where=total > 0)


def _products(rgb: np.ndarray, target: np.ndarray) -> np.ndarray:
    basis = basis_of(rgb)
    pairs = np.stack([basis[:, i] * basis[:, j] for i, j in UPPER], axis=1)
    return np.concatenate([pairs, (basis[:, :, None] * (target - rgb)[:, None, :]).reshape(len(rgb), -1)], axis=1)


def local_moments(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """pixels (keys, rows, cols, y, x, r, g, b, to_r, to_g, to_b) -> keys, cell_x, cell_y, plane, and the sums s0, s1, ...

    Sums of weight times products of terms (UPPER), then of weight times term times what each channel
    should change by.  Pixels with a null or non-finite number, or outside their raster, are left out.
    """
    numbers = ["r", "g", "b", "to_r", "to_g", "to_b"]
    sound = F.col("y").between(0, F.col("rows") - 1) & F.col("x").between(0, F.col("cols") - 1)
    for n in numbers:
        sound = sound & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}
    place = F.struct(*keys, "rows", "cols")
    chosen = pixels.where(sound).select(F.xxhash64(place).alias("_raster"), *keys, *(F.col(c).cast("long").alias(c) for c in ("rows", "cols", "y", "x")), *(F.col(n).cast("double").alias(n) for n in numbers))
    cells = LONG * SHORT * PLANES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for key, sums in held.items():
                some = np.flatnonzero(sums.any(axis=1))
                at = (some // (SHORT * PLANES), some // PLANES % SHORT, some % PLANES)
                yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(some), t) for k, t in zip(key, types, strict=True)), *(pa.array(a.astype(np.int32)) for a in at), *(pa.array(c) for c in np.ascontiguousarray(sums[some].T))], names=[*keys, "cell_x", "cell_y", "plane", *(f"s{i}" for i in range(_SUMS))])
            held.clear()

        types: list = []
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            types = [at[k].type for k in keys]
            raster = at["_raster"].to_numpy()
            order = np.argsort(raster, kind="stable")
            bounds = np.flatnonzero(np.concatenate([[True], raster[order][1:] != raster[order][:-1]])) if len(order) else []
            for start, end in zip(bounds, [*bounds[1:], len(order)], strict=True):
                first = int(order[start])
                key = tuple(at[k][first].as_py() for k in keys)
                rows, cols = at["rows"][first].as_py(), at["cols"][first].as_py()
                sums = held.setdefault(key, np.zeros((cells, _SUMS)))
                for part in np.array_split(order[start:end], -(-(end - start) // _CHUNK)):
                    y, x = at["y"].to_numpy()[part], at["x"].to_numpy()[part]
                    rgb, target = (np.stack([at[n].to_numpy(zero_copy_only=False)[part] for n in names], axis=1) for names in (numbers[:3], numbers[3:]))
                    plane, many = plane_weights(rgb), np.zeros((cells, len(part)))
                    for cell_x, cell_y, share in corners(y, x, rows, cols):
                        for p in range(PLANES):
                            many[(cell_x * SHORT + cell_y) * PLANES + p, np.arange(len(part))] += share * plane[:, p]
                    sums += many @ _products(rgb, target)
                if len(held) >= _RASTERS:
                    yield from told()
        yield from told()

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "cell_x int, cell_y int, plane int", *(f"s{i} double" for i in range(_SUMS))])
    return chosen.mapInArrow(run, schema).groupBy(*keys, "cell_x", "cell_y", "plane").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(_SUMS)))


def local_fits(moments: DataFrame, keys: list[str], linear: float, quadratic: float) -> DataFrame:
    """local_moments() -> keys, cell_x, cell_y, plane, coefficients (TERMS x OUTPUTS, identity included).

    A ridge holds what the pixels of a cell do not tell; changes are held to +-linear in the first
    four terms and +-quadratic in the others.
    """
    head = [*keys, "cell_x", "cell_y", "plane"]
    kinds = {f.name: f.dataType.simpleString() for f in moments.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = np.where(np.arange(TERMS) < 4, linear, quadratic)[None, :, None]
        for batch in batches:
            names = batch.schema.names
            s = np.stack([batch.column(names.index(f"s{i}")).to_numpy() for i in range(_SUMS)], axis=1)
            m = np.zeros((len(s), TERMS, TERMS))
            for k, (i, j) in enumerate(UPPER):
                m[:, i, j] = m[:, j, i] = s[:, k]
            ridge = np.maximum(np.trace(m, axis1=1, axis2=2) / TERMS * RIDGE, LEAST_RIDGE)
            m[:, range(TERMS), range(TERMS)] += ridge[:, None] * np.where(np.arange(TERMS) < 4, 1.0, QUADRATIC)
            lower = np.linalg.cholesky(m)
            half = np.linalg.solve(lower, s[:, len(UPPER) :].reshape(-1, TERMS, OUTPUTS))
            out = np.clip(np.linalg.solve(np.swapaxes(lower, 1, 2), half), -bound, bound).reshape(len(s), -1)
            out[:, list(UNIT)] += 1.0
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in head), pa.array(list(out), pa.list_(pa.float64()))], names=[*head, "coefficients"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in head), "coefficients array<double>"])
    return moments.mapInArrow(run, schema)


def refinement(samples: DataFrame, keys: list[str], scalars: DataFrame | None = None) -> DataFrame:
    """One bounded step of PARAMETERS parameters for each key: keys, step.

    samples (keys, derivative array, residual) count by their mean, with Huber weights; scalars (keys,
    derivative, residual, weight) are added as they are.  A ridge scaled by the trace, each parameter
    held to +-REFINE_BOUND.  A system that stays singular is an error.
    """
    pairs = [(i, j) for i in range(PARAMETERS) for j in range(i, PARAMETERS)]
    d, res = F.col("derivative"), F.col("residual")

    def sums(df: DataFrame, weight: Column, n: Column) -> DataFrame:
        return df.groupBy(*keys).agg(n.alias("n"), *(F.sum(weight * d[i] * d[j]).alias(f"m{i}_{j}") for i, j in pairs), *(F.sum(weight * d[i] * res).alias(f"v{i}") for i in range(PARAMETERS)))

    names = [*(f"m{i}_{j}" for i, j in pairs), *(f"v{i}" for i in range(PARAMETERS))]
    parts = sums(samples, F.lit(HUBER) / F.greatest(F.lit(HUBER), F.abs(res)), F.count(F.lit(1))).select(*keys, *((F.col(c) / F.col("n")).alias(c) for c in names))
    if scalars is not None:
        parts = parts.unionByName(sums(scalars, F.col("weight"), F.count(F.lit(1))).select(*keys, *names)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in names))
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            m, v = np.zeros((batch.num_rows, PARAMETERS, PARAMETERS)), np.stack([at[f"v{i}"].to_numpy() for i in range(PARAMETERS)], axis=1)
            for i, j in pairs:
                m[:, i, j] = m[:, j, i] = at[f"m{i}_{j}"].to_numpy()
            ridge = np.maximum(np.trace(m, axis1=1, axis2=2) / PARAMETERS * REFINE_RIDGE, LEAST_RIDGE)
            m[:, range(PARAMETERS), range(PARAMETERS)] += ridge[:, None]
            step = np.clip(np.linalg.solve(m, v[:, :, None])[:, :, 0], -REFINE_BOUND, REFINE_BOUND)
            yield pa.RecordBatch.from_arrays([*(at[k] for k in keys), pa.array(list(step), pa.list_(pa.float64()))], names=[*keys, "step"])

    return parts.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "step array<double>"]))
