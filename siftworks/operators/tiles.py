"""Rasters larger than a row: square tiles, exchange of halos, filters and local apply on tiles.

A raster of any size is many rows, one a tile, so it is read, filtered and written by many tasks.
What a tile needs of its neighbours, its halo, are strips of them as wide as the filter reaches;
only tiles and strips are shuffled, and a group is a tile with at most eight strips.  A kernel then
sees the tile with its halo, cut at the borders of the raster, and its result is cut to the tile:
the same samples as if it had seen the whole raster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftworks.operators.lattice import LONG, OUTPUTS, PLANES, SHORT, TERMS
from siftworks.operators.local_fits import basis_of, corners, plane_weights, spot

SIZE = 256
_GRID = ("rows", "cols", "ty", "tx")


def cut(samples: DataFrame, keys: list[str], values: list[str], size: int = SIZE) -> DataFrame:
    """samples (keys, y, x, values) -> tiles (keys, rows, cols, ty, tx, size, values as arrays, row-major).

    rows and cols are those of the raster: its largest y and x, and one.  A place without a sample is
    NaN; of several samples at one place the least counts.  Negative or null places are left out.
    """
    inside = samples.where("y >= 0 and x >= 0")
    extent = inside.groupBy(*keys).agg((F.max("y") + 1).cast("int").alias("rows"), (F.max("x") + 1).cast("int").alias("cols"))
    place = lambda c: F.floor(F.col(c) / size).cast("int")
    at = ((F.col("y") % size) * size + F.col("x") % size).cast("int")
    got = inside.groupBy(*keys, place("y").alias("ty"), place("x").alias("tx")).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), *(F.col(v).cast("double").alias(v) for v in values)))).alias("s"))
    full = extent.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / size).cast("int"))).alias("ty")).select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("cols") - 1) / size).cast("int"))).alias("tx"))
    joined = full.join(got, [*keys, "ty", "tx"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            grid = [batch.column(names.index(c)).to_pylist() for c in _GRID]
            listed = batch.column(names.index("s"))
            out = {v: [] for v in values}
            for i, (rows, cols, ty, tx) in enumerate(zip(*grid, strict=True)):
                h, w = min(size, rows - ty * size), min(size, cols - tx * size)
                some = listed[i].values
                for v in values:
                    tile = np.full((size, size), np.nan)
                    if some is not None:
                        place, number = some.field("at").to_numpy(), some.field(v).to_numpy(zero_copy_only=False)
                        tile.ravel()[place[::-1]] = number[::-1]  # the first of equal places is written last
                    out[v].append(tile[:h, :w].ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in (*keys, *_GRID)), pa.array([size] * batch.num_rows, pa.int32()), *(pa.array(out[v], pa.list_(pa.float64())) for v in values)], names=[*keys, *_GRID, "size", *values])

    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{c} int" for c in _GRID), "size int", *(f"{v} array<double>" for v in values)])
    return joined.select(*keys, *_GRID, "s").mapInArrow(run, schema)


def samples_of(tiles: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """tiles -> (keys, y, x, values)."""
    width = F.least(F.col("size"), F.col("cols") - F.col("tx") * F.col("size"))
    each = tiles.select(*keys, *_GRID, "size", width.alias("_w"), F.posexplode(F.arrays_zip(*values)).alias("_i", "_v"))
    return each.select(*keys, (F.col("ty") * F.col("size") + F.floor(F.col("_i") / F.col("_w"))).cast("long").alias("y"), (F.col("tx") * F.col("size") + F.col("_i") % F.col("_w")).cast("long").alias("x"), *(F.col("_v")[v].alias(v) for v in values))


def filtered(tiles: DataFrame, keys: list[str], values: list[str], reach: int, kernel: Callable[..., np.ndarray], name: str) -> DataFrame:
    """tiles with name = kernel of the values' stacks, as on the whole raster; reach: how far a sample sees, a tile's size at most."""
    kinds = {f.name: f.dataType.simpleString() for f in tiles.schema}
    head = [*keys, *_GRID, "size"]
    piece_schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{c} int" for c in (*_GRID, "size")), "y0 int", "x0 int", "h int", "w int", *(f"{v} array<double>" for v in values)])
    tile_schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{c} int" for c in (*_GRID, "size")), *(f"{v} array<double>" for v in values), f"{name} array<double>"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            take, rows_out = [], []
            for i in range(batch.num_rows):
                rows, cols, ty, tx, size = (at[c][i].as_py() for c in (*_GRID, "size"))
                if reach > size:
                    raise ValueError("a filter reaches one tile far at most")
                h, w = min(size, rows - ty * size), min(size, cols - tx * size)
                arrays = [np.asarray(at[v][i].values).reshape(h, w) for v in values]
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        to_y, to_x = ty + dy, tx + dx
                        if not (0 <= to_y * size < rows and 0 <= to_x * size < cols):
                            continue
                        top, bottom = (0, min(h, reach)) if dy < 0 else (max(0, h - reach), h) if dy > 0 else (0, h)
                        left, right = (0, min(w, reach)) if dx < 0 else (max(0, w - reach), w) if dx > 0 else (0, w)
                        if bottom > top and right > left:
                            take.append(i)
                            rows_out.append((to_y, to_x, ty * size + top, tx * size + left, bottom - top, right - left, *(a[top:bottom, left:right].ravel() for a in arrays)))
            chosen = batch.take(pa.array(take, pa.int32()))
            columns = list(zip(*rows_out, strict=True)) if rows_out else [[]] * (6 + len(values))
            whole = [chosen.column(chosen.schema.names.index(c)) for c in (*keys, "rows", "cols")]
            yield pa.RecordBatch.from_arrays(
                [*whole, pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), chosen.column(chosen.schema.names.index("size")), *(pa.array(c, pa.int32()) for c in columns[2:6]), *(pa.array(c, pa.list_(pa.float64())) for c in columns[6:])],
                names=[*head, "y0", "x0", "h", "w", *values],
            )

    def run(pieces: pa.Table) -> pa.Table:
        rows, cols, ty, tx, size = (pieces.column(c)[0].as_py() for c in (*_GRID, "size"))
        top, left = max(0, ty * size - reach), max(0, tx * size - reach)
        bottom, right = min(rows, (ty + 1) * size + reach), min(cols, (tx + 1) * size + reach)
        stacks = [np.full((1, bottom - top, right - left), np.nan) for _ in values]
        for y0, x0, h, w, *parts in zip(*(pieces.column(c).to_pylist() for c in ("y0", "x0", "h", "w")), *(pieces.column(v) for v in values), strict=True):
            for stack, part in zip(stacks, parts, strict=True):
                stack[0, y0 - top : y0 - top + h, x0 - left : x0 - left + w] = np.asarray(part.values).reshape(h, w)
        inner = (0, slice(ty * size - top, min(rows, (ty + 1) * size) - top), slice(tx * size - left, min(cols, (tx + 1) * size) - left))
        found = kernel(*stacks)
        one = pieces.slice(0, 1).select(head)
        for v, array in zip([*values, name], [*stacks, found], strict=True):
            one = one.append_column(v, pa.array([array[inner].ravel()], pa.list_(pa.float64())))
        return one

    return tiles.select(*head, *values).mapInArrow(deal, piece_schema).groupBy(*keys, "ty", "tx").applyInArrow(run, tile_schema)


def _cells(start: Column, size: Column, extent: Column, count: int) -> Column:
    """The slots that the pixels of a tile are blended from: those of its first pixel to those of its last."""
    low = F.floor(spot(start, extent, count) * count)
    high = F.floor(spot(F.least(start + size, extent) - 1, extent, count) * count) + 1
    held = lambda c: F.greatest(F.lit(0), F.least(F.lit(count - 1), c)).cast("int")
    return F.sequence(held(low), held(high))


def apply_local(tiles: DataFrame, keys: list[str], cells: DataFrame, values: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """tiles with three values -> tiles with out_<value>: quadratic blocks of a lattice, blended by place and brightness.

    cells (keys, cell_x, cell_y, plane, coefficients): TERMS x OUTPUTS numbers, term by term.  A tile
    meets only the cells it is blended from; a cell that is missing counts as zeros.
    """
    asked = tiles.select(*keys, "ty", "tx", F.explode(_cells(F.col("ty") * F.col("size"), F.col("size"), F.col("rows"), SHORT)).alias("cell_y"), _cells(F.col("tx") * F.col("size"), F.col("size"), F.col("cols"), LONG).alias("_x"))
    asked = asked.select(*keys, "ty", "tx", "cell_y", F.explode("_x").alias("cell_x"))
    near = asked.join(cells, [*keys, "cell_x", "cell_y"]).groupBy(*keys, "ty", "tx").agg(F.collect_list(F.struct("cell_x", "cell_y", "plane", "coefficients")).alias("_cells"))
    joined = tiles.join(near, [*keys, "ty", "tx"], "left").select(*keys, *_GRID, "size", *values, "_cells")
    kinds = {f.name: f.dataType.simpleString() for f in tiles.schema}
    names = [f"out_{v}" for v in values]
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{c} int" for c in (*_GRID, "size")), *(f"{n} array<double>" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out = [[] for _ in names]
            for i in range(batch.num_rows):
                rows, cols, ty, tx, size = (at[c][i].as_py() for c in (*_GRID, "size"))
                h, w = min(size, rows - ty * size), min(size, cols - tx * size)
                rgb = np.stack([np.asarray(at[v][i].values) for v in values], axis=1)
                lattice = np.zeros((LONG, SHORT, PLANES, TERMS, OUTPUTS))
                for c in at["_cells"][i].as_py() or ():
                    lattice[c["cell_x"], c["cell_y"], c["plane"]] = np.reshape(c["coefficients"], (TERMS, OUTPUTS))
                y, x = np.divmod(np.arange(h * w), w)
                found = blend(rgb, ty * size + y, tx * size + x, rows, cols, lattice)
                for j in range(3):
                    out[j].append(found[:, j])
            yield pa.RecordBatch.from_arrays([*(at[c] for c in (*keys, *_GRID, "size")), *(pa.array(o, pa.list_(pa.float64())) for o in out)], names=[*keys, *_GRID, "size", *names])

    return joined.mapInArrow(run, schema)


def blend(rgb: np.ndarray, y: np.ndarray, x: np.ndarray, rows: int, cols: int, lattice: np.ndarray) -> np.ndarray:
    """Three outputs of each pixel: the lattice's blocks at its four corners and all planes, by weight."""
    basis, plane = basis_of(rgb), plane_weights(rgb)
    out = np.zeros((len(rgb), OUTPUTS))
    for cell_x, cell_y, share in corners(y, x, rows, cols):
        for p in range(PLANES):
            out += (share * plane[:, p])[:, None] * np.einsum("nt,nto->no", basis, lattice[cell_x, cell_y, p])
    return out
