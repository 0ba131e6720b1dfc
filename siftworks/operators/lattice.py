"""Coefficient lattices as rows (id, y, x, place, value): facts, gate scores, sparse scatter; and their packed form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from siftworks.operators.ranking import numbered, percentiles

# The lattice has LONG or SHORT slots a side, PLANES planes, TERMS terms and three outputs; UNIT are the places of its identity.
LONG, SHORT, PLANES, TERMS, OUTPUTS = 12, 9, 8, 10, 3
BLOCK = TERMS * OUTPUTS
UNIT = (3, 7, 11)


def identity(place: Column) -> Column:
    """What the identity holds at a place."""
    return F.when((place % BLOCK).isin(*UNIT), 1.0).otherwise(0.0)


def payload_facts(values: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """Count, least and largest value, and RMSE and largest distance from the identity, of each lattice."""
    gap = F.col(value) - identity(F.col(place))
    return values.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.sqrt(F.avg(gap * gap)).alias("identity_rmse"), F.max(F.abs(gap)).alias("identity_max"),
    )


def channel_range(values: DataFrame, keys: list[str], place: str, value: str, channels: int = 3) -> DataFrame:
    """Least and largest sample of each channel of interleaved samples."""
    return values.groupBy(*keys, (F.col(place) % channels).cast("int").alias("channel")).agg(F.min(value).alias("minimum"), F.max(value).alias("maximum"))


def gate_scores(cells: DataFrame, keys: list[str]) -> DataFrame:
    """cells (keys, y, x, place, residual, disagreement), scaled and valid ones only -> scores of each lattice.

    RMS, 99 % point and largest |residual|, RMS of the disagreement, and the mean step between neighbours
    that are both there.
    """
    size = cells.withColumn("_size", F.abs("residual"))
    top = percentiles(size.select(*keys, "_size"), keys, "_size", {"residual_p99": 0.99}).drop("n")
    sums = size.groupBy(*keys).agg(F.sqrt(F.avg(F.col("residual") ** 2)).alias("residual_rms"), F.max("_size").alias("residual_max"), F.sqrt(F.avg(F.col("disagreement") ** 2)).alias("disagreement_rms"))
    here = cells.select(*keys, "y", "x", "place", F.col("residual").alias("_a"))
    beside = cells.select(*keys, F.explode(F.array(F.struct(F.col("y").alias("y"), (F.col("x") - 1).alias("x")), F.struct((F.col("y") - 1).alias("y"), F.col("x").alias("x")))).alias("_at"), "place", F.col("residual").alias("_b"))
    steps = here.join(beside.select(*keys, "_at.*", "place", "_b"), [*keys, "y", "x", "place"]).groupBy(*keys).agg(F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("variation"))
    return sums.join(top, keys).join(steps, keys, "left")


def scattered(mask: DataFrame, packed: DataFrame, keys: list[str], place: str, scale: Column, offset: Column) -> DataFrame:
    """mask (keys, place, on) and packed (keys, rank from 1, packed) -> mask with value.

    The k-th set place in order takes the k-th packed number, less offset and times scale; others are 0.
    Ranks are taken in slices.  A place without its packed number is null.
    """
    ranked = numbered(mask.where("on"), keys, [place], "rank")
    placed = ranked.join(packed, [*keys, "rank"], "left").select(*keys, place, ((F.col("packed") - offset) * scale).alias("_value"))
    return mask.join(placed, [*keys, place], "left").select(*mask.columns, F.when(F.col("on"), F.col("_value")).otherwise(0.0).alias("value"))


def linear_metadata(base: Column, hdr: Column, stops: Column) -> Column:
    """Exposure and gain from the 98 % points of a base and an HDR image; null where they are too small."""
    ratio = F.try_divide(hdr, base)
    exposure = ratio / 0.40126406
    held = F.greatest(F.lit(4.0), F.least(F.lit(10.4), exposure))
    gain = F.greatest(F.lit(0.5), F.least(F.lit(2.5), 1.51271843 + 0.15670632 * stops + 0.14766724 * ratio))
    return F.when((base > 1 / 4096) & (hdr > 0), F.struct((F.round(held * 65) / 65).alias("exposure"), exposure.alias("unclamped"), ratio.alias("ratio"), gain.alias("gain"), (4 * gain).alias("encoding_gain")))


_SLOTS = LONG * SHORT * PLANES * BLOCK


def unpack_lattice(payload: Column, landscape: Column) -> Column:
    """Half floats stored column by column -> values row by row (y, x, plane, term, output); null where the size is wrong or a value not finite.

    A lattice has 100 kB: call lineage.small_batches() for many, or hundreds of them pass to Python at a time.
    """

    @pandas_udf("array<float>")
    def run(data: pd.Series, wide: pd.Series) -> pd.Series:
        out = []
        for d, w in zip(data, wide, strict=True):
            v = np.frombuffer(d, "<f2") if d is not None and len(d) == 2 * _SLOTS else None
            if v is None or not np.isfinite(v).all():
                out.append(None)
                continue
            x, y = (LONG, SHORT) if w else (SHORT, LONG)
            out.append(v.reshape(x, y, -1).swapaxes(0, 1).astype(np.float32).ravel())
        return pd.Series(out, dtype=object)

    return run(payload, landscape)


def pack_lattice(values: Column, landscape: Column) -> Column:
    """The inverse of unpack_lattice(); null where a value does not fit a half float."""

    @pandas_udf("binary")
    def run(rows: pd.Series, wide: pd.Series) -> pd.Series:
        out = []
        for r, w in zip(rows, wide, strict=True):
            if r is None or len(r) != _SLOTS:
                out.append(None)
                continue
            x, y = (LONG, SHORT) if w else (SHORT, LONG)
            with np.errstate(over="ignore"):
                h = np.asarray(r, np.float64).reshape(y, x, -1).swapaxes(0, 1).astype("<f2")
            out.append(np.ascontiguousarray(h).tobytes() if np.isfinite(h).all() else None)
        return pd.Series(out, dtype=object)

    return run(values, landscape)
