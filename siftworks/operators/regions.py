"""Merging of near and alike points in their order, by components of the pairs that could merge.

The rule is serial: point by point, each is merged with the regions of the earlier points within a
radius, in order, where the merged region's tones stay within a tolerance.  Two points can only be
merged directly if they are near and their own tones are alike.  Such pairs come from a join of
grid cells with their neighbours; their connected components cannot touch each other, and each is
replayed in order, as a stream of pairs.  Points alike in place and tone always share a region, so
only the first of them takes part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftworks.operators.lineage import scratch_folder
from siftworks.operators.placement import components, in_order


def _union(tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("region", pa.int64())])
        now = None
        parent: dict[int, int] = {}
        low: dict[int, float] = {}
        high: dict[int, float] = {}

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def told() -> pa.RecordBatch:
            nodes = list(parent)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(i) for i in nodes], pa.int64())], schema=schema)

        for batch in batches:
            for component, a, b, tone_a, tone_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if component != now:
                    if parent:
                        yield told()
                    now = component
                    parent, low, high = {}, {}, {}
                for i, tone in ((a, tone_a), (b, tone_b)):
                    if i not in parent:
                        parent[i], low[i], high[i] = i, tone, tone
                x, y = find(a), find(b)
                if x != y and max(high[x], high[y]) - min(low[x], low[y]) <= tolerance:
                    keep, gone = min(x, y), max(x, y)
                    parent[gone] = keep
                    low[keep], high[keep] = min(low[x], low[y]), max(high[x], high[y])
        if parent:
            yield told()

    return run


def merge_regions(points: DataFrame, radius: float, tolerance: float) -> DataFrame:
    """points (image, point, x, y, tone) -> image, point, region: the least point of its region.

    point numbers an image's points in their order.  Points without a place or tone are regions of
    their own; of two rows of one point number each is a point.
    """
    spark = points.sparkSession
    kept = lambda df: (lambda path: (df.write.parquet(path), spark.read.parquet(path))[1])(scratch_folder(spark))
    chosen = points.select("image", "point", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "tone")))
    placed = kept(in_order(chosen, ["image", "point", "x", "y", "tone"], "node"))
    sound = placed.where("x is not null and y is not null and tone is not null and not isnan(x) and not isnan(y) and not isnan(tone)")
    twins = ["image", "x", "y", "tone"]
    firsts = kept(sound.groupBy(*twins).agg(F.min("node").alias("node")))
    cell = lambda c: F.floor(F.col(c) / (radius or 1.0)).cast("long")
    here = firsts.withColumns({"cx": cell("x"), "cy": cell("y")})
    around = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1))))
    near = here.select("image", F.col("node").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("tone").alias("tone_b"), "cx", "cy", around.alias("d"))
    near = near.select("image", "b", "bx", "by", "tone_b", (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"))
    pairs = here.withColumnRenamed("node", "a").join(near, ((here["image"].eqNullSafe(near["image"])) & (here["cx"] == near["cx"]) & (here["cy"] == near["cy"]))).where("a > b")
    gap = (F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2
    pairs = kept(pairs.where((gap <= radius * radius) & (F.abs(F.col("tone") - F.col("tone_b")) <= tolerance)).select("a", "b", F.col("tone").alias("tone_a"), "tone_b"))
    whole = components(pairs.select("a", "b"))
    told = pairs.join(whole.withColumnRenamed("node", "a"), "a").select("component", "a", "b", "tone_a", "tone_b")
    found = kept(told.repartition("component").sortWithinPartitions("component", "a", "b").mapInArrow(_union(tolerance), "node long, region long"))
    first = firsts.select(*(F.col(t).alias(f"_{t}") for t in twins), F.col("node").alias("first"))
    match = placed["image"].eqNullSafe(first["_image"])
    for t in twins[1:]:
        match = match & (placed[t] == first[f"_{t}"])
    joined = placed.join(first, match, "left").select("image", "point", F.coalesce("first", "node").alias("node"))
    regions = joined.join(found, "node", "left").select("image", "point", F.coalesce("region", "node").alias("node"))
    return regions.join(placed.select("node", F.col("point").alias("region")), "node").select("image", "point", "region")
