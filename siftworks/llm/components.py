"""Connected components of an edge table by alternating star contraction.

Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond",
2014).  Each step is one aggregation with map-side combine and one join against its one row per
node, so a node with a third of all edges is split by the skew join and never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftworks.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """edges (a, b), a > b: the larger neighbours of a node go to its least neighbour, or to itself."""
    least = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
    return edges.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges (a, b), a > b: a node and its smaller neighbours go to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("edge"))
    return moved.select("edge.a", "edge.b").where("a <> b").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """edges (a, b), any orientation -> (node, component): component is the least node reachable.

    Nodes without edges do not appear.  Loops and repeated edges do no harm; null ends are dropped.
    An empty edge table gives an empty result.  Each half of a step and the result are tables, so
    that no plan holds another one several times: the driver pays for plans, however small the edges.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark, step = scratch.table(f"{name}0", now), None, 0
    while True:
        step += 1
        half = scratch.table(f"{name}{step}_half", _large_star(now))
        scratch.drop(f"{name}{step - 1}")
        after = scratch.table(f"{name}{step}", _small_star(half))
        scratch.drop(f"{name}{step}_half")
        seen = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first()
        if tuple(seen) == mark:
            break
        now, mark = after, tuple(seen)
    found = scratch.table(name, after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
    scratch.drop(f"{name}{step}")
    return found
