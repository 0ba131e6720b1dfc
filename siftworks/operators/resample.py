"""Cluster bootstrap with exact draws: each round draws as many clusters as there are.

Drawing C of C clusters with replacement is a multinomial count vector.  It is dealt down a tree of
hash seeds: the draws of a range of clusters go to its left half in a binomial number, the rest to
its right half.  Seeds depend on the round and the range alone, so any task finds the counts of a
block of clusters by walking down from the top, and the counts of all blocks add up to C without
any task having seen the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftworks.operators.placement import in_order

BLOCK = 1024  # clusters of a block


def _seeded(*parts: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([p & 0xFFFFFFFF for part in parts for p in (part, part >> 32)])))


def block_draws(block: int, clusters: int, rounds: int, seed: int, size: int = BLOCK) -> np.ndarray:
    """rounds x clusters of the block: how often each is drawn."""
    low, high = 0, -(-clusters // size)  # in blocks
    n = np.full(rounds, clusters, np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        share = (min(mid * size, clusters) - low * size) / (min(high * size, clusters) - low * size)
        left = _seeded(seed, low, high).binomial(n, share)
        low, high, n = (low, mid, left) if block < mid else (mid, high, n - left)
    width = min((block + 1) * size, clusters) - block * size
    return _seeded(seed, block, -1).multinomial(n, np.full(width, 1 / width))


def bootstrap_rounds(df: DataFrame, cluster: str, value: str, rounds: int = 200, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """df (cluster, value) -> round, draws, n, total: sums over the clusters drawn in each round, repeats counted.

    draws is the number of clusters in every round.  A null cluster is one of them; null values count 0.
    """
    sums = df.groupBy(F.col(cluster).alias("_cluster")).agg(F.sum(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    placed = in_order(sums, ["_cluster"], "_place")
    size = placed.agg(F.max("_place").alias("_clusters"))  # one row
    cut = placed.join(F.broadcast(size)).select((F.floor((F.col("_place") - 1) / block)).cast("long").alias("_block"), ((F.col("_place") - 1) % block).alias("_at"), "_sum", "_n", "_clusters")

    def run(rows: pa.Table) -> pa.Table:
        at = rows.column("_at").to_numpy()
        drawn = block_draws(rows.column("_block")[0].as_py(), rows.column("_clusters")[0].as_py(), rounds, seed, block)[:, at]
        return pa.table({"round": pa.array(np.arange(rounds), pa.int64()), "draws": drawn.sum(axis=1), "n": drawn @ rows.column("_n").to_numpy(), "total": drawn @ rows.column("_sum").to_numpy()})

    parts = cut.groupBy("_block").applyInArrow(run, "round long, draws long, n long, total double")
    return parts.groupBy("round").agg(F.sum("draws").alias("draws"), F.sum("n").alias("n"), F.sum("total").alias("total"))


def interval(rounds: DataFrame) -> DataFrame:
    """2.5 %, 50 % and 97.5 % of the rounds' means, and how often they are positive; rounds are a parameter, so few."""
    means = rounds.select((F.col("total") / F.col("n")).alias("mean"))
    return means.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.5).alias("middle"), F.percentile("mean", 0.975).alias("high"), F.avg((F.col("mean") > 0).cast("double")).alias("improved"))
