"""Sessions by gaps, splits by hash, and checks that splits share no session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftworks.functions.text import sha256
from siftworks.operators.ranking import SLICES, same_keys, with_slices


def gap_sessions(df: DataFrame, keys: list[str], time: str, tie: str, gap_seconds: float = 120, slices: int = SLICES) -> DataFrame:
    """df with session (a running number from 0) and session_id in each key.

    Rows go by time, null last, then tie.  A row starts a session if it is the first, has no time, or
    comes more than gap_seconds after the last row that has one.  Keys are cut into slices of time:
    the last time before a slice and the sessions before it come from a small table.
    """
    cut = with_slices(df.withColumn("_us", F.unix_micros(F.col(time).cast("timestamp"))), "_us", slices)
    inside = Window.partitionBy(*keys, "_slice").orderBy("_us", tie)
    before = Window.partitionBy(*(f"_k_{k}" for k in keys)).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    copies = [F.col(k).alias(f"_k_{k}") for k in keys]
    ends = cut.groupBy(*keys, "_slice").agg(F.max("_us").alias("_max")).select(*copies, F.col("_slice").alias("_s"), "_max")
    ends = ends.withColumn("_carried", F.max("_max").over(before)).drop("_max")
    last = F.coalesce(F.lag("_us").over(inside), F.col("_carried"))
    starts = F.col("_us").isNull() | last.isNull() | (F.col("_us") - last > int(gap_seconds * 1_000_000))
    here = (F.col("_slice") == F.col("_s")) & same_keys(keys, "_k_")
    marked = cut.join(ends, here).withColumn("_start", starts.cast("long")).select(*df.columns, "_us", "_slice", "_start")
    sums = marked.groupBy(*keys, "_slice").agg(F.sum("_start").alias("_sum")).select(*copies, F.col("_slice").alias("_s"), "_sum")
    sums = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = F.sum("_start").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    numbered = marked.withColumn("_within", within).join(sums, here).withColumn("session", (F.col("_within") + F.col("_offset") - 1).cast("long"))
    seed = F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.col("session").cast("string"))
    return numbered.select(*df.columns, "session", F.substring(sha256(seed), 1, 16).alias("session_id"))


def leaking_sessions(df: DataFrame, session: str, split: str) -> DataFrame:
    """Sessions with rows in more than one split."""
    return df.groupBy(session).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def split_counts(df: DataFrame, split: Column) -> DataFrame:
    return df.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"))
