"""Keyed planning: destinations without conflicts, companions, reuse and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftworks.functions.text import sequenced_name
from siftworks.operators import placement
from siftworks.operators.ranking import numbered


def categorize(items: DataFrame, destination: list[str], fingerprint: str, order: str, stem: Column, extension: Column) -> DataFrame:
    """One resource per item, no files there yet: each new content gets the next number at its destination.

    items with sequence, file_name and disposition ('copy' for the first of a content, else 'duplicate').
    Contents are numbered by their first item in order.
    """
    first = items.groupBy(*destination, fingerprint).agg(F.min(order).alias("_first"))
    ranked = numbered(first, destination, ["_first"], "sequence")
    ranked = ranked.select(*(F.col(k).alias(f"_k_{k}") for k in (*destination, fingerprint)), "_first", "sequence")
    match = F.lit(True)
    for k in (*destination, fingerprint):
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = items.join(ranked, match).select(*items.columns, "_first", "sequence")
    return joined.withColumns({
        "file_name": sequenced_name(stem, extension, F.col("sequence")),
        "disposition": F.when(F.col(order) == F.col("_first"), "copy").otherwise("duplicate"),
    }).drop("_first")


def place_assets(resources: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The general rule: resources (directory, asset, path, name, fingerprint), all of an asset move together.  See placement."""
    return placement.place(resources, existing)


def companions(left: DataFrame, right: DataFrame, on: list[str], choose: str, name: str = "companion") -> DataFrame:
    """left with the least choose of its partners in right, null where there is none."""
    return left.join(right.groupBy(*on).agg(F.min(choose).alias(name)), on, "left")


def reusable(items: DataFrame, receipts: DataFrame, key: list[str], guard: list[str], status: str = "status") -> DataFrame:
    """items with reuse: a receipt of the same key exists, equal in every guard column, that succeeded or was skipped."""
    good = receipts.where(F.col(status).isin("success", "skipped_existing")).select(*key, *guard).distinct().withColumn("_hit", F.lit(True))
    return items.join(good, [*key, *guard], "left").withColumn("reuse", F.coalesce("_hit", F.lit(False))).drop("_hit")


def missing(required: DataFrame, available: DataFrame, on: list[str]) -> DataFrame:
    """Required rows that are not available; repeats are kept."""
    return required.join(available.select(*on).distinct(), on, "left_anti")
