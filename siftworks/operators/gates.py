"""Validation as data: every violated constraint is a row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def violations(df: DataFrame, identity: str, rules: Mapping[str, Column]) -> DataFrame:
    """(identity, rule) for each row and rule that does not hold; a rule that is null does not hold."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.select(F.col(identity), F.explode(broken).alias("rule"))


def enforced(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """df, failing at the first row that breaks a rule."""
    for name, ok in rules.items():
        df = df.where(F.coalesce(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit(f"rule {name} does not hold")).isNull(), F.lit(True)))
    return df


def grid_gaps(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the expected grid that are missing, and observed ones that are repeated or not expected."""
    lost = expected.select(*keys).distinct().join(observed, keys, "left_anti").withColumn("problem", F.lit("missing"))
    twice = observed.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("repeated").alias("problem"))
    extra = observed.select(*keys).distinct().join(expected, keys, "left_anti").withColumn("problem", F.lit("unexpected"))
    return lost.unionByName(twice).unionByName(extra)


def decided(scores: Mapping[str, Column], thresholds: list[tuple[str, float]], default: str) -> Column:
    """The first name, in order, whose score reaches its threshold."""
    out = F.lit(default)
    for name, least in reversed(thresholds):
        out = F.when(F.coalesce(scores[name], F.lit(0.0)) >= least, name).otherwise(out)
    return out
