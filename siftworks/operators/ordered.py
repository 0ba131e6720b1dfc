"""Computations along an order: journals, steps, runs, gaps and first wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftworks.operators.ranking import carried, numbered, numeric_order, running, shifted, slice_bounds


def replay(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row of each key by order (last write wins), by aggregation: no key is gathered."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, "_v.*")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*keys, "_v.*").select(*df.columns)


def steps(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """df with delta, the next value less this one; null at the end of a key."""
    numeric, by = numeric_order(df, [order])
    return shifted(numeric, keys, by, value, "_next", ahead=True).select(*df.columns, (F.col("_next") - F.col(value)).alias("delta"))


def step_score(stepped: DataFrame, keys: list[str], epsilon: float = 0.0) -> DataFrame:
    """Largest and mean |delta|, and whether steps go one way only, up to epsilon."""
    up, down = F.bool_or(F.col("delta") > epsilon), F.bool_or(F.col("delta") < -epsilon)
    return stepped.groupBy(*keys).agg(F.count("delta").alias("steps"), F.max(F.abs("delta")).alias("max_step"), F.avg(F.abs("delta")).alias("mean_step"), (~(F.coalesce(up, F.lit(False)) & F.coalesce(down, F.lit(False)))).alias("monotone"))


def strictly_increasing(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    numeric, by = numeric_order(df, [order])
    last = shifted(numeric, keys, by, value, "_last")
    return last.withColumn("_ok", F.coalesce(F.col(value) > F.col("_last"), F.lit(True))).groupBy(*keys).agg(F.bool_and("_ok").alias("increasing"))


def islands(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Maximal runs of one state: keys, run (from 0), state, first and last of order[0], length."""
    numeric, by = numeric_order(df.withColumn("_here", F.struct(F.col(state).alias("s"))), order)
    marked = shifted(numeric, keys, by, "_here", "_last_state").withColumn("_new", (~F.col("_here").eqNullSafe(F.col("_last_state"))).cast("long"))
    numbered = running(marked, keys, by, "_new", "_run").withColumn("run", F.col("_run") - 1)
    return numbered.groupBy(*keys, "run").agg(F.first(state).alias(state), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("length"))


def interpolated(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """df with filled: value, or the line between the nearest rows that have one, or the nearest at the ends.

    The nearest rows are carried along in slices, so a key may have any number of rows.
    """
    bounds = slice_bounds(df, at)
    known = df.withColumn("_known", F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("x"), F.col(value).alias("y"))))
    both = carried(carried(known, keys, [at], "_known", "_behind", bounds=bounds), keys, [at], "_known", "_ahead", ahead=True, bounds=bounds)
    x0, y0, x1, y1 = (F.col(side)[c] for side in ("_behind", "_ahead") for c in ("x", "y"))
    line = y0 + (y1 - y0) * F.try_divide(F.col(at) - x0, x1 - x0)
    return both.select(*df.columns, F.coalesce(F.col(value), line, y0, y1).alias("filled"))


def strided(df: DataFrame, position: str, total: int, most: int) -> DataFrame:
    """Every k-th row, k = max(1, total // most)."""
    return df.where(F.pmod(F.col(position), F.lit(max(1, total // most))) == 0)


def positional_parity(left: DataFrame, right: DataFrame, track: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Rows of two tables paired by their number in each track: track, position, equal (false where one is missing)."""

    def place(df: DataFrame, side: str) -> DataFrame:
        numeric, by = numeric_order(df, order)
        return numbered(numeric, track, by, "_place").select(*track, (F.col("_place") - 1).cast("int").alias("position"), F.struct(*values).alias(side))

    both = place(left, "_a").join(place(right, "_b"), [*track, "position"], "full")
    return both.select(*track, "position", (F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))).alias("equal"))


def key_comparison(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys of either table with both values and which side lacks the key."""
    a, b = left.select(*keys, F.col(value).alias("before")), right.select(*keys, F.col(value).alias("after"))
    lacks = F.when(F.col("before").isNull(), "before").when(F.col("after").isNull(), "after").otherwise("none")
    return a.join(b, keys, "full").withColumn("lacks", lacks)
