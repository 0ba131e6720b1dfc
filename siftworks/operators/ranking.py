"""Ranks, running sums and exact percentiles inside keys of any size.

A window over a key puts all its rows in one task.  Here rows are first cut into slices of the
order column; a window runs inside (key, slice), and what lies in the slices before it comes from a
small table of sums.  A key with a third of all rows is spread over as many tasks as there are slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SLICES = 64
SHARE = 0.02  # of the rows, to choose the bounds of slices from


def slice_bounds(df: DataFrame, order: str, slices: int = SLICES, share: float = SHARE) -> list[float]:
    """Approximate quantiles of a sample of the order column; any bounds are right, even ones are fast."""
    if slices < 2:
        return []
    return sorted(set(df.select(order).sample(share, 7).approxQuantile(order, [i / slices for i in range(1, slices)], 0.25 / slices)))


def _search(x: Column, bounds: list[float], first: int = 0) -> Column:
    """How many bounds lie below x, as nested comparisons."""
    if not bounds:
        return F.lit(first)
    m = len(bounds) // 2
    return F.when(x <= bounds[m], _search(x, bounds[:m], first)).otherwise(_search(x, bounds[m + 1 :], first + m + 1))


def with_slices(df: DataFrame, order: str, slices: int = SLICES, bounds: list[float] | None = None, name: str = "_slice") -> DataFrame:
    """df with the slice of its order column; nulls are in the last one."""
    bounds = slice_bounds(df, order, slices) if bounds is None else bounds
    return df.withColumn(name, F.when(F.col(order).isNull(), len(bounds) + 1).otherwise(_search(F.col(order), bounds)))


def same_keys(keys: list[str], prefix: str) -> Column:
    """Null-safe equality of keys with their copies prefix + key."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return out


def running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, slices: int = SLICES, total: str | None = None, bounds: list[float] | None = None) -> DataFrame:
    """df with name = sum of value over the key's rows up to this one, and total = the key's whole sum.

    order[0] is numeric; order is unique in a key.
    """
    cut = with_slices(df, order[0], slices, bounds)
    sums = cut.groupBy(*keys, "_slice").agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*(f"_k_{k}" for k in keys))
    renamed = sums.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_slice").alias("_s"), "_sum")
    offsets = renamed.select(
        *(f"_k_{k}" for k in keys), "_s", F.sum("_sum").over(over).alias("_run_total"),
        F.coalesce(F.sum("_sum").over(over.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_run_before"),
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = cut.withColumn(name, F.sum(value).over(inside))
    out = part.join(offsets, (F.col("_slice") == F.col("_s")) & same_keys(keys, "_k_")).withColumn(name, F.col(name) + F.col("_run_before"))
    return out.select(*df.columns, name, *([F.col("_run_total").alias(total)] if total else []))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "rank", slices: int = SLICES) -> DataFrame:
    """df with the row's number, from 1, in its key."""
    out = running(df.withColumn("_one", F.lit(1).cast("long")), keys, order, "_one", name, slices)
    return out.drop("_one")


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], slices: int = SLICES, bounds: list[float] | None = None) -> DataFrame:
    """keys, n and exact linearly interpolated percentiles of the non-null values of each key.

    Equal values are counted, counts are summed in slices, and each percentile is the least value
    whose running count passes its place: no task holds the values of a key.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    bounds = slice_bounds(df.select(F.col(value).cast("double").alias("_x")), "_x", slices) if bounds is None else bounds
    ranked = running(counted, keys, ["_x"], "_n", "_c", slices, "_of", bounds)
    ends = []
    for i, p in enumerate(wanted.values()):
        place = (F.col("_of") - 1) * p
        ends += [F.min(F.when(F.col("_c") > F.floor(place), F.col("_x"))).alias(f"_low{i}"), F.min(F.when(F.col("_c") > F.ceil(place), F.col("_x"))).alias(f"_high{i}")]
    found = ranked.groupBy(*keys).agg(F.max("_of").alias("n"), *ends)
    share = lambda p: (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)
    return found.select(*keys, "n", *((F.col(f"_low{i}") * (1 - share(p)) + F.col(f"_high{i}") * share(p)).alias(name) for i, (name, p) in enumerate(wanted.items())))


def shifted(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, ahead: bool = False, slices: int = SLICES) -> DataFrame:
    """df with name = value of the row before (or, ahead, after) in the key, null at its end.

    Inside a slice this is a window; the first row of a slice takes the last value of the slice
    before it that has rows.  order[0] is numeric and not null, order is unique in a key.
    """
    cut = with_slices(df, order[0], slices)
    one, place = F.struct(F.col(value).alias("v")), F.struct(*order)
    edge = F.min_by(one, place) if ahead else F.max_by(one, place)
    edges = cut.groupBy(*keys, "_slice").agg(edge.alias("_edge")).select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_slice").alias("_s"), "_edge")
    along = Window.partitionBy(*(f"_k_{k}" for k in keys)).orderBy("_s")
    edges = edges.select(*(f"_k_{k}" for k in keys), "_s", (F.lead("_edge") if ahead else F.lag("_edge")).over(along).alias("_over"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    near = (F.lead(one) if ahead else F.lag(one)).over(inside)
    out = cut.withColumn("_near", near).join(edges, (F.col("_slice") == F.col("_s")) & same_keys(keys, "_k_"))
    return out.select(*df.columns, F.coalesce("_near", "_over")["v"].alias(name))


def carried(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, ahead: bool = False, slices: int = SLICES, bounds: list[float] | None = None) -> DataFrame:
    """df with name = the last non-null value of the key up to this row (ahead: the first from it on); null where there is none.

    order[0] is numeric and not null, order is unique in a key.
    """
    cut = with_slices(df, order[0], slices, bounds)
    one = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v")))
    place = F.when(one.isNotNull(), F.struct(*order))
    edge = (F.min_by if ahead else F.max_by)(one, place)
    edges = cut.groupBy(*keys, "_slice").agg(edge.alias("_edge")).select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_slice").alias("_s"), "_edge")
    along = Window.partitionBy(*(f"_k_{k}" for k in keys)).orderBy("_s")
    far = F.first("_edge", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)) if ahead else F.last("_edge", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.withColumn("_over", far).drop("_edge")
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    near = F.first(one, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)) if ahead else F.last(one, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    out = cut.withColumn("_near", near).join(edges, (F.col("_slice") == F.col("_s")) & same_keys(keys, "_k_"))
    return out.select(*df.columns, F.coalesce("_near", "_over")["v"].alias(name))


def running_maximum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, slices: int = SLICES) -> DataFrame:
    """df with name = the largest value of the key up to this row."""
    cut = with_slices(df, order[0], slices)
    tops = cut.groupBy(*keys, "_slice").agg(F.max(value).alias("_top")).select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_slice").alias("_s"), "_top")
    along = Window.partitionBy(*(f"_k_{k}" for k in keys)).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_before", F.max("_top").over(along)).drop("_top")
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumn("_here", F.max(value).over(inside)).join(tops, (F.col("_slice") == F.col("_s")) & same_keys(keys, "_k_"))
    return out.select(*df.columns, F.greatest("_here", "_before").alias(name))


def numeric_order(df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
    """df and order with a leading time or date as microseconds in column _us."""
    kind = dict(df.dtypes)[order[0]]
    if kind.startswith(("timestamp", "date")):
        return df.withColumn("_us", F.unix_micros(F.col(order[0]).cast("timestamp"))), ["_us", *order[1:]]
    return df, order
