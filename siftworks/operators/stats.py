"""Statistics over samples: distributions, histograms, differences, robust scales and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftworks.operators.ranking import percentiles, running, same_keys, slice_bounds

#: Names and percentiles of the nine-number summary.
NINE = {"black_point": 0.005, "p02": 0.02, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "high_key": 0.95, "p98": 0.98, "white_point": 0.995}


def finite(x: Column) -> Column:
    """x where it is a finite number, else null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def nine_number(df: DataFrame, keys: list[str], value: Column, mask: Column | None = None) -> DataFrame:
    """Exact interpolated percentiles of the finite values of each key; with none, zeros and high_key 1."""
    used = finite(value.cast("double"))
    used = used if mask is None else F.when(mask, used)
    found = percentiles(df.select(*keys, used.alias("_v")), keys, "_v", NINE)
    every = df.select(*(F.col(k).alias(f"_e_{k}") for k in keys)).distinct()
    pick = [F.coalesce(name, F.lit(1.0 if name == "high_key" else 0.0)).alias(name) for name in NINE]
    return every.join(found, same_keys(keys, "_e_"), "left").select(*(F.col(f"_e_{k}").alias(k) for k in keys), F.coalesce("n", F.lit(0)).cast("long").alias("n"), *pick)


def histogram(df: DataFrame, keys: list[str], value: str, bins: int, low: str, high: str) -> DataFrame:
    """Counts and means by bin least(floor(bins * (x - low) / (high - low)), bins - 1); low and high are columns."""
    at = F.least(F.floor(bins * F.try_divide(F.col(value) - F.col(low), F.col(high) - F.col(low))), F.lit(bins - 1))
    return df.groupBy(*keys, F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def threshold_bin(binned: DataFrame, keys: list[str], fraction: float) -> DataFrame:
    """The first bin of each key whose cumulative count exceeds floor(total * fraction).  Windows are over bins only."""
    order = Window.partitionBy(*keys).orderBy("bin")
    total = F.sum("n").over(Window.partitionBy(*keys))
    marked = binned.withColumn("cumulative", F.sum("n").over(order)).withColumn("_goal", F.floor(total * fraction))
    return marked.where("cumulative > _goal").groupBy(*keys).agg(F.min_by(F.struct("bin", "cumulative", "mean"), "bin").alias("_b")).select(*keys, "_b.*")


def difference_metrics(df: DataFrame, keys: list[str], value: str, reference: str) -> DataFrame:
    """mean_abs, max_abs, rmse and psnr with peak max(1, max |reference|); psnr is null for equal series."""
    gap = F.col(value) - F.col(reference)
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(gap)).alias("mean_abs"), F.max(F.abs(gap)).alias("max_abs"), F.avg(gap * gap).alias("_mse"), F.max(F.abs(F.col(reference))).alias("_top"))
    psnr = F.when(F.col("_mse") > 0, 20 * F.log10(F.greatest(F.lit(1.0), "_top")) - 10 * F.log10(F.when(F.col("_mse") > 0, F.col("_mse")).otherwise(F.lit(1.0))))
    return found.select(*keys, "n", "mean_abs", "max_abs", F.sqrt("_mse").alias("rmse"), psnr.alias("psnr"))


def pooled(df: DataFrame, keys: list[str], rmse: str, weight: str) -> DataFrame:
    """Component-weighted RMSE over groups."""
    return df.groupBy(*keys).agg(F.sqrt(F.try_divide(F.sum(F.col(rmse) ** 2 * F.col(weight)), F.sum(weight))).alias("rmse"))


def micro_macro(df: DataFrame, group: str, error: str) -> DataFrame:
    """Mean error over rows, and the mean of the groups' means."""
    each = df.groupBy(group).agg(F.avg(error).alias("_mean"), F.sum(error).alias("_sum"), F.count(error).alias("_n"))
    return each.agg((F.sum("_sum") / F.sum("_n")).alias("micro"), F.avg("_mean").alias("macro"), F.max("_mean").alias("worst"), F.count(F.lit(1)).alias("groups"))


def robust_scale(df: DataFrame, keys: list[str], value: str, quantile: float = 0.9, least: float = 1e-3) -> DataFrame:
    """Median and quantile of |x - median| of each key; a scale below least is inactive."""
    bounds = slice_bounds(df, value)
    around = sorted({abs(b - bounds[len(bounds) // 2]) for b in bounds})  # near the quantiles of the distances, without a pass to find them
    centre = percentiles(df, keys, value, {"median": 0.5}, bounds=bounds).drop("n")
    gaps = df.join(centre, keys).select(*keys, "median", F.abs(F.col(value) - F.col("median")).alias("_gap"))
    found = percentiles(gaps, [*keys, "median"], "_gap", {"scale": quantile}, bounds=around).drop("n")
    return found.withColumn("active", F.col("scale") >= least)


def summary(df: DataFrame, keys: list[str], wall: str, memory: str) -> DataFrame:
    """Benchmark summary of each case."""
    walls = percentiles(df, keys, wall, {"median_wall": 0.5, "p95_wall": 0.95})
    return walls.join(percentiles(df, keys, memory, {"median_memory": 0.5, "max_memory": 1.0}).drop("n"), keys)


def receipt(df: DataFrame, keys: list[str], status: str, names: list[str]) -> DataFrame:
    """Rows of each key, in all and by status."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("processed"), *(F.count_if(F.col(status) == n).alias(n) for n in names))


def trimmed_anchor(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows ranked by order, ranks [n // 5, 4n // 5) kept; the upper median of value among them.  Ranks are taken in slices."""
    one = df.select(*keys, order, value, F.lit(1).cast("long").alias("_one"))
    ranked = running(one, keys, [order, value], "_one", "_rank", total="_n")
    kept = ranked.where((F.col("_rank") - 1 >= F.floor(F.col("_n") / 5)) & (F.col("_rank") - 1 < F.floor(F.col("_n") * 4 / 5))).select(*keys, value, "_one")
    placed = running(kept, keys, [value], "_one", "_at", total="_m")
    return placed.where(F.col("_at") - 1 == F.floor(F.col("_m") / 2)).select(*keys, F.col(value).alias("anchor"), F.col("_m").alias("kept"))


def local_regression(df: DataFrame, keys: list[str], x: str, y: str, held_out: Column) -> DataFrame:
    """Line of y on x from the rows not held out; correlation, and mean absolute error on those that are."""
    train = df.where(~held_out)
    fit = train.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("correlation"))
    error = df.where(held_out).join(fit, keys).groupBy(*keys).agg(F.avg(F.abs(F.col(y) - F.col("intercept") - F.col("slope") * F.col(x))).alias("held_out_mae"))
    return fit.join(error, keys, "left")


def edge_to_flat(df: DataFrame, gradient: str, value: str) -> DataFrame:
    """Mean value where the gradient is at or over its q95, over the mean where it is at or under its q50."""
    q = percentiles(df.select(F.lit(0).alias("_all"), gradient), ["_all"], gradient, {"_mid": 0.5, "_top": 0.95}).select("_mid", "_top")
    both = df.join(F.broadcast(q))  # one row
    found = both.agg(F.avg(F.when(F.col(gradient) >= F.col("_top"), F.col(value))).alias("edge"), F.avg(F.when(F.col(gradient) <= F.col("_mid"), F.col(value))).alias("flat"))
    return found.withColumn("ratio", F.try_divide("edge", "flat"))


def budget_report(reference: DataFrame, current: DataFrame, key: str, value: str, fraction: float, absolute: float) -> DataFrame:
    """Each reference case with its budget and whether the current value meets it; a missing one does not."""
    now = current.select(key, F.col(value).alias("current"))
    limit = F.greatest(F.col(value) * (1 + fraction), F.col(value) + absolute)
    out = reference.select(key, F.col(value).alias("reference"), limit.alias("budget")).join(now, key, "left")
    verdict = F.when(F.col("current").isNull(), "missing").when(F.col("current") <= F.col("budget"), "pass").otherwise("fail")
    return out.withColumn("verdict", verdict)


def quantised(df: DataFrame, value: str, levels: int = 255) -> DataFrame:
    """df with code: value between the table's least and largest, in steps of 1 / levels."""
    ends = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    share = F.try_divide(F.col(value) - F.col("_low"), F.col("_high") - F.col("_low"))
    return df.join(F.broadcast(ends)).withColumn("code", F.coalesce(F.round(share * levels), F.lit(0)).cast("int")).drop("_low", "_high")  # one row is sent


def clipped(df: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """How many values lie below and above, and the mean of the clamped ones."""
    x = F.col(value)
    return df.groupBy(*keys).agg(F.count_if(x < low).alias("below"), F.count_if(x > high).alias("above"), F.avg(F.greatest(F.lit(low), F.least(F.lit(high), x))).alias("mean"))


def best_of(df: DataFrame, keys: list[str], score: str, tie: str, values: list[str]) -> DataFrame:
    """The row of the highest score of each key; of equals the least tie."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(F.col(score), -F.col(tie))).alias("_v")).select(*keys, "_v.*")


def agreement(df: DataFrame, keys: list[str], order: str, value: str, share: float = 0.2, least: int = 3, most: int = 128) -> DataFrame:
    """Median of each key's short series and whether it is usable: least to most samples, and all within share of the median."""
    centre = percentiles(df, keys, value, {"median": 0.5})
    gap = F.abs(F.try_divide(F.col(value), F.col("median")) - 1)
    worst = df.join(centre, keys).groupBy(*keys).agg(F.max(gap).alias("worst"), F.count_distinct(order).alias("_times"))
    ok = F.col("n").between(least, most) & (F.col("worst") <= share) & (F.col("_times") == F.col("n"))
    return centre.join(worst, keys).select(*keys, "n", "median", "worst", ok.alias("usable"))


def headroom(samples: Column) -> Column:
    """max(1, largest sample)."""
    return F.greatest(F.lit(1.0), F.coalesce(F.array_max(samples).cast("double"), F.lit(1.0)))


def coverage(mask: Column, top: float = 255.0) -> Column:
    """Mean of the mask over top; 0 for a missing or empty mask."""
    total = F.aggregate(mask, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return F.coalesce(F.try_divide(total, F.size(mask) * top), F.lit(0.0))


def bin_medians(df: DataFrame, keys: list[str], x: str, y: str, bins: int) -> DataFrame:
    """Median of y and count in bins of x over each key's 2 % to 98 % range, values outside in the end bins."""
    ends = percentiles(df, keys, x, {"_low": 0.02, "_high": 0.98}).drop("n")
    at = F.floor(F.try_divide(F.col(x) - F.col("_low"), F.col("_high") - F.col("_low")) * bins)
    placed = df.join(ends, keys).select(*keys, F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(at, F.lit(0)))).cast("int").alias("bin"), y)
    return percentiles(placed, [*keys, "bin"], y, {"median": 0.5})
