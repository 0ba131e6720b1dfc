"""Mixing sources to target weights by entropy balancing.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words; a
target stops at ``most`` times its source's words and the excess goes to the others by weight.

Rates: of all document rates r with sum(r * size) = target in each source, the one nearest to
"every document once" in relative entropy is an exponential tilt, r = exp(tilt * size), held to
``most``.  The tilt is the root of the convex dual's gradient.  Newton steps, kept inside a
bracket, run as aggregations over the table of (source, size, how many documents): no step reads
the documents again or gathers a source in one place.

Copies: inside groups of bounded size, from the longest document down, each document gets the
whole number of copies that brings the words taken so far nearest to the words its rates ask for.
The error that is left is below the size of a group's shortest documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftworks.llm.scratch import Scratch

MOST = 3.0
GROUP = 500  # documents that are rounded together, about
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """The source as a join key: never null, and sorted like the source with null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def targets(sources: DataFrame, most: float = MOST) -> DataFrame:
    """(key, words) -> key, words, target.  One row per source."""
    ranked = sources.withColumn("weight", (F.row_number().over(Window.orderBy("key")) - 1) % 3 + 1.0)
    ranked = ranked.withColumn("top", F.lit(most) * F.col("words"))
    rising = Window.orderBy(F.col("top") / F.col("weight"), "key")
    upto, every = rising.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    before = F.sum("words").over(every) - (F.sum("top").over(upto) - F.col("top"))
    left = F.sum("weight").over(every) - (F.sum("weight").over(upto) - F.col("weight"))
    # Sources come in the order in which they reach their limit; the first that would not sets the level of the rest.
    stepped = ranked.withColumn("level", before / left).withColumn("held", F.col("top") < F.col("level") * F.col("weight"))
    level = F.first(F.when(~F.col("held"), F.col("level")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return stepped.select("key", "words", F.least("top", level * F.col("weight")).alias("target"))


def _rate(tilt: Column, x: Column, most: float) -> Column:
    return F.least(F.lit(most), F.exp(F.least(tilt * x, F.lit(50.0))))


def tilts(cells: DataFrame, goals: DataFrame, scratch: Scratch, most: float = MOST, tolerance: float = 1e-6, rounds: int = 60) -> DataFrame:
    """cells (key, size, n), goals (key, words, n_docs, target) of the same keys -> goals with tilt and scale.

    The exponent is tilt * size / scale, scale being the source's mean size.
    """
    base = goals.withColumn("scale", F.greatest(F.col("words") / F.col("n_docs"), F.lit(1.0)))
    start = base.select("*", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.log(F.greatest(F.col("target") / F.greatest("words", F.lit(1)), F.lit(1e-3))))).alias("tilt"), F.lit(-1e4).alias("low"), F.lit(1e4).alias("high"), F.lit(False).alias("done"))
    now = scratch.table("tilt0", start)
    x = F.col("size") / F.col("scale")
    for i in range(1, rounds + 1):
        rate = _rate(F.col("tilt"), x, most)
        words = F.col("n") * F.col("size")
        # a key's row is the same in all its cells, so the sums are grouped by the row: nothing is joined back
        step = cells.join(now, "key").groupBy(*now.columns).agg(F.sum(words * rate).alias("got"), F.sum(F.when(rate < most, words * x * rate).otherwise(0.0)).alias("slope"))
        gap = F.col("got") - F.col("target")
        step = step.withColumns({"low": F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), "high": F.when(gap > 0, F.col("tilt")).otherwise(F.col("high")), "done": F.col("done") | (F.abs(gap) <= tolerance * F.greatest("target", F.lit(1.0)))})
        newton = F.col("tilt") - F.try_divide(gap, F.col("slope"))
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high")) & (F.abs(newton - F.col("tilt")) < 4 + F.abs("tilt"))
        far = F.when(gap > 0, F.greatest(F.col("tilt") * 2 - 2, F.col("low"))).otherwise(F.least(F.col("tilt") * 2 + 2, F.col("high")))
        middle = F.when((F.col("low") > -1e4) & (F.col("high") < 1e4), (F.col("low") + F.col("high")) / 2).otherwise(far)
        moved = F.when(F.col("done"), F.col("tilt")).when(inside, newton).otherwise(middle)
        now = scratch.table(f"tilt{i}", step.withColumn("tilt", moved).select(now.columns))
        scratch.drop(f"tilt{i - 1}")
        if now.where(~F.col("done")).isEmpty():
            break
    return now


def _round(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    rows = rows.sort_values(["size", "mark", "id"], ascending=[False, True, True], kind="stable")
    copies, owed = [], 0.0
    for size, rate in zip(rows["size"].tolist(), rows["rate"].tolist(), strict=True):
        if size <= 0:
            copies.append(1)
            continue
        owed += rate * size
        k = min(most, max(0, int(owed / size + 0.5)))
        owed -= k * size
        copies.append(k)
    return rows.assign(copies=copies)[["id", "key", "size", "rate", "copies"]]


def mix(sizes: DataFrame, most: float = MOST, group: int = GROUP) -> DataFrame:
    """sizes (id, source, size) -> (id, size, source_size, target, rate, copies, taken), one row each.

    taken = copies * size.  A document without words keeps one copy and takes nothing.  Null sources
    are one source, the last; null ids and repeated rows are documents like any other, and equal
    rows may swap copies; rows without an id are dealt to rounding groups by their place in the input.  An empty table gives an empty result.  Results do not depend on how rows
    are dealt to tasks.
    """
    scratch = Scratch(sizes.sparkSession)
    rows = scratch.table("sizes", sizes.select("id", source_key(F.col("source")).alias("key"), F.col("size").cast("long").alias("size"), F.when(F.col("id").isNull(), F.monotonically_increasing_id()).alias("tag")))
    cells = scratch.table("cells", rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")))
    per_source = cells.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("n_docs"))
    goals = targets(per_source.select("key", "words"), most).join(per_source.drop("words"), "key")
    solved = tilts(cells, goals, scratch, most)
    full = F.col("target") >= most * F.col("words") * (1 - 1e-12)
    rate = F.when(full, F.lit(most)).otherwise(_rate(F.col("tilt"), F.col("size") / F.col("scale"), most))
    mark = F.xxhash64("id", "size", "tag")
    dealt = rows.join(solved, "key").select("id", "key", "size", rate.alias("rate"), mark.alias("mark"), F.pmod(mark, F.ceil(F.col("n_docs") / group)).alias("part"))
    scratch.hold()
    whole = int(most)
    kind = dict(rows.dtypes)["id"]
    copies = dealt.groupBy("key", "part").applyInPandas(lambda pdf: _round(pdf, whole), f"id {kind}, key string, size long, rate double, copies long")
    return copies.join(solved.select("key", F.col("words").alias("source_size"), "target"), "key").select("id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
