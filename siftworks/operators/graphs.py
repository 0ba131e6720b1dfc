"""Reference tables: closures, integrity, bags and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftworks.operators.lineage import cut_lineage
from siftworks.operators.placement import in_order


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, hops) of the nodes reachable from roots (node) over edges (a, b), roots included, with the fewest hops.

    Each round joins the nodes found last with the edges and keeps those not met before, until there
    are none: cycles and any depth are harmless.  What was found is written between rounds.
    """
    steps = edges.select(F.col("a").alias("_a"), F.col("b").alias("_b")).where("_a is not null and _b is not null").distinct()
    last = cut_lineage(roots.select("node").where("node is not null").distinct().withColumn("hops", F.lit(0)))
    found = last
    while not last.isEmpty():
        onward = last.join(steps, F.col("node") == F.col("_a")).select(F.col("_b").alias("node"), F.col("hops") + 1).toDF("node", "hops").distinct()
        last = cut_lineage(onward.join(found, "node", "left_anti"))
        found = found.unionByName(last)
    return found


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one bag has more often: side ('left' or 'right') and the columns, repeats kept."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key no parent row has; null keys are dangling."""
    keys = parent.select(F.col(parent_key).alias("_key")).distinct()
    return child.join(keys, child[child_key] == F.col("_key"), "left_anti")


def repeated_identities(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n) for values that occur more than once in one of the identity columns."""
    long = df.select(F.explode(F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f).cast("string"))))).alias("field", "value"))
    return long.where("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def outside_range(df: DataFrame, reference: DataFrame, keys: list[str], value: str, slack: float = 1e-9) -> DataFrame:
    """df with in_range: value lies in the reference group's [min - slack, max + slack]; null without a group."""
    bounds = reference.groupBy(*keys).agg((F.min(value) - slack).alias("_low"), (F.max(value) + slack).alias("_high"))
    return df.join(bounds, keys, "left").withColumn("in_range", F.col(value).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def on_curve(x: Column, nodes: list[tuple[float, float]]) -> Column:
    """Piecewise linear curve through nodes (rising x), constant outside."""
    out = F.lit(float(nodes[0][1]))
    for (x0, y0), (x1, y1) in zip(nodes, nodes[1:], strict=False):
        out = F.when(x > x0, y0 + (y1 - y0) * (F.least(x, F.lit(float(x1))) - x0) / (x1 - x0)).otherwise(out)
    return out


def shape_problems(edges: DataFrame, graph: str, source: str, target: str, ordinal: str, expected: list[str]) -> DataFrame:
    """Graphs whose one source does not point to exactly the expected targets in order: (graph, problem)."""
    lists = edges.groupBy(graph, source).agg(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, target))), lambda x: x[target]).alias("_targets"))
    each = lists.groupBy(graph).agg(F.count(F.lit(1)).alias("_sources"), F.first("_targets").alias("_targets"))
    wanted = F.array(*map(F.lit, expected))
    problem = F.when(F.col("_sources") != 1, "sources").when(F.size(F.array_distinct("_targets")) != F.size("_targets"), "repeated").when(F.col("_targets") != wanted, "targets")
    return each.select(graph, problem.alias("problem")).where("problem is not null")


def tile_problems(tiles: DataFrame, graph: str, tile: str, rows: str, cols: str, config: str) -> DataFrame:
    """Graphs whose tiles do not fill rows x cols, repeat, or differ in configuration."""
    each = tiles.groupBy(graph).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(tile).alias("_d"), F.count_distinct(config).alias("_c"), F.max(F.col(rows) * F.col(cols)).alias("_want"))
    problem = F.when(F.col("_n") != F.col("_want"), "count").when(F.col("_d") != F.col("_n"), "repeated").when(F.col("_c") > 1, "config")
    return each.select(graph, problem.alias("problem")).where("problem is not null")


FAN = 4096  # digests under one of the next level


def plan_digest(df: DataFrame, order: str, fields: list[str], fan: int = FAN) -> DataFrame:
    """One digest of a table in the order of a column, nulls first, ties by the rows' digests.

    A tree: rows are numbered in order and digested; each fan of them in a row are digested together,
    each fan of those likewise, and the digests that are left make the last one.  A list holds fan
    digests whatever the order's values are, the last one a row for each fan * fan.
    """
    row = F.sha2(F.concat_ws("", *(F.concat(F.length(F.col(f).cast("string")).cast("string"), F.lit(":"), F.col(f).cast("string")) for f in fields)), 256)
    level = in_order(df.select(F.col(order).alias("_o"), row.alias("_d")), ["_o", "_d"], "_at").select("_at", "_d")
    joined = lambda: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_d"))), lambda x: x["_d"]), ""), 256)
    for _ in range(2):
        level = level.groupBy((F.floor((F.col("_at") - 1) / fan) + 1).alias("_next")).agg(joined().alias("_d")).withColumnRenamed("_next", "_at")
    return level.agg(joined().alias("digest"))
