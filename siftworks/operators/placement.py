"""Destinations without conflicts for assets of several files, by connected components.

The rule is serial: assets go in the order of their least path, and each takes the smallest number k
at which every one of its names, or name (k), is free or holds the same content already.  But two
assets can only meet if a directory and a root name, a name without its numbers, are common to both.
So assets and root names make a graph, and its components are placed side by side.

An asset that is equal in names and contents to an earlier one goes where that went, so only the
first of each is placed.  Where all assets of a component have the same plain names and no file is
there yet, the rule is a rank of contents, taken in slices: a directory full of one name is never in
one group.  The other components, those with files, numbers or different sets of names, are
replayed in order, as a stream of first assets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftworks.operators.lineage import scratch_folder
from siftworks.operators.ranking import numbered

_NUMBERS = r"( \(([2-9]|[1-9][0-9]+)\))+$"
_PARTS = r"^(.+)\.([^.]*)$"
_split = re.compile(_PARTS, re.S).match
_numbered = re.compile(r"(.*) \(([2-9]|[1-9][0-9]+)\)", re.S).fullmatch


def root_name(name: Column) -> Column:
    """The name without the numbers at the end of its stem: names that numbering can make equal have one root."""
    stem = F.when(name.rlike("(?s)" + _PARTS), F.regexp_extract(name, "(?s)" + _PARTS, 1)).otherwise(name)
    ending = F.when(name.rlike("(?s)" + _PARTS), F.concat(F.lit("."), F.regexp_extract(name, "(?s)" + _PARTS, 2))).otherwise(F.lit(""))
    return F.concat(F.regexp_replace(stem, _NUMBERS, ""), ending)


def with_number(name: str, k: int) -> str:
    if k == 1:
        return name
    parts = _split(name)
    return f"{parts[1]} ({k}).{parts[2]}" if parts else f"{name} ({k})"


def in_order(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """df with name = the row's number, from 1, in the order of all rows.

    Rows are sorted by range and numbered in their partition; the sizes of the partitions before,
    one row a partition, are broadcast.  Ties of order get numbers of their own.
    """
    held = df.sparkSession
    folder = scratch_folder(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(at + 1, at + n + 1), pa.int64())], names=[*batch.schema.names, "_part", "_at"])
            at += n

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", _part int, _at long"
    df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema).write.parquet(folder)
    placed = held.read.parquet(folder)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_at") + F.col("_before")).alias(name))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): the least node that links lead to.  Alternating star contraction;
    each round is written, and rounds end when one changes nothing."""
    spark = edges.sparkSession
    kept = lambda df: (lambda path: (df.write.parquet(path), spark.read.parquet(path))[1])(scratch_folder(spark))
    now = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = kept(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m").where("b <> m").toDF("a", "b").unionByName(least.toDF("a", "b"))
        after = kept(small.distinct())
        if after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        now = after


_FEW = 16  # numbers of one content at one name that are tried one by one


class _Slots:
    """What a component's destinations hold, and for a name and a content the numbers at which it stands."""

    def __init__(self) -> None:
        self.held: dict[tuple[str, str], str] = {}
        self.numbers: dict[tuple[str, str, str], list[int]] = {}
        self.free: dict[tuple[str, str], int] = {}  # the least number that may be free
        self.open: dict[tuple[str, tuple[str, ...], tuple[str | None, ...]], int] = {}  # the least that may suit names together

    def put(self, directory: str, name: str, content: str) -> bool:
        """Whether the destination was free."""
        if (directory, name) in self.held:
            return False
        self.held[directory, name] = content
        self.numbers.setdefault((directory, name, content), []).append(1)
        parts = _split(name)
        stem, ending = (parts[1], f".{parts[2]}") if parts else (name, "")
        if m := _numbered(stem):  # it is also what another name becomes
            self.numbers.setdefault((directory, m[1] + ending, content), []).append(int(m[2]))
        return True

    def smallest(self, directory: str, names: list[str], contents: list[str]) -> int:
        """The first number at which every name is free or holds its content.

        A content that stands at few numbers of its name is tried at these; elsewhere its name must be
        free.  A content that stands at many is not listed: its name may be free or hold it.  What suits
        names in this way only gets less as destinations fill, so a search goes on where the last one for
        the same names, and contents of the second kind, ended.
        """
        places = [self.numbers.get((directory, n, c), ()) for n, c in zip(names, contents, strict=True)]
        bound = max(_FEW, min(map(len, places)))
        rare = [len(p) <= bound for p in places]
        suits = lambda j: all(self.held.get((directory, with_number(n, j)), c) == c for n, c in zip(names, contents, strict=True))
        best = None
        for few, numbers in zip(rare, places, strict=True):
            for j in numbers if few else ():
                if (best is None or j < best) and suits(j):
                    best = j
        key = (directory, tuple(names), tuple(None if few else c for few, c in zip(rare, contents, strict=True)))
        k = max(self.open.get(key, 1), *(self._free(directory, n) for few, n in zip(rare, names, strict=True) if few))
        while (best is None or k < best) and not all(self.held.get((directory, with_number(n, k)), c) == c for n, c in zip(names, key[2], strict=True)):
            k += 1
        self.open[key] = k
        return k if best is None else min(k, best)

    def _free(self, directory: str, name: str) -> int:
        k = self.free.get((directory, name), 1)
        while (directory, with_number(name, k)) in self.held:
            k += 1
        self.free[directory, name] = k
        return k


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a component in order: files that are there, without a turn, then first assets."""
    now, slots = None, _Slots()
    schema = pa.schema([("first", pa.int64()), ("sequence", pa.int64()), ("copies", pa.list_(pa.bool_()))])
    for batch in batches:
        out = []
        for component, turn, directory, names, contents in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if component != now:
                now, slots = component, _Slots()
            k = 1 if turn is None else slots.smallest(directory, names, contents)
            copies = [slots.put(directory, with_number(n, k), c) for n, c in zip(names, contents, strict=True)]
            if turn is not None:
                out.append((turn, k, copies))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[], [], []], schema.types, strict=True)], schema=schema)


def place(resources: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """resources (directory, asset, path, name, fingerprint) -> directory, asset, path, name, sequence, disposition.

    All files of an asset get one number.  existing (directory, name, fingerprint) are files that are
    there; of two rows of one name the least fingerprint counts.  disposition is copy for the first
    of a content at its destination, else duplicate; error, without a number, for the files of an
    asset that has a name twice.  A null fingerprint is a content of its own kind, equal to other nulls.
    """
    spark = resources.sparkSession
    kept = lambda df: (lambda path: (df.write.parquet(path), spark.read.parquet(path))[1])(scratch_folder(spark))
    content = F.coalesce(F.concat(F.lit("="), F.col("fingerprint").cast("string")), F.lit("")).alias("content")
    files = resources.select("directory", "asset", "path", "name", content)
    whole = files.groupBy("directory", "asset").agg(F.min("path").alias("lead"), F.array_sort(F.collect_list(F.struct("name", "content", "path"))).alias("files"))
    whole = whole.select("*", F.col("files.name").alias("names"), F.col("files.content").alias("contents")).withColumn("twice", F.size(F.array_distinct("names")) < F.size("names"))
    assets = kept(in_order(whole, ["lead", "directory", "asset"], "turn"))
    good = assets.where("not twice")
    # The graph: an asset stands by its number; every root name links its assets to the first of them.
    ends = good.select("turn", "directory", F.explode(F.array_distinct(F.transform("names", root_name))).alias("root"))
    firsts = kept(ends.groupBy("directory", "root").agg(F.min("turn").alias("first")))
    links = ends.join(firsts, ["directory", "root"]).where("turn <> first").select(F.col("turn").alias("a"), F.col("first").alias("b"))
    found = components(links).select(F.col("node").alias("turn"), "component")
    of_asset = kept(good.join(found, "turn", "left").withColumn("component", F.coalesce("component", "turn")))
    there = existing.select("directory", "name", content).groupBy("directory", "name").agg(F.min("content").alias("content")) if existing is not None else files.select("directory", "name", "content").limit(0)
    at = firsts.join(found.withColumnRenamed("turn", "first"), "first", "left").select("directory", "root", F.coalesce("component", "first").alias("component"))
    there = there.withColumn("root", root_name(F.col("name"))).join(at, ["directory", "root"]).select("component", "directory", "name", "content")
    there = kept(there)
    # Only the first of equal assets is placed.
    same = ["component", "directory", "names", "contents"]
    firsts_of = kept(of_asset.groupBy(*same).agg(F.min("turn").alias("first")))
    plain = ~F.exists("names", lambda n: root_name(n) != n)
    kinds = firsts_of.groupBy("component").agg(F.min("names").alias("a"), F.max("names").alias("b"), F.bool_and(plain).alias("plain"))
    ranked = kinds.where("a = b and plain").select("component").join(there.select("component").distinct(), "component", "left_anti")
    by_rank = numbered(firsts_of.join(ranked, "component", "left_semi").select("component", "first"), ["component"], ["first"], "sequence")
    by_rank = by_rank.select("first", F.col("sequence").cast("long").alias("sequence"), F.lit(None).cast("array<boolean>").alias("copies"))
    rest = firsts_of.join(ranked, "component", "left_anti").select("component", F.col("first").alias("turn"), "directory", "names", "contents")
    held = there.join(ranked, "component", "left_anti").select("component", F.lit(None).cast("long").alias("turn"), "directory", F.array("name").alias("names"), F.array("content").alias("contents"))
    stream = rest.unionByName(held).repartition("component").sortWithinPartitions("component", F.col("turn").asc_nulls_first())
    replayed = stream.mapInArrow(_replay, "first long, sequence long, copies array<boolean>")
    placed = kept(by_rank.unionByName(replayed))
    told = of_asset.join(firsts_of, same).join(placed, "first")
    numbers = told.select("turn", "sequence", F.when(F.col("turn") == F.col("first"), F.coalesce("copies", F.transform("names", lambda _: F.lit(True)))).alias("copies"))
    out = assets.join(numbers, "turn", "left").select("directory", "asset", "sequence", "copies", F.posexplode("files").alias("i", "f"))
    name = F.col("f")["name"]
    stem, ending = F.regexp_extract(name, "(?s)" + _PARTS, 1), F.regexp_extract(name, "(?s)" + _PARTS, 2)
    number = F.concat(F.lit(" ("), F.col("sequence").cast("string"), F.lit(")"))
    new = F.when(F.col("sequence") > 1, F.when(stem != "", F.concat(stem, number, F.lit("."), ending)).otherwise(F.concat(name, number))).otherwise(name)
    what = F.when(F.col("sequence").isNull(), "error").when(F.get("copies", F.col("i")), "copy").otherwise("duplicate")
    return out.select("directory", "asset", F.col("f")["path"].alias("path"), new.alias("name"), "sequence", what.alias("disposition"))
