"""Near-duplicate documents at a Jaccard similarity of 0.8 over five-word shingles.

Candidates come from simhash.links(), the SimHash grid join, over five-word fingerprints.  Within
two bits of 64 it finds the closest copies only: measured on this library's test documents, pairs
at a similarity of 0.8 to 0.85 differ by 9 bits in the median and 3 in 100 lie within two.  So the
fingerprints are joined by sampled ones: BANDS bands of ROWS least salted shingle hashes (a SimHash
of a one-shingle sample is that shingle's hash).  At a similarity of 0.8, 1 - (1 - 0.8**4)**24 of
the pairs, all but 3 in a million, share a band.  Every candidate is then verified on the whole
sets of shingle hashes, so a merge always has a pair of that similarity behind it.

Documents with equal shingle sets are first reduced to one class.  In a band, members are linked to
two representatives in two rounds, which joins most copies at little cost.  A bucket of three or more
whose members are then still in several components may hide pairs that have no representative in
common, so its members pass an exact prefix-filter join: each class is sorted by how common its
shingles are, rarest first; two sets of that similarity must share one of the first shingles of both,
and what is left from there on must still be large enough.  All pairs that pass and are not yet in one
component are verified, whatever the size of the bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftworks.llm.components import connected_components
from siftworks.llm.hashing import Words, ascii_lower, mix, window_hashes
from siftworks.llm.scratch import Scratch
from siftworks.llm.simhash import fingerprint, links

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
BROADCAST_ROWS = 4_000_000  # row numbers (8 bytes) that may be sent to every executor
CELLS, SLICES = 1 << 20, 64  # counters of shingles that order them by how common they are; rows that carry them
_SALTS = (np.random.default_rng(20).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of the text in lower case; a shorter text is one shingle."""
    words = Words([text])
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(shingle, len(words))
    return np.unique(window_hashes(words.hashes(0, ascii_lower(words.joined)), np.arange(len(words) - k + 1), k, 1))


def _sketch(shingle: int, bands: int, rows: int):
    schema = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, doc, text in zip(*batch.columns, strict=True):
                raw = (text.as_py() or "").encode()
                s = shingle_set(raw, shingle)
                a = np.bitwise_xor.reduce(mix(s)) if len(s) else np.uint64(0)
                b = mix(s + np.uint64(1)).sum(dtype=np.uint64) if len(s) else np.uint64(0)
                least = np.array([(s * salt).min() for salt in _SALTS[: bands * rows]], dtype=np.uint64) if len(s) else np.zeros(bands * rows, np.uint64)
                key = np.zeros(bands, np.uint64)
                for r in range(rows):
                    key = mix(key ^ least[r::rows][:bands])
                out.append((row.as_py(), doc.as_py(), int(a.view(np.int64)), int(b.view(np.int64)), int(np.uint64(fingerprint(raw, shingle)).view(np.int64)), key.view(np.int64).tolist()))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [shingle_set((t.as_py() or "").encode(), shingle).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], names=["class", "shingles"])

    return run


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _counted(shingle: int):
    """How many classes of the partition hold shingles of each cell, in slices of the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(count, _cells(shingle_set((text.as_py() or "").encode(), shingle)), 1)
        parts = [(i, part.tobytes()) for i, part in enumerate(np.split(count, SLICES)) if part.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int64()), pa.array([x for _, x in parts], pa.binary())], names=["slice", "counts"])

    return run


def _cells(s: np.ndarray) -> np.ndarray:
    return (mix(s) % np.uint64(CELLS)).astype(np.int64)


def _summed(part: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in part.column("counts"))
    return pa.table({"slice": part.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _prefixes(shingle: int, similarity: float, sent):
    """Of each class the first shingles in the common order, with what is left from there on.

    A shingle whose cell counts one class is shared with none and only takes its place in the order.
    """
    names = ["token", "class", "component", "size", "left"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = sent.value
        for batch in batches:
            for node, component, text in zip(*batch.columns, strict=True):
                s = shingle_set((text.as_py() or "").encode(), shingle)
                often = count[_cells(s)]
                order = np.lexsort((s, often))[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]
                at = np.flatnonzero(often[order] > 1)
                same = lambda v, n=len(at): pa.array(np.full(n, v, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(s[order[at]].view(np.int64)), same(node.as_py()), same(component.as_py()), same(len(s)), pa.array(len(s) - at)], names=names)

    return run


def _prefix_pairs(crowd: DataFrame, texts: DataFrame, similarity: float, shingle: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of the classes of crowd (class, component) that can be similar enough and are in
    different components: every pair that is similar enough is among them."""
    held = scratch.table("crowd_texts", _small_join(texts, crowd, "class", "inner").select("class", "component", "text"))
    counts = held.select("text").mapInArrow(_counted(shingle), "slice long, counts binary").groupBy("slice").applyInArrow(_summed, "slice long, counts binary")
    total = np.zeros((SLICES, CELLS // SLICES), np.int32)
    for r in scratch.table("crowd_counts", counts).collect():
        total[r["slice"]] = np.minimum(np.frombuffer(r["counts"], np.int64), np.iinfo(np.int32).max)
    sent = crowd.sparkSession.sparkContext.broadcast(total.ravel())  # four bytes for each of the cells
    first = scratch.table("prefixes", held.mapInArrow(_prefixes(shingle, similarity, sent), "token long, class long, component long, size long, left long"))
    side = lambda x: first.select("token", F.col("class").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("component", "size", "left")))
    room = F.least("left_a", "left_b") * (1 + similarity) >= similarity * (F.col("size_a") + F.col("size_b")) - 1e-6
    return side("a").join(side("b"), "token").where((F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b")) & room).select("a", "b").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int, scratch: Scratch, name: str) -> DataFrame:
    """Those of the pairs (a, b) of classes whose shingle sets are similar enough."""
    asked = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    sets = scratch.table(f"{name}_sets", _small_join(texts, asked, "class", "left_semi").select("class", "text").mapInArrow(_sets(shingle), "class long, shingles binary"))
    first = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a")
    both = first.join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    found = scratch.table(f"{name}_edges", both.mapInArrow(_alike(similarity), "a long, b long"))
    scratch.drop(f"{name}_sets")
    return found


def _small_join(big: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """Join against a key list: sent to the executors while it is small, shuffled beyond."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return big.join(F.broadcast(keys) if few else keys, on, how)


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text, ...) with one document of each group of near-duplicates; columns unchanged.

    Two documents are near-duplicates if the Jaccard similarity of their sets of shingles (five
    words, A-Z lower-cased; a shorter text is one shingle) is at least 0.8; groups are what verified pairs connect.
    The least doc_id stays (null last); of rows with one doc_id the first as read stays.
    Texts without words - empty, null, white space - are copies of each other.  Other columns
    pass through; an empty table stays empty.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        row = "__siftworks_row"
        tagged = scratch.table("tagged", docs.withColumn(row, F.monotonically_increasing_id()))
        brief = tagged.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc"), "text")
        sketch = scratch.table("sketch", brief.mapInArrow(_sketch(shingle, bands, rows), "row long, doc long, set_a long, set_b long, fp long, bands array<long>"))
        order = F.struct(F.col("doc").isNull().alias("blank"), "doc", "row")
        grouped = sketch.groupBy("set_a", "set_b").agg(F.min(order).alias("best"), F.min("fp").alias("fp"), F.min("bands").alias("bands"))
        classes = scratch.table("classes", grouped.select("set_a", "set_b", F.col("best.row").alias("class"), "best", "fp", "bands"))
        texts = brief.select(F.col("row").alias("class"), "text")
        # round one: SimHash links, and the least class of each band
        by_print = classes.groupBy("fp").agg(F.min("class").alias("head"))
        close = links(by_print.select("fp"), scratch)
        heads = close.join(by_print.select(F.col("fp").alias("a"), F.col("head").alias("p")), "a").join(by_print.select(F.col("fp").alias("b"), F.col("head").alias("q")), "b")
        same = classes.join(by_print, "fp").select(F.col("class").alias("p"), F.col("head").alias("q"))
        spread = classes.select("class", F.posexplode("bands").alias("band", "key"))
        least = F.min("class").alias("first")
        other = F.min_by("class", F.xxhash64("class", "band")).alias("second")
        full = scratch.table("bands", spread.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), least, other).where("n > 1"))
        starred = scratch.table("stars", spread.join(full, ["band", "key"]).select("class", "first", "second"))
        ordered = lambda df: df.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
        pairs = heads.select("p", "q").unionByName(same).unionByName(starred.select(F.col("class").alias("p"), F.col("first").alias("q")))
        tried = scratch.table("pairs1", ordered(pairs))
        edges = _verified(tried, texts, similarity, shingle, scratch, "one")
        # round two: other representatives, where round one has not joined the two already
        joined = connected_components(edges, scratch, "cc_one")
        where = lambda side: joined.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
        apart = ordered(starred.select(F.col("class").alias("p"), F.col("second").alias("q"))).join(where("a"), "a", "left").join(where("b"), "b", "left")
        apart = apart.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
        more = _verified(scratch.table("pairs2", apart.join(tried, ["a", "b"], "left_anti")), texts, similarity, shingle, scratch, "two")
        edges = edges.unionByName(more)
        group = connected_components(edges, scratch, "cc_two")
        # crowded buckets: all pairs that two representatives have not joined
        placed = classes.select("class").join(group, F.col("class") == F.col("node"), "left").select("class", F.coalesce("component", "class").alias("component"))
        inside = spread.join(full.where("n > 2").select("band", "key"), ["band", "key"]).join(placed, "class")
        split = inside.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band", "key")
        crowd = scratch.table("crowd", inside.join(split, ["band", "key"]).select("class", "component").distinct())
        if not crowd.isEmpty():
            close = _prefix_pairs(crowd, texts, similarity, shingle, scratch)
            rest = _verified(scratch.table("pairs3", close.join(tried, ["a", "b"], "left_anti")), texts, similarity, shingle, scratch, "three")
            group = connected_components(edges.unionByName(rest), scratch, "cc_three")
        member = classes.join(group, F.col("class") == F.col("node")).select("class", "component", "best")
        winner = member.groupBy("component").agg(F.min("best").alias("top"))
        lost = member.join(winner, "component").where(F.col("top.row") != F.col("class")).select("class")
        beaten = sketch.join(classes.select("set_a", "set_b", "class"), ["set_a", "set_b"]).select("row", "class")
        losers = beaten.where("row <> class").select("row").unionByName(lost.select(F.col("class").alias("row")))
        gone = scratch.keep("losers", losers.select(F.col("row").alias(row)).distinct())
        scratch.hold_only("tagged", "losers")
        return _small_join(tagged, gone, row, "left_anti").select(*docs.columns)
