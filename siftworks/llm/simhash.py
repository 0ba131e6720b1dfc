"""Near-duplicate documents: SimHash fingerprints linked within a Hamming radius of two.

Candidates come from a *segment-popcount embedding*: a 64-bit fingerprint is cut into 16 segments
of 4 bits and mapped to the vector of its segments' bit counts.  One differing bit moves one count
by one, so the Manhattan distance of two vectors is a lower bound of the Hamming distance.  The
grid range-join finds every pair of vectors within Manhattan distance 2: each fingerprint enters
its own cell and the cells one step away, and two vectors at distance 2 or less always share one.

Verification is exact and never forms all pairs of a group.  A cell with two members is one pair,
checked directly.  Members of fuller cells are expanded to the 65 fingerprints at distance one or
less; two fingerprints are within two bits of each other exactly if these sets meet, and no more
than 65 fingerprints can meet in one, so each meeting point links its members to the least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from siftworks.llm.components import connected_components
from siftworks.llm.scratch import Scratch

SEED = 42
SHINGLE = 3
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LANES = np.uint64(0x0101010101010101)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set: byte lanes summed 255 rows at a time."""
    padded = np.zeros(-(-len(h) // 255) * 255, dtype=np.uint64)
    padded[: len(h)] = h
    rows = padded.reshape(-1, 255)
    out = np.zeros(64, dtype=np.int64)
    for b in range(8):
        lanes = ((rows >> np.uint64(b)) & _LANES).sum(axis=1, dtype=np.uint64)
        out[b::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text (see simhash_components for the rules)."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        cut = zip((ends - lengths).tolist(), ends[shingle - 1 :].tolist(), strict=False)
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[s:e], SEED) for s, e in cut], dtype=np.uint64)
    on = 2 * _bit_counts(hashes) > len(hashes)
    return int(np.packbits(on, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs -> (doc_id, fp): fp is the fingerprint's 64 bits as a signed long; a null text has fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.encode() if t else b"", shingle) for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _segment_counts(fp: Column) -> Column:
    """The embedding: nibble i holds the bit count (0..4) of nibble i of fp."""
    low, pairs = F.lit(0x5555555555555555), F.lit(0x3333333333333333)
    a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    two = F.shiftleft(a.bitwiseAND(b), 1).bitwiseOR(a.bitwiseXOR(b))
    return two.bitwiseAND(pairs) + F.shiftrightunsigned(two, 2).bitwiseAND(pairs)


def _cells(v: Column) -> Column:
    """The cells at Manhattan distance 0 and 1 from vector v, as an array."""
    steps = [v]
    for i in range(16):
        count = F.shiftrightunsigned(v, 4 * i).bitwiseAND(F.lit(15))
        steps += [F.when(count < 4, v + F.lit(1 << 4 * i)), F.when(count > 0, v - F.lit(1 << 4 * i))]
    return F.array_compact(F.array(*steps))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) that connect exactly what radius 2 connects."""
    # the fingerprints are few bytes but each enters up to 33 cells: deal them to all cores first
    parts = max(distinct.sparkSession.sparkContext.defaultParallelism, distinct.count() // 100_000)
    distinct = distinct.repartition(parts, "fp")
    spread = distinct.select("fp", F.explode(_cells(_segment_counts(F.col("fp")))).alias("cell"))
    cells = scratch.table("cells", spread.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    pairs = cells.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    crowded = spread.join(cells.where("n > 2").select("cell"), "cell", "left_semi").select("fp").distinct()
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))
    met = crowded.select("fp", F.explode(near).alias("at")).groupBy("at").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def simhash_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): documents linked, directly or through others, within two bits.

    A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, each shingle of three words (repeats
    included) is hashed with XXH64 (seed 42), and a bit is set if over half of the hashes set it.
    A shorter text is one shingle; a text without words, empty or null, has fingerprint zero and is
    linked like any other.  component_id is the least doc_id of the component.  Rows keep their
    number: repeated doc_ids give repeated rows, a null doc_id gives a row with the component's
    least non-null doc_id (null if it has none).  Other columns are ignored.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        fps = scratch.table("fps", fingerprints(docs, shingle))
        nodes = scratch.table("nodes", fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
        found = connected_components(links(nodes.select("fp"), scratch), scratch)
        member = scratch.table("member", nodes.join(found, nodes.fp == found.node).select("fp", "component", "least"))
        top = member.groupBy("component").agg(F.min("least").alias("component_id"))
        linked = member.join(top, "component").select("fp", "component_id")
        every = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
        return scratch.keep("result", fps.join(every, "fp").select("doc_id", "fp", "component_id"))
