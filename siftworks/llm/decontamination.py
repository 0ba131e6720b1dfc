"""Benchmark decontamination: item-sized windows, SimHash, multi-index Hamming blocks, exact check.

A window of a document has as many words as the benchmark item it is held against.  Windows and
items are fingerprinted by SimHash over shingles of five words.  The multi-index cuts the 64 bits
into eight blocks: fingerprints within RADIUS bits differ by at most RADIUS // 8 bits in some
block, so looking every block up at that distance finds all of them.  What is found is verified by
the exact weighted (multiset) Jaccard similarity of the shingles.

A similarity above zero needs a common shingle, so a window is held against an item only if it
stands around a shingle of that item; this leaves out nothing that the exact check could accept.  Items are sent to the
executors in chunks of bounded size, one pass over the documents for each chunk.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftworks.llm.hashing import PUNCTUATION, Words, window_hashes
from siftworks.llm.blocks import is_member

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 8
CHUNK_BYTES = 4_000_000  # benchmark text sent to executors at a time
_BATCH_BYTES = 4 << 20
_TILE = 4096  # windows of a text that are fingerprinted at a time
_STRETCH = 1 << 15  # windows that are looked up at a time
_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


def _normal(text: str | None) -> bytes:
    return (text or "").lower().encode()


def _signs(hashes: np.ndarray) -> np.ndarray:
    """Each hash as 64 values of +1 and -1."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def _tiles_of(first: np.ndarray) -> Iterator[np.ndarray]:
    """Places of rising first words in stretches that span at most _TILE words, so that a long text needs no more memory than a short one."""
    cuts = np.flatnonzero(np.diff(first // _TILE)) + 1
    yield from np.split(np.arange(len(first)), cuts)


class Index:
    """Items of one chunk: shingles, fingerprints and the multi-index."""

    def __init__(self, items: list[tuple[int | None, str | None]], shingle: int = SHINGLE, radius: int = RADIUS):
        texts = [_normal(t) for _, t in items]
        words = Words(texts, PUNCTUATION)
        full = words.counts > 0
        self.shingle, self.radius = shingle, radius
        self.ids = [i for (i, _), f in zip(items, full, strict=True) if f]
        self.words = [[words.joined[s:e] for s, e in zip(words.starts[a:b], words.ends[a:b], strict=True)] for a, b in zip(words.first[full], words.last[full], strict=True)]
        self.length = np.array([len(w) for w in self.words], dtype=np.int64)
        self.counts = [self.shingles(w) for w in self.words]
        hashed = words.hashes(0)
        owner = defaultdict(set)
        prints = []
        for i, (a, n) in enumerate(zip(words.first[full], self.length, strict=True)):
            k = min(shingle, n)
            h = window_hashes(hashed[a : a + n], np.arange(n - k + 1), k, 1)
            prints.append(_packed(_signs(h).sum(axis=0, keepdims=True))[0])
            for x in h.tolist():
                owner[x].add(i)
        self.fingerprint = np.array(prints, dtype=np.uint64)
        self.known = np.array(sorted(owner), dtype=np.uint64)
        # Items of each known shingle, one list after the other.
        self.owner_ends = np.cumsum([0, *(len(owner[x]) for x in self.known.tolist())])
        self.owners = np.array([i for x in self.known.tolist() for i in sorted(owner[x])], dtype=np.int64)
        self.widths = sorted({int(min(shingle, n)) for n in self.length})
        blocks = self.fingerprint.view(np.uint8).reshape(-1, BLOCKS) if len(prints) else np.zeros((0, BLOCKS), np.uint8)
        self.near = [_NEAR[:, blocks[:, b]] <= radius // BLOCKS for b in range(BLOCKS)]  # value of the block x items

    def shingles(self, words: list[bytes]) -> Counter:
        k = min(self.shingle, len(words))
        return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()

    def within(self, prints: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Which pairs of a window's fingerprint and an item are within the radius, looked up block by block."""
        values = prints.view(np.uint8).reshape(-1, BLOCKS)
        found = np.zeros(len(prints), dtype=bool)
        for b in range(BLOCKS):
            found |= self.near[b][values[:, b], items]
        found[found] = np.bitwise_count(prints[found] ^ self.fingerprint[items[found]]) <= self.radius
        return found

    def search(self, texts: list[bytes], least: float) -> list[list[tuple[int, int, int, float]]]:
        """For each text its matches (item, first word, words, similarity): the best window of each item."""
        words = Words(texts, PUNCTUATION)
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        hashed = words.hashes(0)
        for width in self.widths:
            starts, h = self._known_windows(hashed, words.window_starts(width), width)
            text_of = np.searchsorted(words.first, starts, side="right") - 1
            for t in np.unique(text_of).tolist():
                own = text_of == t
                a, b = int(words.first[t]), int(words.last[t])
                out[t] += self._search_one(words, hashed[a:b], a, b, width, starts[own] - a, h[own], least)
        return out

    def _known_windows(self, hashed: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the windows whose hash is a known shingle, and the hash; hashed a stretch of windows at a time."""
        found, hashes = [starts[:0]], [np.zeros(0, np.uint64)]
        for at in range(0, len(starts), _STRETCH):
            some = starts[at : at + _STRETCH]
            low = int(some[0])
            h = window_hashes(hashed[low : int(some[-1]) + width], some - low, width, 1)
            hit = is_member(self.known, h)
            found.append(some[hit])
            hashes.append(h[hit])
        return np.concatenate(found), np.concatenate(hashes)

    def _search_one(self, words: Words, hashed: np.ndarray, a: int, b: int, width: int, at: np.ndarray, h: np.ndarray, least: float) -> list[tuple[int, int, int, float]]:
        n = b - a
        # Pairs (item, hit): every window of the item's size around a shingle that the item has.
        k = np.searchsorted(self.known, h)
        many = self.owner_ends[k + 1] - self.owner_ends[k]
        ends = np.cumsum(many)
        items = self.owners[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.owner_ends[k] - (ends - many), many)]
        hits = np.repeat(at, many)
        mine = np.minimum(self.shingle, self.length[items]) == width
        items, hits = items[mine], hits[mine]
        order = np.lexsort((hits, items))
        items, hits = items[order], hits[order]
        size = np.minimum(self.length[items], n)
        low, high = np.maximum(0, hits - size + width), np.minimum(hits, n - size)
        # Windows of one item overlap from hit to hit: each is taken once.
        again = np.concatenate([[False], items[1:] == items[:-1]])
        low[again] = np.maximum(low[again], high[np.flatnonzero(again) - 1] + 1)
        each = np.maximum(0, high - low + 1)
        ends = np.cumsum(each)
        first = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - each), each)
        items_of, size_of = np.repeat(items, each), np.repeat(size, each)
        span = {int(i): (int(x), int(y)) for i, x, y in zip(*np.unique(items, return_index=True), [*np.unique(items, return_index=True)[1][1:], len(items)], strict=True)}
        best: dict[int, tuple[float, int, int]] = {}
        for size in np.unique(size_of).tolist():
            some = np.flatnonzero(size_of == size)
            some = some[np.lexsort((items_of[some], first[some]))]
            for tile in _tiles_of(first[some]):
                pair = some[tile]
                low = int(first[pair[0]])
                signs = _signs(window_hashes(hashed, np.arange(low, first[pair[-1]] + size - width + 1), width, 1))
                sums = np.zeros((len(signs) + 1, 64), dtype=np.int32)
                np.cumsum(signs, axis=0, out=sums[1:])
                starts, of = np.unique(first[pair], return_inverse=True)
                prints = _packed(sums[starts - low + size - width + 1] - sums[starts - low])
                for j in pair[self.within(prints[of], items_of[pair])].tolist():
                    i, s = int(items_of[j]), int(first[j])
                    x, y = span[i]
                    # No more can be alike than the window's shingles that the item has.
                    most = int(np.searchsorted(hits[x:y], s + size - width + 1) - np.searchsorted(hits[x:y], s))
                    here_n, item_n = size - width + 1, int(self.length[i]) - width + 1
                    if most < least * (here_n + item_n - most) - 1e-9:
                        continue
                    text = [words.joined[p:q] for p, q in zip(words.starts[a + s : a + s + size], words.ends[a + s : a + s + size], strict=True)]
                    here, item = self.shingles(text), self.counts[i]
                    alike = sum((here & item).values()) / sum((here | item).values())
                    if alike >= least and (i not in best or alike > best[i][0]):
                        best[i] = (alike, s, size)
        return [(i, s, size, alike) for i, (alike, s, size) in sorted(best.items())]


def _indexes(benchmark: DataFrame, chunk_bytes: int) -> Iterator[Index]:
    """The benchmark in chunks of about chunk_bytes, whatever its size; at least one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    for c in range(chunks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c)
        yield Index(sorted(((r.item_id, r.text) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))


def _searched(texts: pa.Array, index: Index, least: float) -> Iterator[list[tuple[int, int, int, float]]]:
    held: list[bytes] = []
    for text in texts:
        held.append(_normal(text.as_py()))
        if sum(map(len, held[-1:])) and sum(map(len, held)) > _BATCH_BYTES:
            yield from index.search(held, least)
            held = []
    yield from index.search(held, least)


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Passages of benchmark (item_id, text) in docs (doc_id, text).

    (doc_id, item_id, first_word, n_words, similarity): for each document and item the best window
    (the first of equals) with at least this similarity; clean documents have no row.  Words are
    runs of letters and digits in lower case; items and texts under five words are one shingle.
    Null and empty texts, and items without words, match nothing.  Repeated rows and items give
    repeated rows; null ids are kept; other columns are ignored.
    """
    spark = docs.sparkSession
    found = None
    for index in _indexes(benchmark, chunk_bytes):
        sent = spark.sparkContext.broadcast(index)  # about chunk_bytes of text

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])
            for batch in batches:
                rows = [(doc.as_py(), sent.value.ids[i], s, n, x) for doc, hits in zip(batch.column(0), _searched(batch.column(1), sent.value, similarity), strict=True) for i, s, n, x in hits]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, first_word long, n_words long, similarity double")
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaking(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs without the rows that find_leaks() would report; columns unchanged."""
    at = docs.columns.index("text")
    for index in _indexes(benchmark, chunk_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not hits for hits in _searched(batch.column(at), sent.value, similarity)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
