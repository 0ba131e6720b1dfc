"""Removal of repeated word windows: count-min prefilter, then exact grouping of what it lets through.

Pass 1  Every block hashes its windows of ``window`` words and adds each distinct one to its own
        count-min sketch (``depth`` rows).  Sketches are merged slice by slice: counts only ever
        add up, so a window's estimate is never below the number of blocks that hold it.
Pass 2  Windows whose estimate is two or more (and windows repeated inside a block) are grouped
        exactly by the XXH128 of their bytes, words joined by one space.  A unique window that the
        sketch lets through is thrown out here; a repeated window is never lost.
Pass 3  Blocks learn which of their windows repeat and drop the covered words.

Each block contributes a window once, so a passage in a third of all documents reaches a reducer
at most once per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from siftworks.llm.blocks import (
    BLOCK_BYTES, EXCHANGE_SCHEMA, blocks_of, cut, exchange_rows, is_member, pack_blocks, pack_ints, repeated_cells, unpack_ints,
)
from siftworks.llm.hashing import Words, covered, mix, runs, window_hashes
from siftworks.llm.scratch import Scratch

WINDOW = 35
_SALTS = (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A35, 0x5851F42D4C957F2D, 0x14057B7EF767814F)
_KEYS, _FOUND = 100, 101  # kinds of exchange rows; smaller kinds are rows of the sketch


class _Plan:
    """Widths that follow from the number of windows; the same in every task."""

    def __init__(self, n_windows: int, window: int, depth: int, per_window: int, slice_entries: int):
        self.window, self.depth = window, depth
        self.bits = max(10, int(np.ceil(np.log2(max(1, n_windows) * per_window))))
        slices = max(1, -(-n_windows // slice_entries))
        self.slice_bits = min(self.bits, int(np.ceil(np.log2(slices))))

    def cells(self, h: np.ndarray, row: int) -> np.ndarray:
        return mix(h ^ np.uint64(_SALTS[row])) >> np.uint64(64 - self.bits)

    def cell_slice(self, cells: np.ndarray) -> np.ndarray:
        return (cells >> np.uint64(self.bits - self.slice_bits)).astype(np.int64)

    def key_slice(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.slice_bits)).astype(np.int64) if self.slice_bits else np.zeros(len(h), dtype=np.int64)


def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    starts = words.window_starts(window)
    return starts, window_hashes(words.quick_hashes(), starts, window, 1)  # for estimates: windows that collide are only counted too often


def _sketch(plan: _Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, texts in blocks_of(batch):
                h = np.unique(_windows(Words(texts), plan.window)[1])
                for row in range(plan.depth):
                    cells = np.sort(plan.cells(h, row))
                    base = plan.bits - plan.slice_bits
                    yield exchange_rows([(row, s, block, pack_ints(cells[a:b] - np.uint64(s << base))) for s, a, b in cut(cells, plan.cell_slice(cells))])

    return run


def _digests(words: Words, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH128 of the windows' bytes, in two halves."""
    text, at = words.normal()
    digest = xxhash.xxh3_128_digest
    parts = []
    for i in range(0, len(starts), 1 << 16):
        some = starts[i : i + (1 << 16)]
        parts.append(b"".join([digest(text[a:b]) for a, b in zip(at[some].tolist(), at[some + window].tolist(), strict=True)]))
    halves = np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


class _Candidates:
    """The windows of a block that may repeat: their key, and for each the distinct key it has."""

    def __init__(self, words: Words, told: pa.Table, plan: _Plan):
        starts, h = _windows(words, plan.window)
        local = np.unique(h, return_counts=True)
        often = is_member(local[0][local[1] > 1], h)
        estimate = np.ones(len(h), dtype=bool)
        lists: list[list[np.ndarray]] = [[] for _ in range(plan.depth)]
        self.bitmaps: dict[int, bytes] = {}
        base = plan.bits - plan.slice_bits
        for kind, sl, data in zip(*(told.column(n).to_pylist() for n in ("kind", "slice", "data")), strict=True):
            if kind < plan.depth:
                lists[kind].append(unpack_ints(data) + np.uint64(sl << base))
            else:
                self.bitmaps[sl] = data
        for row in range(plan.depth):
            estimate &= is_member(np.sort(np.concatenate(lists[row])) if lists[row] else np.zeros(0, np.uint64), plan.cells(h, row))
        pick = estimate | often
        self.starts = starts[pick]
        k0, k1 = _digests(words, self.starts, plan.window)
        order = np.lexsort((k1, k0))
        k0, k1 = k0[order], k1[order]
        new = np.concatenate([[True], (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])]) if len(k0) else np.zeros(0, bool)
        self.of = np.empty(len(k0), dtype=np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.k0, self.k1 = k0[new], k1[new]
        self.twice = np.bincount(self.of, minlength=len(self.k0)) > 1
        self.slices = plan.key_slice(self.k0)

    def confirmed(self) -> np.ndarray:
        """First words of the windows that repeat."""
        yes = self.twice.copy()
        for s, a, b in cut(self.k0, self.slices):
            if s in self.bitmaps:
                yes[a:b] |= np.unpackbits(np.frombuffer(self.bitmaps[s], np.uint8), count=b - a).astype(bool)
        return self.starts[yes[self.of]] if len(yes) else self.starts


def _keys(plan: _Plan):
    def run(block_rows: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for block, _, texts in blocks_of(block_rows):
            c = _Candidates(Words(texts), told, plan)
            out += [(_KEYS, s, block, c.k0[a:b].tobytes() + c.k1[a:b].tobytes()) for s, a, b in cut(c.k0, c.slices)]
        return pa.Table.from_batches([exchange_rows(out)])

    return run


def _exact(table: pa.Table) -> pa.Table:
    """All keys of one slice -> for each block a bitmap of its keys that other blocks have too."""
    parts = [np.frombuffer(d.as_py(), np.uint64).reshape(2, -1) for d in table.column("data")]
    keys = np.concatenate(parts, axis=1)
    order = np.lexsort((keys[1], keys[0]))
    same = (keys[:, order[1:]] == keys[:, order[:-1]]).all(axis=0)
    shared = np.zeros(keys.shape[1], dtype=bool)
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    ends = np.cumsum([0, *(p.shape[1] for p in parts)])
    out = [(_FOUND, s, b, np.packbits(shared[i:j]).tobytes()) for s, b, i, j in zip(table.column("slice").to_pylist(), table.column("block").to_pylist(), ends, ends[1:], strict=False) if shared[i:j].any()]
    return pa.Table.from_batches([exchange_rows(out)])


def _strip(plan: _Plan):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(block_rows: pa.Table, told: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for _, ids, texts in blocks_of(block_rows):
            words = Words(texts)
            gone = covered(len(words), _Candidates(words, told, plan).confirmed(), plan.window)
            text, at = words.normal()
            for doc, a, b in zip(ids, words.first.tolist(), words.last.tolist(), strict=True):
                drop = gone[a:b]
                kept = (text[at[a + i] : at[a + j] - 1] for i, j in zip(*runs(~drop), strict=True))
                out.append((doc, b - a, int(drop.sum()), b" ".join(kept).decode()))
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def remove_repeated_windows(
    docs: DataFrame, window: int = WINDOW, depth: int = 2, cells_per_window: int = 4, block_bytes: int = BLOCK_BYTES, slice_entries: int = 2_000_000
) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_words, n_removed, kept): one row per input row.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A word goes if a window of ``window`` consecutive
    words that covers it also starts anywhere else, the same document included.  kept is what stays,
    joined by one space.  Null and empty texts have no words and kept ''.  Repeated rows are
    documents like any other, so exact copies of ``window`` words or more lose all their words,
    the first copy too.  Null doc_ids pass through; other columns are ignored; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    blocks = scratch.table("blocks", pack_blocks(docs, block_bytes))
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    plan = _Plan(total, window, depth, cells_per_window, slice_entries)
    text = blocks.select("block", "doc_ids", "lengths", "data")
    cells = scratch.table("cells", repeated_cells(text.mapInArrow(_sketch(plan), EXCHANGE_SCHEMA)))
    keys = text.groupBy("block").cogroup(cells.groupBy("block")).applyInArrow(_keys(plan), EXCHANGE_SCHEMA)
    found = scratch.table("found", keys.groupBy("slice").applyInArrow(_exact, EXCHANGE_SCHEMA))
    scratch.hold()
    told = cells.unionByName(found)
    return text.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_strip(plan), "doc_id long, n_words long, n_removed long, kept string")
