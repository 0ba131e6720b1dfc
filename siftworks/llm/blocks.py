"""Text blocks: rows that hold a few megabytes of whole documents, and exchanges keyed by block.

Operators that look at every window of every text would move many times the input if each window
were a row.  Here a row is a block of documents, numpy works inside it, and what crosses the
network are sorted, packed arrays: one small binary per (slice of the key space, block).  Results
return to the block that asked, so the text itself is never exploded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

BLOCK_BYTES = 4 << 20
BLOCK_SCHEMA = "block long, doc_ids array<long>, lengths array<long>, n_bytes long, n_words long, data binary"


def _block(number: int, ids: list, texts: list[bytes]) -> dict:
    return {
        "block": number, "doc_ids": ids, "lengths": [len(t) for t in texts], "n_bytes": sum(map(len, texts)),
        "n_words": sum(len(t.split()) for t in texts), "data": zstandard.ZstdCompressor(level=3).compress(b"".join(texts)),
    }


def pack_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text) -> blocks.  A null text counts as empty; a text over block_bytes is a block alone.

    Write the result before use: a block's number is only fixed once its task has committed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_bytes", pa.int64()), ("n_words", pa.int64()), ("data", pa.binary())])
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                if texts and held + len(raw) > block_bytes:
                    yield pa.RecordBatch.from_pylist([_block(number, ids, texts)], schema)
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(doc.as_py())
                texts.append(raw)
                held += len(raw)
        if texts:
            yield pa.RecordBatch.from_pylist([_block(number, ids, texts)], schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCK_SCHEMA)


def unpack_texts(data: bytes, lengths: list[int]) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data) if sum(lengths) else b""
    ends = np.cumsum([0, *lengths]).tolist()
    return [raw[s:e] for s, e in zip(ends, ends[1:], strict=False)]


def blocks_of(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, list, list[bytes]]]:
    """(block, doc_ids, texts) of each row."""
    for i in range(batch.num_rows):
        row = {n: batch.column(n)[i].as_py() for n in ("block", "doc_ids", "lengths", "data")}
        yield row["block"], row["doc_ids"], unpack_texts(row["data"], row["lengths"])


def pack_ints(values: np.ndarray) -> bytes:
    """Sorted unsigned integers -> compressed differences, byte plane by byte plane."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_ints(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def cut(sorted_keys: np.ndarray, slice_of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(slice, start, end) for each run of equal slice numbers; slice_of rises with sorted_keys."""
    if len(sorted_keys):
        starts = np.flatnonzero(np.concatenate([[True], slice_of[1:] != slice_of[:-1]]))
        ends = np.append(starts[1:], len(sorted_keys))
        yield from zip(slice_of[starts].tolist(), starts.tolist(), ends.tolist(), strict=True)


EXCHANGE_SCHEMA = "kind int, slice long, block long, data binary"
_EXCHANGE = pa.schema([("kind", pa.int32()), ("slice", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])


def exchange_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _EXCHANGE.types, strict=True)], schema=_EXCHANGE)


def repeated_cells(cells: DataFrame, hot: int = 0, hot_kind: int = -1) -> DataFrame:
    """Counting cells (kind, slice, block, packed cells) -> the same, with only cells counted twice or more.

    One group is one slice of one row of the sketch; merging the blocks' sketches is the sum of
    their counts, taken here cell by cell.  With hot, cells counted more often than that are given
    a second time, as hot_kind.
    """

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack_ints(d.as_py()) for d in table.column("data")]
        together = np.sort(np.concatenate(parts), kind="stable")
        often = np.unique(together[1:][together[1:] == together[:-1]])
        crowded = np.unique(together[hot:][together[hot:] == together[: max(0, len(together) - hot)]]) if hot else often[:0]
        out = []
        for part, kind, sl, block in zip(parts, *(table.column(n).to_pylist() for n in ("kind", "slice", "block")), strict=True):
            if len(hit := np.unique(part[is_member(often, part)])):
                out.append((kind, sl, block, pack_ints(hit)))
                if len(hit := hit[is_member(crowded, hit)]):
                    out.append((hot_kind, sl, block, pack_ints(hit)))
        return pa.Table.from_batches([exchange_rows(out)])

    return cells.groupBy("kind", "slice").applyInArrow(run, EXCHANGE_SCHEMA)


_MASK = np.uint64((1 << 22) - 1)


def is_member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x (unsigned) are among sorted_values; a table of low bits spares most of the searches."""
    out = np.zeros(len(x), dtype=bool)
    if not len(sorted_values):
        return out
    if len(x) > 1 << 14:
        table = np.zeros(1 << 22, dtype=bool)
        table[(sorted_values & _MASK).astype(np.int64)] = True
        ask = np.flatnonzero(table[(x & _MASK).astype(np.int64)])
    else:
        ask = np.arange(len(x))
    at = np.minimum(np.searchsorted(sorted_values, x[ask]), len(sorted_values) - 1)
    out[ask] = sorted_values[at] == x[ask]
    return out
