"""Fill-in-the-middle: texts cut in three and put in another order around sentinels.

One numpy kernel works on a whole Arrow batch, on the UTF-8 bytes of all its texts end to end.  A
table of 256 byte classes is looked up, a mask of adjacent classes says where a unit begins, its
cumulative sum, less what the documents before have, numbers each document's units, and one
searchsorted turns the unit numbers of all cuts into bytes.  The output is the join of those
slices; no text is decoded.  Batches end at some megabytes or one text (``small_batches``), and the
kernel takes about five times a batch.

Units are code points, or words or lines: a unit then starts at the first byte of a run of non-space
bytes, or after a line feed, and takes with it what stands before the next one.  What stands before
the first word is no unit; it stays with the prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_TAIL, _SPACE, _FEED, _OTHER = 0, 1, 2, 3  # classes: continuation of a code point, white space, line feed, all else
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x80:0xC0] = _TAIL
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = _SPACE
_CLASS[0x0A] = _FEED
UNITS = ("character", "word", "line")


def unit_starts(data: np.ndarray, first: np.ndarray, unit: str = "character") -> np.ndarray:
    """Which bytes begin a unit; first: where the documents begin, so that none looks at the one before it."""
    kind = _CLASS[data]
    if unit == "character":
        return kind != _TAIL
    before = np.empty_like(kind)
    before[1:] = kind[:-1]
    before[first[first < len(kind)]] = _FEED
    space = lambda k: (k == _SPACE) | (k == _FEED)
    return before == _FEED if unit == "line" else space(before) & ~space(kind)


def cut_bytes(ends: np.ndarray, running: np.ndarray, n: np.ndarray, before: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Byte at which unit number wanted (from 0) of each document begins, or the document's end if it has
    no more than n; running: units that began so far, before: those of the documents before."""
    if not len(running):
        return ends[:-1]
    return np.where(wanted >= n, ends[1:], np.searchsorted(running, before + wanted + 1, side="left"))


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end and where its rows begin and end; null is empty."""
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _joined(data: np.ndarray, starts: list[np.ndarray], ends: list[np.ndarray]) -> pa.Array:
    """Rows made of the slices starts[i]..ends[i] of data, in order."""
    size = sum(e - s for s, e in zip(starts, ends, strict=True))
    view = memoryview(data)
    flat_starts, flat_ends = np.stack(starts, axis=1).ravel(), np.stack(ends, axis=1).ravel()
    some = flat_ends > flat_starts
    out = b"".join([view[s:e] for s, e in zip(flat_starts[some].tolist(), flat_ends[some].tolist(), strict=True)])
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(out))


def draws(doc_id: list[int | None], seed: int) -> np.ndarray:
    """Four 32-bit numbers a document, from the SHA-256 of seed and id; a null id counts as empty."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).digest()[:16] for d in doc_id)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def cut_batch(texts: pa.Array, h: np.ndarray, plain_from: int, spm_below: int, unit: str = "character") -> tuple[pa.Array, ...]:
    """n, form, prefix_chars, middle_chars, output of all rows together."""
    data, ends = _texts(texts)
    running = np.cumsum(unit_starts(data, ends[:-1], unit), dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    upto = np.where(ends > 0, running[np.maximum(ends, 1) - 1] if len(running) else 0, 0).astype(np.int64)
    n, before = np.diff(upto), upto[:-1]
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    first, second = (cut_bytes(ends, running, n, before, w) for w in (low, high))
    marked = np.zeros(len(n), bool)
    raw = data.tobytes()
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        at = raw.find(sentinel)
        while at >= 0:  # a find may cross two documents: then it is in neither
            row = int(np.searchsorted(ends, at, side="right")) - 1
            if at + len(sentinel) <= ends[row + 1]:
                marked[row] = True
                at = raw.find(sentinel, int(ends[row + 1]))  # on with the next document
            else:
                at = raw.find(sentinel, at + 1)
    plain = (n == 0) | (np.diff(ends) == 0) | marked | (h[:, 2] % 100 >= plain_from)
    spm = ~plain & (h[:, 3] % 100 < spm_below)
    psm = ~plain & ~spm
    words = np.concatenate([data, np.frombuffer(PREFIX + SUFFIX + MIDDLE, np.uint8)])
    p, s, m = len(data), len(data) + 3, len(data) + 6
    zero = np.zeros(len(n), np.int64)
    pick = lambda of_plain, of_psm, of_spm: np.where(plain, of_plain, np.where(psm, of_psm, of_spm))
    begin, end = ends[:-1], ends[1:]
    starts = [pick(begin, p, s), pick(zero, begin, second), pick(zero, s, p), pick(zero, second, begin), pick(zero, m, m), pick(zero, first, first)]
    stops = [pick(end, p + 3, s + 3), pick(zero, first, end), pick(zero, s + 3, p + 3), pick(zero, end, first), pick(zero, m + 3, m + 3), pick(zero, second, second)]
    output = _joined(words, starts, stops)
    form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string())
    return pa.array(n), form, pa.array(low, mask=plain), pa.array(high - low, mask=plain), output


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, unit: str = "character") -> DataFrame:
    """docs (doc_id, text) -> doc_id, n (units), form, prefix_chars, middle_chars, output; one row per input row.

    form is plain, psm or spm.  A text that is null, empty or holds a sentinel stays plain, and so do
    plain_percent of the others.  Draws depend on seed and doc_id alone, so rows of one id are cut
    alike and reruns agree.  prefix_chars and middle_chars count units and are null if plain.  Other
    columns are ignored.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = cut_batch(batch.column(1), draws(batch.column(0).to_pylist(), seed), 100 - plain_percent, spm_percent, unit)
            yield pa.RecordBatch.from_arrays([batch.column(0), *got[:4], got[4].cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that output was made from: no part of it holds a sentinel, so the first of each is the mark."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))

    def apart(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.length(two) + len(m) + 1)

    prefix, suffix, middle = apart(p, s)
    suffix2, prefix2, middle2 = apart(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
