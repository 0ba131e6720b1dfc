"""Media containers as rows: JPEG segments and frame profiles, TIFF-style indexes, ISO boxes, gain-map payloads.

Files come as binaryFile rows; each helper walks the bytes of one file and gives its parts as rows,
so that everything after it - filters, joins, checks - is DataFrame work.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# JPEG markers without a length, and those that start a frame.
_BARE = {0x01, *range(0xD0, 0xDA)}
_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}


def _rows(df: DataFrame, parse: Callable[[bytes], Iterator[dict]], fields: dict[str, pa.DataType], ddl: str) -> DataFrame:
    """df (path, content) -> path and the parsed rows; a file that cannot be read on gives the rows before the damage."""
    schema = pa.schema([("path", pa.string()), *fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                out = []
                try:
                    for row in parse(content.as_py() or b""):
                        out.append({"path": path.as_py(), **row})
                except (struct.error, IndexError):
                    pass
                yield pa.RecordBatch.from_pylist(out, schema)

    return df.select("path", "content").mapInArrow(run, f"path string, {ddl}")


def _segments(data: bytes) -> Iterator[dict]:
    """Marker segments of every image in the file, entropy-coded data as part of its scan."""
    at, image = 0, -1
    while at + 1 < len(data):
        if data[at] != 0xFF:
            at = data.find(b"\xff\xd8\xff", at)
            if at < 0:
                return
        marker = data[at + 1]
        if marker == 0xD8:
            image += 1
        if marker == 0xFF:
            at += 1
            continue
        if marker in _BARE:
            yield {"image": image, "marker": marker, "start": at, "length": 2}
            at += 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0] + 2
        end = at + size
        if marker == 0xDA:
            while end + 1 < len(data) and not (data[end] == 0xFF and data[end + 1] not in (0, *range(0xD0, 0xD8))):
                end += 1
        yield {"image": image, "marker": marker, "start": at, "length": min(end, len(data)) - at}
        at = end


def jpeg_segments(df: DataFrame) -> DataFrame:
    return _rows(df, _segments, {"image": pa.int32(), "marker": pa.int32(), "start": pa.int64(), "length": pa.int64()}, "image int, marker int, start long, length long")


def _frames(data: bytes) -> Iterator[dict]:
    for s in _segments(data):
        if s["marker"] in _FRAMES:
            depth, height, width, n = struct.unpack_from(">BHHB", data, s["start"] + 4)
            factors = [data[s["start"] + 11 + 3 * i] for i in range(n)]
            yield {"image": s["image"], "width": width, "height": height, "depth": depth, "sampling": [f"{f >> 4}x{f & 15}" for f in factors]}


def jpeg_frames(df: DataFrame) -> DataFrame:
    """Dimensions, bit depth and sampling factors of each image."""
    return _rows(df, _frames, {"image": pa.int32(), "width": pa.int32(), "height": pa.int32(), "depth": pa.int32(), "sampling": pa.list_(pa.string())}, "image int, width int, height int, depth int, sampling array<string>")


def _tiff(data: bytes, base: int) -> Iterator[dict]:
    """Entries of all directories that the TIFF header at base leads to, Exif directory included."""
    order = {b"II": "<", b"MM": ">"}.get(data[base : base + 2])
    if order is None:
        return
    todo, seen = [(0, struct.unpack_from(order + "I", data, base + 4)[0])], set()
    while todo:
        directory, at = todo.pop(0)
        if at in seen or not at:
            continue
        seen.add(at)
        n = struct.unpack_from(order + "H", data, base + at)[0]
        for i in range(n):
            tag, kind, count, value = struct.unpack_from(order + "HHII", data, base + at + 2 + 12 * i)
            short = struct.unpack_from(order + "H", data, base + at + 10 + 12 * i)[0]
            yield {"directory": directory, "tag": tag, "type": kind, "count": count, "value": short if kind == 3 and count == 1 else value}
            if tag == 0x8769:
                todo.append((tag, value))


def _exif(data: bytes) -> Iterator[dict]:
    for s in _segments(data):
        if s["marker"] == 0xE1 and data[s["start"] + 4 : s["start"] + 10] == b"Exif\0\0":
            yield from _tiff(data, s["start"] + 10)
            return


def exif_entries(df: DataFrame) -> DataFrame:
    """(path, directory, tag, type, count, value); directory 0 is the first, 34665 the Exif one."""
    return _rows(df, _exif, {"directory": pa.int32(), "tag": pa.int32(), "type": pa.int32(), "count": pa.int64(), "value": pa.int64()}, "directory int, tag int, type int, count long, value long")


def colour_space(entries: DataFrame) -> DataFrame:
    """Exif ColorSpace of each file that has one."""
    return entries.where((F.col("directory") == 0x8769) & (F.col("tag") == 0xA001)).groupBy("path").agg(F.first("value").alias("colour_space"))


def _boxes(data: bytes) -> Iterator[dict]:
    """ISO boxes, those inside containers too, with their depth."""
    todo = [(0, len(data), 0)]
    while todo:
        at, end, depth = todo.pop()
        while at + 8 <= end:
            size, kind = struct.unpack_from(">I4s", data, at)
            head = 8
            if size == 1:
                size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
            size = size or end - at
            if size < head or at + size > end:
                break
            yield {"kind": kind.decode("latin-1"), "depth": depth, "start": at, "length": size}
            if kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"iprp", b"ipco", b"meta"):
                todo.append((at + head + (4 if kind == b"meta" else 0), at + size, depth + 1))
            at += size


def iso_boxes(df: DataFrame) -> DataFrame:
    return _rows(df, _boxes, {"kind": pa.string(), "depth": pa.int32(), "start": pa.int64(), "length": pa.int64()}, "kind string, depth int, start long, length long")


def box_fields(df: DataFrame, boxes: DataFrame, kind: str) -> DataFrame:
    """Content of each box of a kind, without its eight bytes of head."""
    part = F.substr("content", (F.col("start") + 9).cast("int"), (F.col("length") - 8).cast("int"))
    return boxes.where(F.col("kind") == kind).join(df.select("path", "content"), "path").select("path", "start", part.alias("payload"))


def _unsigned(payload: Column, at: int, width: int) -> Column:
    return F.conv(F.hex(F.substring(payload, at + 1, width)), 16, 10).cast("long")


def hevc_profile(payload: Column) -> Column:
    """Profile, chroma format and bit depths of an HEVC decoder configuration."""
    byte = lambda i: _unsigned(payload, i, 1)
    fields = [byte(1).bitwiseAND(31).alias("profile"), byte(16).bitwiseAND(3).alias("chroma_format"), (byte(17).bitwiseAND(7) + 8).alias("luma_depth"), (byte(18).bitwiseAND(7) + 8).alias("chroma_depth")]
    return F.when(F.length(payload) >= 19, F.struct(*fields))


def rational(payload: Column, at: int, signed: bool = False) -> Column:
    """A 32-bit numerator over a 32-bit denominator; null over zero."""
    n = _unsigned(payload, at, 4)
    n = F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n) if signed else n
    return F.try_divide(n.cast("double"), _unsigned(payload, at + 4, 4).cast("double"))
