"""GIF media columns: write and read GIF89a, frame by frame, with colour histograms.

The reader follows the container block by block, decodes the LZW code streams, undoes interlacing,
applies local or global palettes, transparency and disposal to a canvas, and gives timed frames.
The widths of the codes after a clear code depend only on how many have been read, so all codes up
to the next clear code are cut from the bit stream at once and then expanded one by one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WIDTH = 576  # samples in a row, and the unit to which payloads are filled up
ROWS = 16  # rows of a frame at most
DELAY = 10  # hundredths of a second for each frame
FILL = 255
BINS = 4  # histogram bins for each of red, green and blue
_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
MOST_PIXELS = 1 << 26  # canvas of a file that is read
_FLUSH = 8 << 20


# --- LZW -------------------------------------------------------------------------------------


def _widths(n: int, size: int) -> np.ndarray:
    """Widths of the n codes that follow a clear code: the first 2**size - 1 have size + 1 bits, twice as many the next width, at most 12."""
    ends = np.cumsum([(1 << size) - 1, *(1 << w for w in range(size + 1, 12))])
    return np.searchsorted(ends, np.arange(n), side="right") + size + 1


def _pack_codes(codes: np.ndarray, widths: np.ndarray) -> bytes:
    ends = np.cumsum(widths)
    bits = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    starts = ends - widths
    for b in range(int(widths.max()) if len(widths) else 0):
        some = widths > b
        bits[starts[some] + b] = (codes[some] >> b) & 1
    return np.packbits(bits, bitorder="little").tobytes()


def lzw_encode(values: np.ndarray, size: int = 8) -> bytes:
    """Samples below 2**size as a code stream: longest known strings, the dictionary cleared when it is full."""
    clear, codes, widths = 1 << size, [np.array([1 << size])], [np.array([size + 1])]
    samples = iter(np.asarray(values).tolist())
    held = next(samples, None)
    while held is not None:
        table: dict[int, int] = {}
        free, run = clear + 2, []
        for v in samples:
            longer = held << 8 | v
            known = table.get(longer)
            if known is not None:
                held = known
                continue
            run.append(held)
            held = v
            table[longer] = free
            free += 1
            if free == 4096:
                run.append(clear)
                break
        else:
            run.append(held)
            held = None
        codes.append(np.array(run))
        widths.append(_widths(len(run), size))
    after = len(codes[-1]) if len(codes) > 1 else 0
    codes.append(np.array([clear + 1]))
    widths.append(_widths(after + 1, size)[-1:])
    return _pack_codes(np.concatenate(codes), np.concatenate(widths))


def _expand(codes: list[int], clear: int, out: bytearray) -> None:
    """Append what the codes after one clear code stand for.

    Dictionary entry i is what code i stands for and one sample more, so it already stands in the
    output: the entry is the stretch that starts where code i was written.
    """
    first, starts = clear + 2, []
    for c in codes:
        at = len(out)
        if c < clear:
            out.append(c)
        else:
            i = c - first
            if not 0 <= i < len(starts):
                raise ValueError("code beyond the table")
            start = starts[i]
            end = (starts[i + 1] if i + 1 < len(starts) else at) + 1
            if end <= at:
                out += out[start:end]
            else:  # the entry is the one that this code completes: its last sample is its first
                out += out[start:at]
                out.append(out[start])
        starts.append(at)


def lzw_decode(data: bytes, size: int, expected: int) -> bytes:
    """Samples of a code stream; ValueError if it is corrupt.  Stops once expected samples are out."""
    clear = 1 << size
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    at, out = 0, bytearray()
    while len(out) < expected and at + size + 1 <= len(bits):
        stretch: list[np.ndarray] = []
        width, room, ended = size + 1, clear - 1, False
        while at + width <= len(bits):
            n = (len(bits) - at) // width
            n = min(n, 4096) if width == 12 else min(n, room)
            codes = bits[at : at + n * width].reshape(n, width).astype(np.int32) @ (1 << np.arange(width, dtype=np.int32))
            stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stops):
                s = int(stops[0])
                stretch.append(codes[:s])
                at += (s + 1) * width
                ended = codes[s] == clear + 1
                break
            stretch.append(codes)
            at += n * width
            if width < 12:
                room -= n
                if room == 0:
                    room, width = 1 << width, width + 1
        _expand(np.concatenate(stretch).tolist() if stretch else [], clear, out)
        if ended:
            break
    if len(out) < expected:
        raise ValueError("code stream ends early")
    return bytes(out[:expected])


# --- container -------------------------------------------------------------------------------


def _sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """Payload bytes as grey samples, top to bottom and frame to frame; len(payload) is a multiple of width."""
    lines = len(payload) // width
    head = b"GIF89a" + struct.pack("<HHBBB", width, min(lines, rows), 0xF7, 0, 0) + _GREY
    parts = [head]
    samples = np.frombuffer(payload, np.uint8)
    for top in range(0, lines, rows):
        high = min(rows, lines - top)
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0")
        parts.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, high, 0) + b"\x08")
        parts.append(_sub_blocks(lzw_encode(samples[top * width : (top + high) * width])))
    return b"".join(parts) + b"\x3b"


@dataclass
class Frame:
    """One frame: its own rectangle of palette indexes, and the canvas after drawing it (RGBA)."""

    left: int
    top: int
    indexes: np.ndarray
    canvas: np.ndarray
    delay_ms: int


def _interlaced(high: int) -> np.ndarray:
    """Row at which each stored row belongs."""
    return np.concatenate([np.arange(first, high, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode_gif(data: bytes, most_pixels: int = MOST_PIXELS) -> Iterator[Frame]:
    """Timed frames in order; ValueError where the file is corrupt.

    A file whose header asks for a canvas of more than most_pixels counts as corrupt.
    """
    try:
        yield from _decoded(data, most_pixels)
    except (IndexError, struct.error) as short:
        raise ValueError("file ends inside a block") from short


def _decoded(data: bytes, most_pixels: int) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    wide, tall, flags = struct.unpack_from("<HHB", data, 6)
    if wide * tall > most_pixels:
        raise ValueError("canvas too large")
    at, common = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        common = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        at += n
    canvas = np.zeros((tall, wide, 4), dtype=np.uint8)
    disposal, delay, clear_index = 0, 0, -1

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while True:
            if at >= len(data):
                raise ValueError("file ends inside a block")
            n = data[at]
            if n == 0:
                return b"".join(parts), at + 1
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n

    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else -1
            continue
        if kind != 0x2C or at + 11 > len(data):
            raise ValueError("unknown block")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = common
        if packed & 0x80:
            n = 3 << ((packed & 7) + 1)
            palette = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
            at += n
        if palette is None:
            raise ValueError("no palette")
        size = data[at]
        if not 1 <= size <= 8:
            raise ValueError("bad code size")
        body, at = blocks(at + 1)
        indexes = np.frombuffer(lzw_decode(body, size, w * h), np.uint8).reshape(h, w)
        if packed & 0x40:
            straight = np.empty_like(indexes)
            straight[_interlaced(h)] = indexes
            indexes = straight
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        seen = indexes[: area.shape[0], : area.shape[1]]
        colours = np.zeros((256, 3), dtype=np.uint8)
        colours[: len(palette)] = palette
        if clear_index < 0:
            area[..., :3] = colours[seen]
            area[..., 3] = 255
        else:
            drawn = seen != clear_index
            area[drawn, :3] = colours[seen[drawn]]
            area[drawn, 3] = 255
        yield Frame(left, top, indexes, canvas.copy(), delay * 10)
        if disposal == 2:
            area[...] = 0
        elif before is not None:
            canvas = before
        disposal, delay, clear_index = 0, 0, -1


def frames_of(data: bytes) -> Iterator[Frame]:
    """Timed frames up to the end or to the first damage."""
    try:
        yield from decode_gif(data)
    except ValueError:
        return


def histogram(pixels: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Counts of opaque RGBA pixels in bins**3 colour cells, red slowest."""
    step = 256 // bins
    solid = pixels.reshape(-1, 4)
    cell = (solid[:, 0] // step).astype(np.int64) * bins * bins + (solid[:, 1] // step).astype(np.int64) * bins + solid[:, 2] // step
    return np.bincount(cell[solid[:, 3] > 0], minlength=bins**3)


# --- DataFrames ------------------------------------------------------------------------------


def _flushed(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size > _FLUSH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema)


def text_to_gif(docs: DataFrame, unit: int = WIDTH) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_bytes, media): the text's UTF-8 as a GIF of grey samples.

    Bytes 255 fill it up to a positive multiple of unit.  A null text is empty.  One row each; equal
    texts give equal media; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[dict, int]]:
            for batch in batches:
                for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                    raw = (text.as_py() or "").encode()
                    media = encode_gif(raw + bytes([FILL]) * (max(1, -(-len(raw) // unit)) * unit - len(raw)), unit)
                    yield {"doc_id": doc.as_py(), "n_bytes": len(raw), "media": media}, len(media)

        yield from _flushed(rows(), schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


FRAME_SCHEMA = "media_id long, frame int, start_ms long, delay_ms int, left int, top int, width int, height int, indexes binary, rgba binary, histogram array<long>"


def read_frames(media: DataFrame) -> DataFrame:
    """media (media_id, media) -> one row per timed frame, with pixels and colour histogram.

    A null, empty or foreign file has no frames; a corrupt one has those before the damage.
    """
    fields = ("media_id", "frame", "start_ms", "delay_ms", "left", "top", "width", "height", "indexes", "rgba", "histogram")
    kinds = (pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.binary(), pa.list_(pa.int64()))
    schema = pa.schema(list(zip(fields, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[dict, int]]:
            for batch in batches:
                for key, data in zip(batch.column(0), batch.column(1), strict=True):
                    at = 0
                    for i, f in enumerate(frames_of(data.as_py() or b"")):
                        values = (key.as_py(), i, at, f.delay_ms, f.left, f.top, f.indexes.shape[1], f.indexes.shape[0], f.indexes.tobytes(), f.canvas.tobytes(), histogram(f.canvas).tolist())
                        yield dict(zip(fields, values, strict=True)), f.canvas.size
                        at += f.delay_ms

        yield from _flushed(rows(), schema)

    return media.select(F.col("media_id").cast("long").alias("media_id"), "media").mapInArrow(run, FRAME_SCHEMA)


def media_digests(media: DataFrame) -> DataFrame:
    """media (doc_id, n_bytes, media) of text_to_gif() -> digests of what is read back from the bytes.

    The payload is the frames' samples in order.  feature is the number of frames, the running time
    in ms and the frames' summed colour histogram, as read_frames() gives them, comma-joined.  A null,
    empty or foreign file has no frames and an empty payload; a corrupt one has those before the damage.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, n, data in zip(*batch.columns, strict=True):
                raw = data.as_py() or b""
                drawn, time = [], 0
                colours = np.zeros(BINS**3, dtype=np.int64)
                for f in frames_of(raw):
                    drawn.append(f.indexes.tobytes())
                    colours += histogram(f.canvas)
                    time += f.delay_ms
                payload = b"".join(drawn)
                feature = ",".join(map(str, [len(drawn), time, *colours.tolist()]))
                out.append((doc.as_py(), n.as_py(), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), sha256(raw).hexdigest(), feature))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
