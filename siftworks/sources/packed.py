"""Packed records: a bit reader over stacks of payloads, and the registered HDR metadata it reads.

A stack of payloads is one array of bytes.  A field is read for all of them at once: each payload
has its own place in bits, and only those that have the field move on.  Optional and repeated parts
are masks, so a record of any shape takes the same few array operations; the first rule that a
payload breaks is its reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_STACK = 256  # payloads read at a time

# The identity of the record, its kinds, and the names and widths of its packed fields.
PREFIX = bytes((0x26, 0, 4, 0, 7, 2))
APP8 = b"ITUT35"
PLAIN, MAPPED = 0x02010000, 0x02010100
STATISTICS = ("minimum", "average", "variance", "maximum")
BASE = (("m_p", 14), ("m_m", 6), ("m_a", 10), ("m_n", 6), ("m_b", 10), ("k1", 2), ("k2", 2), ("k3", 4), ("delta_mode", 3), ("delta", 7))
SPLINE = (("threshold", 12), ("delta1", 10), ("delta2", 10), ("strength", 8))
DISPLAY = ("red_x", "red_y", "green_x", "green_y", "blue_x", "blue_y", "white_x", "white_y")
_TWO_HAVE_MB = (0, 2)


class Stack:
    """Payloads side by side, each with its own place."""

    def __init__(self, payloads: list[bytes | None]):
        self.n = len(payloads)
        self.size = np.array([len(p or b"") for p in payloads], np.int64) * 8
        self.data = np.zeros((self.n, int(self.size.max(initial=0)) // 8 + 8), np.uint8)
        for i, p in enumerate(payloads):
            self.data[i, : len(p or b"")] = np.frombuffer(p or b"", np.uint8)
        self.at = np.zeros(self.n, np.int64)
        self.reason = np.full(self.n, None, object)

    @property
    def sound(self) -> np.ndarray:
        return self.reason == None  # noqa: E711  element by element

    def fail(self, where: np.ndarray, reason: str) -> None:
        self.reason[where & self.sound] = reason

    def read(self, width: int, where: np.ndarray | bool = True, end: np.ndarray | None = None) -> np.ndarray:
        """The next width bits, up to 32, where asked for; 0 elsewhere.  end: place that must not be passed."""
        ask = where & self.sound
        self.fail(ask & (self.at + width > (self.size if end is None else np.minimum(end, self.size))), "truncated")
        ask = ask & self.sound
        first = self.at // 8
        value = np.zeros(self.n, np.uint64)
        rows = np.arange(self.n)
        for k in range(5):  # 32 bits at any place lie in five bytes
            value = (value << np.uint64(8)) | self.data[rows, np.minimum(first + k, self.data.shape[1] - 1)]
        value = (value >> (40 - width - self.at % 8).astype(np.uint64)) & np.uint64((1 << width) - 1)
        self.at = np.where(ask, self.at + width, self.at)
        return np.where(ask, value.astype(np.int64), 0)


def _static(s: Stack, has: np.ndarray) -> dict[str, np.ndarray]:
    out = {name: s.read(16, has) for name in DISPLAY}
    out |= {"maximum_luminance": s.read(32, has), "minimum_luminance": s.read(32, has), "maximum_content": s.read(16, has), "maximum_average": s.read(16, has)}
    for c in ("red", "green", "blue", "white"):
        x, y = out[f"{c}_x"], out[f"{c}_y"]
        s.fail(has & ((y == 0) | (x + y > 50_000)), "chromaticity")
    s.fail(has & ((out["maximum_luminance"] == 0) | (out["minimum_luminance"] >= out["maximum_luminance"])), "display luminance")
    s.fail(has & (out["maximum_content"] != 0) & (out["maximum_average"] > out["maximum_content"]), "content light")
    return out


def _dynamic(s: Stack, has: np.ndarray, end: np.ndarray) -> dict:
    read = lambda width, where: s.read(width, where, end)
    s.fail((read(8, has) != 1) & has, "version")
    out: dict = {"statistics": {n: read(12, has) for n in STATISTICS}}
    low, mean, high = (out["statistics"][n] for n in ("minimum", "average", "maximum"))
    s.fail(has & ((low > mean) | (mean > high)), "statistics")
    mapped = has & (read(1, has) == 1)
    n_maps = np.where(mapped, read(1, mapped) + 1, 0)
    out["maps"] = []
    for i in range(2):
        here = n_maps > i
        one = {"there": here, "target": read(12, here)}
        based = here & (read(1, here) == 1)
        one["based"], one["base"] = based, {n: read(w, based) for n, w in BASE}
        bent = here & (read(1, here) == 1)
        n_splines = np.where(bent, read(1, bent) + 1, 0)
        one["splines"] = []
        for j in range(2):
            on = n_splines > j
            mode = read(2, on)
            with_mb = on & np.isin(mode, _TWO_HAVE_MB)
            one["splines"].append({"there": on, "mode": mode, "with_mb": with_mb, "mb": read(8, with_mb)} | {n: read(w, on) for n, w in SPLINE})
        out["maps"].append(one)
    gained = has & (read(1, has) == 1)
    n_gains = read(3, gained)
    out["gains"] = [(n_gains > i, read(8, n_gains > i)) for i in range(7)]
    left = end - s.at
    s.fail(has & (left > 7), "tail")
    for _ in range(7):
        s.fail(read(1, has & s.sound & (s.at < end)) != 0, "padding")
    return out


def _registered(payloads: list[bytes | None]) -> list[dict]:
    """One record a payload, reason in it where a rule is broken."""
    s = Stack([p[len(APP8) :] if p is not None and p.startswith(APP8) else p for p in payloads])
    for byte in PREFIX:
        s.fail(s.read(8) != byte, "identity")
    kind = s.read(32)
    s.fail((kind != PLAIN) & (kind != MAPPED), "kind")
    size = s.read(16) * 8
    section = s.at + size
    s.fail(section > s.size, "truncated")
    static_size = s.read(16, True, section)
    s.fail((static_size != 0) & (static_size != 28), "static size")
    has_static = s.sound & (static_size == 28)
    s.fail(has_static & (s.at + 28 * 8 > section), "truncated")
    static = _static(s, has_static)
    dynamic_size = s.read(16, True, section)
    has_dynamic = s.sound & (dynamic_size > 0)
    end = s.at + dynamic_size * 8
    s.fail(has_dynamic & (end > section), "truncated")
    dynamic = _dynamic(s, has_dynamic, end)
    s.fail(s.at != section, "section size")
    has_map = s.sound & (kind == MAPPED)
    map_size = s.read(16, has_map)
    map_end = s.at + map_size * 8
    s.fail(has_map & (map_end > s.size), "truncated")
    parts = []
    for _ in range(2):
        length = s.read(16, has_map, map_end) * 8
        s.fail(has_map & (s.at + length > map_end), "truncated")
        parts.append((s.at.copy(), length))
        s.at = np.where(has_map & s.sound, s.at + length, s.at)
    s.fail(has_map & (s.at != map_end), "mapping tail")
    s.fail(s.at != s.size, "tail")
    s.fail(~has_static & ~has_dynamic & ~has_map, "nothing")
    out = []
    at = lambda d, i: {k: int(v[i]) for k, v in d.items()}
    for i in range(s.n):
        row: dict = {"reason": s.reason[i], "display": None, "statistics": None, "tone_maps": None, "gains": None, "base_mapping": None, "combined_mapping": None}
        if s.reason[i] is None:
            if has_static[i]:
                row["display"] = at(static, i)
            if has_dynamic[i]:
                row["statistics"] = at(dynamic["statistics"], i)
                row["tone_maps"] = [
                    {"target": int(m["target"][i]), "base": at(m["base"], i) if m["based"][i] else None,
                     "splines": [{"mode": int(p["mode"][i]), "mb": int(p["mb"][i]) if p["with_mb"][i] else None, **{n: int(p[n][i]) for n, _ in SPLINE}} for p in m["splines"] if p["there"][i]]}
                    for m in dynamic["maps"] if m["there"][i]
                ]
                row["gains"] = [int(v[i]) for there, v in dynamic["gains"] if there[i]]
            for name, (start, length) in zip(("base_mapping", "combined_mapping"), parts, strict=True):
                if has_map[i] and length[i]:
                    row[name] = s.data[i, start[i] // 8 : (start[i] + length[i]) // 8].tobytes()
        out.append(row)
    return out


_DISPLAY = (*DISPLAY, "maximum_luminance", "minimum_luminance", "maximum_content", "maximum_average")
_fields = lambda names, kind: ",".join(f"{n}:{kind}" for n in names)
_SPLINE_DDL = f"mode:int,mb:int,{_fields([n for n, _ in SPLINE], 'int')}"
_DDL = (
    f"reason string, display struct<{_fields(_DISPLAY, 'bigint')}>, statistics struct<{_fields(STATISTICS, 'int')}>, tone_maps array<struct<target:int,base:struct<{_fields([n for n, _ in BASE], 'int')}>,splines:array<struct<{_SPLINE_DDL}>>>>, "
    "gains array<int>, base_mapping binary, combined_mapping binary"
)


def _arrow() -> list[pa.Field]:
    ints = lambda names, t: pa.struct([(n, t) for n in names])
    spline = ints(("mode", "mb", *(n for n, _ in SPLINE)), pa.int32())
    tone = pa.struct([("target", pa.int32()), ("base", ints([n for n, _ in BASE], pa.int32())), ("splines", pa.list_(spline))])
    return [
        pa.field("reason", pa.string()), pa.field("display", ints(_DISPLAY, pa.int64())), pa.field("statistics", ints(STATISTICS, pa.int32())), pa.field("tone_maps", pa.list_(tone)),
        pa.field("gains", pa.list_(pa.int32())), pa.field("base_mapping", pa.binary()), pa.field("combined_mapping", pa.binary()),
    ]


def registered_hdr(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """df (keys, payload) -> keys and the record: display, statistics, tone_maps, gains, mappings as they stand.

    The payload may stand behind the identity of its JPEG segment.  reason says which rule was broken,
    and then nothing else is given; null and empty payloads are truncated.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    fields = _arrow()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _STACK):
                part = batch.slice(start, _STACK)
                rows = _registered(part.column(len(keys)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *(pa.array([r[f.name] for r in rows], f.type) for f in fields)], names=[*keys, *(f.name for f in fields)])

    return df.select(*keys, payload).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), _DDL]))
