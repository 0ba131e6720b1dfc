"""Dual-layer files: sound ones in both byte orders, and one for each broken rule."""

import struct

import pytest

from siftworks.sources import dual_layer as dl


def segment(marker, body):
    return bytes((0xFF, marker)) + struct.pack(">H", len(body) + 2) + body


SCAN = segment(0xDA, b"\1\1\0\0\x3f\0") + b"scan \xff\0 data \xff\xd0 more" + b"\xff\xd9"


def index(order, entries, count=None, version=True, tags=(), magic=42):
    fields = ([(dl.VERSION, 7, 4, 0x30303130)] if version else []) + [(dl.COUNT, 4, 1, len(entries) if count is None else count), (dl.ENTRIES, 7, 16 * len(entries), 8 + 2 + 12 * (2 + version + len(tags)) + 4), *tags]
    head = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", magic, 8) + struct.pack(order + "H", len(fields))
    return dl.MPF + head + b"".join(struct.pack(order + "HHII", *f) for f in fields) + b"\0\0\0\0" + b"".join(struct.pack(order + "IIIHH", *e) for e in entries)


def dual(order="<", base=(segment(0xE2, dl.ISO + b"\0\0\0\0"), segment(0xE2, dl.ICC + b"x")), gain=(segment(0xE2, dl.ISO + b"\0\0\0\0params"),), shift=(0, 0, 0, 0), between=b"", n=2, **kw):
    two = b"\xff\xd8" + b"".join(gain) + SCAN
    made = lambda e: segment(0xE2, index(order, e, **kw))
    size = len(made([(0,) * 5] * n))
    one_end = 2 + size + sum(map(len, base)) + len(SCAN)
    entries = [(0x30000, one_end + shift[0], shift[1], 0, 0), (0, len(two) + shift[2], one_end + len(between) - (2 + 4 + 4) + shift[3], 0, 0), (0, 0, 0, 0, 0)][:n]
    return b"\xff\xd8" + made(entries) + b"".join(base) + SCAN + between + two


CASES = {
    "sound": (dual(), None, None), "big": (dual(">"), None, None), "bare": (dual(base=(), gain=()), None, None), "t35": (dual(base=(segment(0xE8, dl.T35 + b"..."),), gain=(segment(0xE8, dl.T35 + b"..."),)), None, None),
    "empty": (b"", "two images", None), "text": (b"no image", "two images", None), "one": (b"\xff\xd8" + SCAN, "two images", None), "three": (dual() + b"\xff\xd8" + SCAN, "two images", None), "cut": (dual()[:-2], "whole images", None),
    "no index": ((b"\xff\xd8" + SCAN) * 2, "one index", None), "two indexes": (dual(base=(segment(0xE2, index("<", [(0,) * 5])),)), "one index", None),
    "magic": (dual(magic=43), "index", "magic"), "no version": (dual(version=False), "index", "no version"), "count": (dual(count=3), "index", "count differs"), "count twice": (dual(tags=((dl.COUNT, 4, 1, 2),)), "index", "count twice"), "version form": (dual(tags=((dl.VERSION, 4, 1, 2),)), "index", "version form"),
    "three entries": (dual(n=3), "two entries", None), "first size": (dual(shift=(1, 0, 0, 0)), "first entry", None), "first offset": (dual(shift=(0, 5, 0, 0)), "first entry", None), "second size": (dual(shift=(0, 0, -1, 0)), "second entry", None), "second offset": (dual(shift=(0, 0, 0, 2)), "second entry", None),
    "second in first": (dual(shift=(0, 0, 0, -40)), "second entry", None), "declaration": (dual(base=(segment(0xE2, dl.ISO + b"\0\0\0\0x"),)), "primary declaration", None), "declared version": (dual(base=(segment(0xE2, dl.ISO + b"\0\1\0\0"),)), "primary declaration", None),
    "declared twice": (dual(base=(segment(0xE2, dl.ISO + b"\0\0\0\0"),) * 2), "one declaration", None), "parameters": (dual(gain=(segment(0xE2, dl.ISO + b"\0\0\0\0"),)), "gain-map parameters", None), "parameters twice": (dual(gain=(segment(0xE2, dl.ISO + b"\0\0\0\0p"),) * 2), "one set of parameters", None),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, raw) for name, (raw, *_) in CASES.items()] + [("null", None)]
    return {r.path: r for r in dl.index_dual_layer(spark.createDataFrame(rows, "path string, content binary")).collect()}


def test_every_rule(found):
    assert {n: (r.rule, r.detail) for n, r in found.items()} == {n: (rule, detail) for n, (_, rule, detail) in CASES.items()} | {"null": ("two images", None)}


def test_ranges(found):
    for name in ("sound", "big", "bare", "t35"):
        r, raw = found[name], CASES[name][0]
        assert (r.base_start, r.base_end, r.gain_end) == (0, r.gain_start, len(raw)) and raw[r.gain_start : r.gain_start + 2] == b"\xff\xd8" and raw[r.tiff : r.tiff + 2] in (b"II", b"MM")
    assert (found["sound"].base_declares, found["sound"].gain_has_parameters, found["sound"].base_has_icc, found["sound"].gain_has_icc) == (True, True, True, False)
    assert found["t35"].t35_start == CASES["t35"][0].index(b"\xff\xe8") and found["t35"].gain_has_t35 and not found["bare"].gain_has_parameters


def test_entries(spark):
    df = spark.createDataFrame([("p", dual())], "path string, content binary")
    rows = dl.placed_entries(dl.mp_entries(df), dl.jpeg_images(df)).orderBy("entry").collect()
    assert [(r.entry, r.attributes, r.in_image, r.exact) for r in rows] == [(0, 0x30000, 0, True), (1, 0, 1, True)]
