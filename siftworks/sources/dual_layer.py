"""Dual-layer JPEG: the multi-picture index of a file against the images that stand in it.

Three tables come out of one walk over a file: the images as intervals, the application segments
that say what an image carries, and the entries of the multi-picture index with where they point.
Joining entries with the intervals they fall into shows what a declared place really is; every
broken rule is a row, and a file without one is a row of ranges.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftworks.sources.media import _rows, _segments

# Identities of application segments, and tags, types and sizes of the index.
MPF, ISO, ICC, T35 = b"MPF\0", b"urn:iso:std:iso:ts:21496:-1\0", b"ICC_PROFILE\0", b"ITUT35"
VERSION, COUNT, ENTRIES = 0xB000, 0xB001, 0xB002
_LONG, _UNDEFINED, _ENTRY = 4, 7, 16


def _images(data: bytes) -> Iterator[dict]:
    """The images of a file: from a start marker to behind the end marker; without one, whole is false."""
    at, end, whole = -1, 0, False
    for s in _segments(data):
        if s["marker"] == 0xD8:
            if at >= 0:
                yield {"image": s["image"] - 1, "start": at, "end": end, "whole": whole}
            at, whole = s["start"], False
        end = s["start"] + s["length"]
        whole = whole or s["marker"] == 0xD9
    if at >= 0:
        yield {"image": s["image"], "start": at, "end": end, "whole": whole}


def jpeg_images(df: DataFrame) -> DataFrame:
    return _rows(df, _images, {"image": pa.int32(), "start": pa.int64(), "end": pa.int64(), "whole": pa.bool_()}, "image int, start long, end long, whole boolean")


def _carried(data: bytes) -> Iterator[dict]:
    for s in _segments(data):
        body = data[s["start"] + 4 : s["start"] + s["length"]]
        for kind, marker, identity in (("mpf", 0xE2, MPF), ("iso", 0xE2, ISO), ("icc", 0xE2, ICC), ("t35", 0xE8, T35)):
            if s["marker"] == marker and body.startswith(identity):
                rest = body[len(identity) :]
                version = struct.unpack(">H", rest[:2])[0] if kind == "iso" and len(rest) >= 2 else None
                yield {"image": s["image"], "kind": kind, "start": s["start"], "body": s["start"] + 4 + len(identity), "size": len(rest), "version": version}


def carried(df: DataFrame) -> DataFrame:
    """(path, image, kind, start, body, size, version): segments that carry an index, gain-map metadata, a profile or a T.35 record."""
    return _rows(df, _carried, {"image": pa.int32(), "kind": pa.string(), "start": pa.int64(), "body": pa.int64(), "size": pa.int64(), "version": pa.int32()}, "image int, kind string, start long, body long, size long, version int")


def _index(tiff: bytes) -> tuple[str | None, list[tuple]]:
    """What is wrong with an index, or its entries (attributes, size, offset, two dependent images)."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None:
        return "byte order", []
    if len(tiff) < 8 or struct.unpack_from(order + "H", tiff, 2)[0] != 42:
        return "magic", []
    at = struct.unpack_from(order + "I", tiff, 4)[0]
    if at + 2 > len(tiff):
        return "directory outside", []
    n = struct.unpack_from(order + "H", tiff, at)[0]
    if at + 2 + 12 * n > len(tiff):
        return "directory outside", []
    told: dict[int, list[tuple]] = {}
    for i in range(n):
        tag, kind, count, value = struct.unpack_from(order + "HHII", tiff, at + 2 + 12 * i)
        told.setdefault(tag, []).append((kind, count, value))
    for tag, kind, count, name in ((VERSION, _UNDEFINED, 4, "version"), (COUNT, _LONG, 1, "count"), (ENTRIES, _UNDEFINED, None, "entries")):
        if tag not in told:
            return f"no {name}", []
        if any(k != kind or count is not None and c != count for k, c, _ in told[tag]):
            return f"{name} form", []
        if tag != VERSION and len(told[tag]) > 1:
            return f"{name} twice", []
    _, size, start = told[ENTRIES][0]
    if size == 0 or size % _ENTRY or start + size > len(tiff):
        return "entries form" if size == 0 or size % _ENTRY else "entries outside", []
    entries = list(struct.iter_unpack(order + "IIIHH", tiff[start : start + size]))
    return ("count differs", []) if told[COUNT][0][2] != len(entries) else (None, entries)


def _entries(data: bytes) -> Iterator[dict]:
    for s in _carried(data):
        if s["kind"] == "mpf":
            wrong, entries = _index(data[s["body"] : s["body"] + s["size"]])
            if wrong:
                yield {"image": s["image"], "tiff": s["body"], "problem": wrong}
            for i, (attributes, size, offset, one, two) in enumerate(entries):
                # The first image is told from the start of the file, the others from the index's header.
                yield {"image": s["image"], "tiff": s["body"], "entry": i, "attributes": attributes, "size": size, "offset": offset, "dependent_1": one, "dependent_2": two, "at": s["body"] + offset if offset else 0}


def mp_entries(df: DataFrame) -> DataFrame:
    """(path, image, tiff, entry, attributes, size, offset, dependent_1, dependent_2, at, problem): at is the place in the file."""
    fields = {"image": pa.int32(), "tiff": pa.int64(), "entry": pa.int32(), "attributes": pa.int64(), "size": pa.int64(), "offset": pa.int64(), "dependent_1": pa.int32(), "dependent_2": pa.int32(), "at": pa.int64(), "problem": pa.string()}
    return _rows(df, _entries, fields, "image int, tiff long, entry int, attributes long, size long, offset long, dependent_1 int, dependent_2 int, at long, problem string")


def placed_entries(entries: DataFrame, images: DataFrame) -> DataFrame:
    """entries with the image they fall into (in_image, null if none) and whether they tell it exactly."""
    inside = images.select(F.col("path").alias("_p"), F.col("image").alias("in_image"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    joined = entries.join(inside, (F.col("path") == F.col("_p")) & (F.col("at") >= F.col("_s")) & (F.col("at") < F.col("_e")), "left")
    return joined.withColumn("exact", F.coalesce((F.col("at") == F.col("_s")) & (F.col("at") + F.col("size") == F.col("_e")), F.lit(False))).drop("_p", "_s", "_e")


#: In the order in which they are told; a file has the first it breaks.
RULES = ("two images", "whole images", "one index", "index", "two entries", "first entry", "second entry", "primary declaration", "one declaration", "gain-map parameters", "one set of parameters")


def index_dual_layer(df: DataFrame) -> DataFrame:
    """df (path, content) -> one row a file: the ranges of its two layers and what they carry, or the first broken rule.

    detail says what is wrong with an index.  A file without an image breaks the first rule.
    """
    images, parts = jpeg_images(df), carried(df)
    entries = placed_entries(mp_entries(df), images)
    count = lambda test: F.count_if(test)
    of = lambda c, i: F.max(F.when(F.col("image") == i, F.col(c)))
    a = images.groupBy("path").agg(F.count(F.lit(1)).alias("n_images"), F.bool_and("whole").alias("all_whole"), of("start", 0).alias("base_start"), of("end", 0).alias("base_end"), of("start", 1).alias("gain_start"), of("end", 1).alias("gain_end"))
    has = lambda kind, i, test=F.lit(True): (F.col("kind") == kind) & (F.col("image") == i) & test
    b = parts.groupBy("path").agg(
        count(has("mpf", 0)).alias("n_index"), count(has("iso", 0)).alias("n_declared"), count(has("iso", 0, (F.col("size") != 4) | (F.col("version") != 0) | F.col("version").isNull())).alias("bad_declared"),
        count(has("iso", 1)).alias("n_parameters"), count(has("iso", 1, F.col("size") <= 4)).alias("bad_parameters"), count(has("icc", 0)).alias("n_icc"), count(has("icc", 1)).alias("n_gain_icc"),
        F.min(F.when(has("t35", 0), F.col("start"))).alias("t35_start"), count(has("t35", 1)).alias("n_gain_t35"),
    )
    mine = entries.where("image = 0")
    right = lambda entry, test: F.coalesce(F.bool_or((F.col("entry") == entry) & test), F.lit(False))
    c = mine.groupBy("path").agg(
        F.max("problem").alias("detail"), F.count("entry").alias("n_entries"), F.max("tiff").alias("tiff"), F.max("attributes").alias("gain_attributes"),
        right(0, (F.col("offset") == 0) & (F.col("in_image") == 0) & F.col("exact")).alias("first_right"), right(1, (F.col("offset") > 0) & (F.col("in_image") == 1) & F.col("exact")).alias("second_right"),
    )
    every = df.select("path").join(a, "path", "left").join(b, "path", "left").join(c, "path", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    broken = [
        zero("n_images") != 2, ~F.col("all_whole"), zero("n_index") != 1, F.col("detail").isNotNull(), zero("n_entries") != 2, ~F.col("first_right"), ~F.col("second_right"),
        zero("bad_declared") > 0, zero("n_declared") > 1, zero("bad_parameters") > 0, zero("n_parameters") > 1,
    ]
    rule = F.lit(None).cast("string")
    for name, test in reversed(list(zip(RULES, broken, strict=True))):
        rule = F.when(test, name).otherwise(rule)
    told = every.withColumn("rule", rule)
    sound = lambda c: F.when(F.col("rule").isNull(), c)
    return told.select(
        "path", "rule", F.when(F.col("rule") == "index", F.col("detail")).alias("detail"), *(sound(F.col(c)).alias(c) for c in ("base_start", "base_end", "gain_start", "gain_end", "tiff", "t35_start")),
        *(sound(zero(c) > 0).alias(name) for c, name in (("n_declared", "base_declares"), ("n_parameters", "gain_has_parameters"), ("n_icc", "base_has_icc"), ("n_gain_icc", "gain_has_icc"), ("n_gain_t35", "gain_has_t35"))),
    )
