"""Small HEIF files with a gain map, written from a few numbers, sound or with one thing wrong."""

from __future__ import annotations

import struct


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind.encode() + body


def full(kind: str, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _number(width: int, *values: int) -> bytes:
    return b"".join(v.to_bytes(width, "big") for v in values)


def hvcc(profile: int, chroma: int, luma_depth: int, chroma_depth: int) -> bytes:
    body = bytearray(23)
    body[0], body[1], body[16], body[17], body[18] = 1, profile, 0xFC | chroma, 0xF8 | luma_depth - 8, 0xF8 | chroma_depth - 8
    return box("hvcC", bytes(body))


def heif(rows: int, columns: int, width: int, height: int, depth: int, wrong: str = "") -> bytes:
    """Items: 1 primary, 2 tone map, 3 gain map (a grid, or coded where it has one tile), from 4 on its tiles."""
    n = rows * columns
    grid = n > 1
    tiles = list(range(4, 4 + n)) if grid else [3]
    wide = wrong == "wide"
    kinds = {1: "hvc1", 2: "tmap", 3: "grid" if grid else "hvc1", **{t: "hvc1" for t in tiles}}
    if wrong == "gain-map kind":
        kinds[3] = "jpeg"
    if wrong == "tone map":
        kinds[2] = "mime"
    if wrong == "tile kind":
        kinds[tiles[-1]] = "av01"
    infe = [full("infe", 2, 0, _number(2, i, 0), k.encode(), b"\0") for i, k in kinds.items()]
    if wrong == "item twice":
        infe.append(infe[0])
    inputs = {"tone-map inputs": (3, 1), "roles": (1, 1)}.get(wrong, (1, 3))
    asked = tiles[:-1] + tiles[:1] if wrong == "repeated tiles" else [1, *tiles[1:]] if wrong == "shared tiles" else tiles + [99] * (wrong == "reference")
    refs = [box("dimg", _number(2, 2, 2, *inputs))]
    refs += [box("dimg", _number(2, 3, len(asked), *asked))] * (2 if wrong == "gain-map references" else 1) if grid else []
    properties = [
        full("ispe", 0, 0, _number(4, width, height)), full("pixi", 0, 0, bytes((1, 12 if wrong == "depths" else depth)) if wrong != "channels" else bytes((2, depth, depth))), hvcc(4, 0, depth, depth), full("pixi", 0, 0, bytes((3, 10, 10, 0 if wrong == "output depths" else 10))),
        box("colr", b"nclx", _number(2, 2 if wrong == "output colour" else 9, 16, 9), b"\x80"), full("ispe", 0, 0, _number(4, 64, 64)), hvcc(4, 0, 8 if depth > 8 else 10, 8),
    ]
    of = {1: [6, 3], 2: [1, 4, 5], 3: [1, 2] if grid else [1, 2, 3], **{t: [6, 3] for t in tiles if grid}}
    if wrong == "tile codecs":
        of[tiles[-1]] = [6, 7]
    if wrong == "tile properties":
        of[tiles[-1]] = [6] if grid else [1, 2]
    if wrong == "association":
        of[1] = [6, 77]
    if wrong == "dimensions":
        of[3] = [p for p in of[3] if p != 1] + [1, 6]
    side = 4 if wide else 2
    told = (rows + (wrong == "grid tiles"), columns, width + (wrong == "grid dimensions"), height)
    idat = bytes((0, int(wide), told[0] - 1, told[1] - 1)) + _number(side, told[2], told[3])
    coded = [1, *tiles]

    def meta(start: int) -> bytes:
        places = []
        for i in [2, 3, *coded] if grid else [2, *coded]:
            inside = i in (2, 3) and not (i == 3 and not grid)
            at, length = (0, len(idat)) if inside else (start + 16 * coded.index(i), 0 if wrong == "empty tiles" and i == tiles[-1] else 16 + 10**6 * (wrong == "location" and i == 1))
            places.append(_number(2, i, int(inside), 0, 1) + _number(4, at, length))
        return full(
            "meta", 0, 0, full("pitm", 0, 0, _number(2, 88 if wrong == "primary" else 1)), full("iinf", 0, 0, _number(2, len(infe)), *infe), full("iref", 0, 0, *refs),
            box("iprp", box("ipco", *properties), full("ipma", 0, 0, _number(4, len(of)), *(_number(2, i) + bytes((len(p), *p)) for i, p in of.items()))), full("iloc", 1, 0, b"\x44\0", _number(2, len(places)), *places), box("idat", idat),
        )

    head = box("ftyp", b"heic\0\0\0\0heic")
    start = len(head) + len(meta(0)) + 8
    whole = head + meta(start) + box("mdat", bytes(16 * len(coded)))
    return whole[: len(head) + 40] if wrong == "broken" else whole


#: What can be wrong, and the rule that tells it.
WRONG = {
    "": None, "wide": None, "broken": "integrity", "primary": "integrity", "item twice": "integrity", "reference": "integrity", "association": "integrity", "location": "integrity", "tone map": "tone map", "tone-map inputs": "tone-map inputs", "roles": "roles",
    "gain-map kind": "gain-map kind", "gain-map references": "gain-map references", "repeated tiles": "repeated tiles", "grid tiles": "grid tiles", "dimensions": "dimensions", "grid dimensions": "grid dimensions", "tile kind": "tile kind", "shared tiles": "shared tiles",
    "empty tiles": "empty tiles", "tile properties": "tile properties", "tile codecs": "tile codecs", "channels": "channels", "depths": "depths", "output depths": "output depths", "output colour": "output colour",
}
