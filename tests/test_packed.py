"""The bit reader against a reader of one payload, and registered records of every shape."""

import random

import numpy as np
import pytest

from siftworks.sources import packed


def pack(fields):
    bits = "".join(f"{v:0{w}b}" for v, w in fields)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def test_stack_reads_any_bits():
    r = random.Random(1)
    payloads = [bytes(r.randrange(256) for _ in range(r.randint(0, 12))) for _ in range(50)] + [None]
    s, at = packed.Stack(payloads), [0] * 51
    for _ in range(20):
        width = r.randint(1, 32)
        where = np.array([r.random() < 0.7 for _ in payloads])
        got = s.read(width, where)
        for i, p in enumerate(payloads):
            bits = "".join(f"{b:08b}" for b in p or b"")
            if where[i] and at[i] is not None:
                if at[i] + width > len(bits):
                    at[i] = None
                else:
                    assert got[i] == int(bits[at[i] : at[i] + width], 2)
                    at[i] += width
            assert (s.reason[i] == "truncated") == (at[i] is None)


DISPLAY = (34000, 16000, 13250, 34500, 7500, 3000, 15635, 16450, 10_000_000, 50, 1000, 400)


def static(values=DISPLAY):
    return pack([*((v, 16) for v in values[:8]), (values[8], 32), (values[9], 32), (values[10], 16), (values[11], 16)])


def dynamic(r, version=1, stats=None, pad=0):
    f, row = [(version, 8)], {}
    stats = stats or sorted(r.randrange(4096) for _ in range(3))
    values = dict(zip(("minimum", "average", "maximum"), stats), variance=r.randrange(4096))
    row["statistics"] = {n: values[n] for n in packed.STATISTICS}
    f += [(values[n], 12) for n in packed.STATISTICS]
    maps = []
    n = r.randint(0, 2)
    f += [(int(n > 0), 1)] + ([(n - 1, 1)] if n else [])
    for _ in range(n):
        m = {"target": r.randrange(4096), "base": None, "splines": []}
        f += [(m["target"], 12)]
        based = r.random() < 0.5
        f += [(int(based), 1)]
        if based:
            m["base"] = {name: r.randrange(1 << w) for name, w in packed.BASE}
            f += [(m["base"][name], w) for name, w in packed.BASE]
        k = r.randint(0, 2)
        f += [(int(k > 0), 1)] + ([(k - 1, 1)] if k else [])
        for _ in range(k):
            p = {"mode": r.randrange(4), "mb": None}
            f += [(p["mode"], 2)]
            if p["mode"] in (0, 2):
                p["mb"] = r.randrange(256)
                f += [(p["mb"], 8)]
            p |= {name: r.randrange(1 << w) for name, w in packed.SPLINE}
            f += [(p[name], w) for name, w in packed.SPLINE]
            m["splines"].append(p)
        maps.append(m)
    gains = [r.randrange(256) for _ in range(r.randint(0, 7))]
    f += [(int(bool(gains)), 1)] + ([(len(gains), 3)] if gains else []) + [(g, 8) for g in gains]
    row |= {"tone_maps": maps, "gains": gains}
    raw = bytearray(pack(f))
    if pad:
        free = -sum(w for _, w in f) % 8
        raw[-1] |= int(free > 0)
        return (bytes(raw), row) if free else dynamic(r, version, stats, pad)
    return bytes(raw), row


def record(still=b"", moving=b"", mapping=None, kind=None):
    section = len(still).to_bytes(2, "big") + still + len(moving).to_bytes(2, "big") + moving
    kind = kind if kind is not None else packed.MAPPED if mapping is not None else packed.PLAIN
    tail = b"" if mapping is None else len(mapping).to_bytes(2, "big") + mapping
    return packed.PREFIX + kind.to_bytes(4, "big") + len(section).to_bytes(2, "big") + section + tail


def test_records_of_every_shape():
    r = random.Random(2)
    payloads, want = [], []
    for i in range(120):
        moving, row = dynamic(r) if i % 3 else (b"", {"statistics": None, "tone_maps": None, "gains": None})
        has_static, mapping = i % 2 == 0 or i % 3 == 0, b"\0\3abc\0\0" if i % 5 == 0 else None
        payloads.append((packed.APP8 if i % 4 == 0 else b"") + record(static() if has_static else b"", moving, mapping))
        want.append({"reason": None, "display": dict(zip(packed._DISPLAY, DISPLAY)) if has_static else None, **row, "base_mapping": b"abc" if mapping else None, "combined_mapping": None})
    assert packed._registered(payloads) == want


@pytest.mark.parametrize(("payload", "reason"), [
    (None, "truncated"), (b"", "truncated"), (b"x" + record(static())[1:], "identity"), (record(static(), kind=0x02010001), "kind"), (record(static()) + b"\0", "tail"), (record(), "nothing"), (record(static()[:27]), "static size"),
    (record(static((34000, 0, *DISPLAY[2:]))), "chromaticity"), (record(static((*DISPLAY[:8], 50, 50, 0, 0))), "display luminance"), (record(static((*DISPLAY[:10], 400, 1000))), "content light"),
    (record(b"", dynamic(random.Random(3), version=2)[0]), "version"), (record(b"", dynamic(random.Random(3), stats=[9, 5, 7])[0]), "statistics"), (record(b"", dynamic(random.Random(3), pad=1)[0]), "padding"),
    (record(b"", dynamic(random.Random(3))[0] + b"\0"), "tail"), (record(b"", dynamic(random.Random(3))[0][:-1]), "truncated"), (record(static(), mapping=b"\0\3abc\0\0x"), "mapping tail"), (record(static(), mapping=b"\0\x09abc"), "truncated"),
])
def test_broken_records(payload, reason):
    good = record(static())
    got = packed._registered([good, payload, good])
    assert [g["reason"] for g in got] == [None, reason, None] and got[1]["display"] is None


def test_registered_hdr(spark):
    rows = [(1, record(static())), (2, None), (3, record(b"", dynamic(random.Random(4))[0]))]
    got = {r.k: r for r in packed.registered_hdr(spark.createDataFrame(rows, "k int, raw binary"), ["k"], "raw").collect()}
    assert got[1].display.maximum_luminance == 10_000_000 and got[2].reason == "truncated" and got[3].statistics.minimum <= got[3].statistics.average
