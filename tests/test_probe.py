"""Containers told by byte ranges: sound, truncated and foreign files."""

import json
import struct

import numpy as np
import pytest

from siftworks.sources import probe

META = np.zeros(36, "<f4")
META[[0, 1, 2, 5, 18, 19, 29]] = [3, 36, 144, -1, 10, 6, 500]
INFO = np.array(probe.ULTRA_DEFAULT, "<f4")
INFO[4] = 3.5
BIG = b"z" * 300_000
VIDEO = struct.pack(">I4s4s", 12, b"ftyp", b"mp42") + b"v" * 500


def container(blocks, body=b"\xff\xd8\xff\xe0body", footer=True, cut=0, wrong=0):
    data, place = body, {}
    for name, raw in blocks:
        place[name] = len(data)
        data += raw
    manifest = json.dumps([{"name": n, "offset": len(data) - place[n], "length": len(b)} for n, b in blocks]).encode()
    data += manifest
    if footer:
        data += b"\0jxrs" + struct.pack("<I", len(manifest) + 9 + wrong)
    return data[: len(data) - cut]


def still(length):
    return b'\xff\xd8\xff\xe1<x GCamera:MicroVideoOffset="%d" GCamera:MicroVideoPresentationTimestampUs="77">' % length


LOCAL = [(probe.LOCAL_META, META.tobytes()), (probe.LOCAL_MASK, b"\xff\xd8mask")]
BOXES = struct.pack(">I4s4sI", 16, b"ftyp", b"heic", 0) + struct.pack(">I4s", 12, b"QTI ") + b"abcd"
FILES = {
    "local": container([LOCAL[0], (probe.LOCAL_MASK, b"\xff\xd8mask" + BIG)]),
    "ultra": container([(probe.ULTRA_INFO, INFO.tobytes()), (probe.ULTRA_DATA, b"\xff\xd8data")]),
    "ultra-nan": container([(probe.ULTRA_INFO, np.where(np.arange(20) == 3, np.nan, INFO).astype("<f4").tobytes()), (probe.ULTRA_DATA, b"\xff\xd8data" + BIG)]),
    "photo": still(len(VIDEO)) + BIG + VIDEO,
    "photo-items": b'\xff\xd8<Container:Item Item:Mime="video/mp4" Item:Semantic="MotionPhoto" Item:Length="%d"/>' % len(VIDEO) + VIDEO,
    "no-video": still(10**9) + BIG,
    "not-a-video": still(8) + BIG,
    "text": b"just text",
    "empty": b"",
    "cut": container(LOCAL, cut=3),
    "wrong-footer": container(LOCAL, wrong=1),
    "no-footer": container(LOCAL, footer=False),
    "boxes": container(LOCAL, body=BOXES, footer=False),
    "no-mask": container(LOCAL[:1]),
    "no-meta": container([(probe.LOCAL_META, bytes(144)), LOCAL[1]]),
    "text-in-exif": b"\xff\xd8\xff\xe1\0\0\0\0QTI ordinary" + b'[{"name":"x","offset":1,"length":1}]',
    "negative": b"\xff\xd8" + (m := b'[{"name":"local.hdr.meta.data","offset":5,"length":-1},{"name":"y","offset":1e400,"length":3},{"length":2},7]') + b"\0jxrs" + struct.pack("<I", len(m) + 9),
    "broken-json": b"\xff\xd8" + (b := b'[{"name":]') + b"\0jxrs" + struct.pack("<I", len(b) + 9),
}
UNSUPPORTED = {"text": "no manifest", "empty": "no manifest", "cut": "no marker", "wrong-footer": "no marker", "no-footer": "no marker", "no-mask": "no mask", "no-meta": "no metadata", "text-in-exif": "no marker", "negative": "no metadata", "broken-json": "no manifest"}


@pytest.fixture(scope="module")
def probed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    for name, raw in FILES.items():
        (folder / name).write_bytes(raw)
    (folder / ".hidden").write_bytes(b"x")
    found = probe.inspect(spark, [str(folder), f"{folder}/none", "nope://host/file", str(folder / "text")])
    return {r.path.rpartition("/")[2]: r for r in found.collect()}, found


def test_one_tagged_row_a_file(probed):
    rows, _ = probed
    assert set(rows) == {*FILES, "none", "file"}
    assert {n: r.reason for n, r in rows.items() if r.stage == "unsupported"} == UNSUPPORTED
    assert {n for n, r in rows.items() if r.stage == "motion-photo"} == {"no-video", "not-a-video"}
    assert {n for n, r in rows.items() if r.stage == "io"} == {"none", "file"}
    assert all((r.kind == "error") == (r.stage is not None) == (r.reason is not None) for r in rows.values())


def test_motion_photos(probed):
    rows, _ = probed
    for name in ("photo", "photo-items"):
        r, size = rows[name], len(FILES[name])
        assert (r.kind, r.still.offset, r.still.length, r.video.offset, r.video.length) == ("motion-photo", 0, size - len(VIDEO), size - len(VIDEO), len(VIDEO))
    assert (rows["photo"].source_kind, rows["photo"].presentation_us) == ("legacyMicroVideo", 77)
    assert (rows["photo-items"].source_kind, rows["photo-items"].presentation_us) == ("motionPhoto", None)


def test_metadata(probed):
    rows, _ = probed
    assert (rows["local"].hdr_mode, rows["local"].metadata, rows["local"].has_local_info) == ("lhdr", META.astype(float).tolist(), True)
    assert rows["ultra"].metadata == INFO.astype(float).tolist() and rows["ultra"].has_local_info is False
    assert tuple(rows["ultra-nan"].metadata) == probe.ULTRA_DEFAULT
    assert rows["boxes"].hdr_mode == "lhdr" and rows["boxes"].manifest_entries == 2


def test_only_ranges_are_read(probed):
    rows, found = probed
    for name in ("local", "ultra-nan", "photo", "no-video", "not-a-video"):
        assert rows[name].size > 300_000 and rows[name].bytes_read < 133_000
    masks = {r.path.rpartition("/")[2]: bytes(r.gain_map_bytes) for r in probe.extract(found).collect()}
    assert masks == {"local": b"\xff\xd8mask" + BIG, "ultra": b"\xff\xd8data", "ultra-nan": b"\xff\xd8data" + BIG, "boxes": b"\xff\xd8mask"}


def test_files_are_dealt_by_size(tmp_path):
    for i in range(7):
        (tmp_path / f"f{i}").write_bytes(b"x" * (i + 1) * 100)
    reader = probe._Reader({"paths": json.dumps([str(tmp_path)]), "head": "10", "tail": "10"})
    probe.FILES, before = 2, probe.FILES
    try:
        parts = reader.partitions()
    finally:
        probe.FILES = before
    assert sorted(f[0][-2:] for p in parts for f in p.files) == [f"f{i}" for i in range(7)] and len(parts) == 4
    assert [p.files[0][1] for p in parts] == [700, 600, 500, 400]  # the largest first, one each
    assert all(row[5] == 20 for p in parts for row in reader.read(p))


def test_the_driver_lists_no_folder(spark, tmp_path, monkeypatch):
    """Folders are listed in tasks: deep ones, overlapping roots, hidden names; planning on the driver is not used."""
    (tmp_path / "a" / "b" / ".h").mkdir(parents=True)
    for name in ("x", "a/y", "a/b/z", "a/b/.h/in", "a/.hidden", "a/_no"):
        (tmp_path / name).write_bytes(b"abc")
    monkeypatch.setattr(probe._Reader, "partitions", lambda self: 1 / 0)
    roots = [str(tmp_path), str(tmp_path / "a"), str(tmp_path / "x"), str(tmp_path / "gone")]
    got = sorted((r.path.removeprefix(f"{tmp_path}/"), r.size, r.error, r.head) for r in probe.heads_and_tails(spark, roots).collect())
    assert got == [(n, 3, None, b"abc") if n != "gone" else (n, 0, "not found", None) for n in ("a/b/.h/in", "a/b/z", "a/y", "gone", "x")]
