"""Operators on small tables with known answers and edge cases."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siftworks.functions import flags as fl, text as tx, transfer as tr
from siftworks.operators import fits, gates, graphs, ordered, planning, ranking, raster, sessions, stats
from siftworks.sources import files
from siftworks.streaming import journal


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- flags ---

COMMENTS = [
    ("oplus_16", 16), ("xx OPPO_8 oplus_4", 4), ("oppo_12", 12), ("oplus_x oppo_3", 3), ("oplus_99999999999999999999 oppo_3", None), ("none", None), (None, None), ("", None),
    ('{"OplusTag": 32}', 32), ('{"oplustag": " 9223372036854775808 "}', 9223372036854775808), ('{"oplustag": "x"}', None), ('{"other": 1}', None), ("oplus_18446744073709551615", 18446744073709551615), ("op\0lus_5", 5),
]


def test_flag_parsing(spark):
    df = spark.createDataFrame([(c, i) for i, (c, _) in enumerate(COMMENTS)], "raw string, i int")
    got = dict(values(df, "i", fl.parse_flags(F.col("raw"))))
    assert [None if got[i] is None else int(got[i]) for i in range(len(COMMENTS))] == [f for _, f in COMMENTS]


def test_scans_pass_over_what_does_not_fit(spark):
    df = spark.createDataFrame([("oplus_99999999999999999999 oppo_3", 'x "oplusTag" : "7" y')], "a string, b string")
    assert values(df, fl.scan_prefixed_flags(F.col("a")).cast("long"), fl.scan_json_flags(F.col("b")).cast("long")) == [(3, 7)]


def test_flag_classes(spark):
    rows = [(0,), (0x10,), (0x1_0000_0000 | 0x2,), (1 << 62,), (1 << 63,), (1,)]
    df = spark.createDataFrame([(str(v),) for (v,) in rows], "s string").select(F.col("s").cast("decimal(20,0)").alias("v")).withColumn("m", fl.modes(F.col("v")))
    got = values(df, F.array_join("m", ","), fl.primary_mode(F.col("m"), F.col("v"), F.lit("ok")), fl.recognized(F.col("v")).cast("string"), fl.known_unmapped(F.col("v")).cast("string"), fl.unknown(F.col("v")).cast("string"))
    assert got[0] == ("", "normal", "0", "0", "0")
    assert got[1][:2] == ("portrait", "portrait") and got[1][2] == "16"
    assert got[2][:2] == ("master,beauty", "master")
    assert got[3][1] == "normal" and got[3][3] == str(1 << 62)
    assert got[4][1] is None and got[4][4] == str(1 << 63)
    assert got[5][3] == "1"


def test_halves_next_to_a_border(spark):
    """Low halves so near 2^32 that a quotient of six places would be rounded up."""
    rows = [1413040 * 1000003, (1 << 32) - 1, (1 << 64) - 1, 7 << 32, (5 << 32) - 1000]
    df = spark.createDataFrame([(str(v),) for v in rows], "s string").select(F.col("s").cast("decimal(20,0)").alias("v"))
    assert values(df, *fl.halves(F.col("v"))) == [divmod(v, 1 << 32) for v in rows]


def test_padding(spark):
    df = spark.createDataFrame([(5, "0007"), (12345, "07")], "v long, o string")
    assert values(df, fl.padded(F.col("v"), F.col("o"))) == [("0005",), ("12345",)]


# --- text ---


def test_text_functions(spark):
    one = spark.range(1)
    col = lambda c: one.select(c.alias("x")).first().x
    assert col(tx.capture_time(F.lit("2024:02:03 04:05:06"), F.lit("12a3"))) == dt.datetime(2024, 2, 3, 4, 5, 6, 123000)
    assert col(tx.capture_time(F.lit("2024:13:03 04:05:06"))) is None
    assert [col(tx.number(F.lit(v))) for v in ("12", "3/4", "5 mm", "1/0", "x", "1e400", "-1.5")] == [12.0, 0.75, 5.0, None, None, None, -1.5]
    assert [col(tx.focal_from_lens(F.lit(v))) for v in ("Phone back camera 6.9mm f/1.8", "camera x", "lens 5mm")] == [6.9, None, None]
    assert col(tx.resolved_focal(F.array(F.lit(0.0), F.lit(24.0), F.lit(24.0005)))) == 24.0
    assert col(tx.resolved_focal(F.array(F.lit(24.0), F.lit(25.0)))) is None
    assert [col(tx.open_licence(F.lit(v))) for v in ("CC0", "CC BY-SA 4.0", "CC BY 5.0", "all rights")] == [True, True, False, False]
    assert col(tx.stem(F.lit("/a/b.c/d.e.jpg"))) == "d.e" and col(tx.extension(F.lit("/a/b.c/d.E"))) == "e" and col(tx.directory(F.lit("/a/b/c"))) == "/a/b"
    assert col(tx.sequenced_name(F.lit("a"), F.lit("jpg"), F.lit(3))) == "a (3).jpg"
    half = lambda n, d: F.struct(F.lit(n).alias("num"), F.lit(d).alias("den"))
    assert col(tx.same_time(F.lit(1), half(1, 2), F.lit(2), half(1, 4))) is True
    import re

    assert re.match(tx.glob_to_regex("src/**/a?.py"), "src/x/y/ab.py") and re.match(tx.glob_to_regex("src/*.py"), "src/x/y.py")  # a star crosses slashes


# --- transfer ---


def test_curves_invert(spark):
    df = spark.createDataFrame([(i / 50,) for i in range(51)], "x double")
    x = F.col("x")
    for there, back in ((tr.pq_encode, tr.pq_decode), (tr.hlg_encode, tr.hlg_decode), (tr.srgb_encode, tr.srgb_decode), (tr.log_encode, tr.log_decode)):
        assert all(abs(a - b) < 2e-5 for a, b in values(df, x, back(there(x)))), there
    assert values(df.limit(1), tr.pq_encode(x - 5), tr.hlg_encode(x + 5), tr.log_encode(x - 5)) == [(None, None, 0.0)]


def test_orientations_are_a_group(spark):
    df = spark.createDataFrame([(o, 0.1, 0.2, 0.3, 0.1) for o in range(1, 9)], "o int, x double, y double, w double, h double")
    c = [F.col(n) for n in "xywh"]
    got = values(df, "o", *tr.oriented(*c, F.col("o")))
    assert len({tuple(round(v, 9) for v in g[1:]) for g in got}) == 8
    assert all(abs(g[3] * g[4] - 0.03) < 1e-9 for g in got)


# --- ranking ---


@pytest.mark.parametrize("slices", [1, 3, 64])
def test_sliced_running_sums(spark, slices):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), i * 7 % 501, r.randint(0, 9)) for i in range(501)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(k, o): (s, n) for k, o, s, n in values(ranking.numbered(ranking.running(df, ["k"], ["o"], "v", "s", slices), ["k"], ["o"], "n", slices), "k", "o", "s", "n")}
    for key in ("a", "b", None):
        total = 0
        for n, (_, o, v) in enumerate(sorted((x for x in rows if x[0] == key), key=lambda x: x[1]), 1):
            total += v
            assert got[key, o] == (total, n)


@pytest.mark.parametrize("slices", [1, 5])
def test_shifts_over_slices(spark, slices):
    rows = [(k, o, None if o % 5 == 0 else o * o) for k in ("a", "b", None) for o in range(0, 90, 3 if k else 1)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    for ahead in (False, True):
        got = {(k, o): x for k, o, x in values(ranking.shifted(df, ["k"], ["o"], "v", "x", ahead, slices), "k", "o", "x")}
        for key in ("a", "b", None):
            line = [r for r in rows if r[0] == key]
            for i, (_, o, _) in enumerate(line):
                j = i + 1 if ahead else i - 1
                assert got[key, o] == (line[j][2] if 0 <= j < len(line) else None)


# --- planning ---


def test_assets_move_together(spark):
    rows = [("d", "A", "1", "x.jpg", "f1"), ("d", "A", "2", "x.mov", "f2"), ("d", "B", "3", "x.jpg", "f3"), ("d", "B", "4", "x.mov", "f2"), ("d", "C", "5", "x (2).jpg", "f9"), ("d", "D", "6", "x.jpg", "f1"), ("e", "E", "7", "y", "f1")]
    there = spark.createDataFrame([("e", "y", "other")], "directory string, name string, fingerprint string")
    got = planning.place_assets(spark.createDataFrame(rows, "directory string, asset string, path string, name string, fingerprint string"), there)
    found = {p: (n, d) for p, n, d in values(got, "path", "name", "disposition")}
    assert found == {"1": ("x.jpg", "copy"), "2": ("x.mov", "copy"), "3": ("x (2).jpg", "copy"), "4": ("x (2).mov", "copy"), "5": ("x (2) (2).jpg", "copy"), "6": ("x.jpg", "duplicate"), "7": ("y (2)", "copy")}


def test_categorize_numbers_contents(spark):
    rows = [(1, "d", "a"), (2, "d", "b"), (3, "d", "a"), (4, None, "a"), (5, "d", "c")]
    got = planning.categorize(spark.createDataFrame(rows, "i long, dest string, fp string"), ["dest"], "fp", "i", F.lit("f"), F.lit("t"))
    assert sorted(values(got, "i", "file_name", "disposition")) == [(1, "f.t", "copy"), (2, "f (2).t", "copy"), (3, "f.t", "duplicate"), (4, "f.t", "copy"), (5, "f (3).t", "copy")]


def test_reuse_and_missing(spark):
    items = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, size long")
    receipts = spark.createDataFrame([("a", 1, "success"), ("a", 1, "success"), ("b", 9, "success"), ("c", 3, "failed")], "k string, size long, status string")
    assert sorted(values(planning.reusable(items, receipts, ["k"], ["size"]), "k", "reuse")) == [("a", True), ("b", False), ("c", False)]
    assert sorted(values(planning.missing(items.union(items), receipts.where("k = 'a'"), ["k"]), "k")) == [("b",), ("b",), ("c",), ("c",)]


# --- sessions ---


def test_sessions_with_missing_times(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("u", at(0), "a"), ("u", at(120), "b"), ("u", at(241), "c"), ("u", None, "d"), ("u", None, "e"), ("v", None, "f")]
    got = sessions.gap_sessions(spark.createDataFrame(rows, "k string, t timestamp_ntz, p string"), ["k"], "t", "p")
    assert sorted(values(got, "p", "session")) == [("a", 0), ("b", 0), ("c", 1), ("d", 2), ("e", 3), ("f", 0)]


# --- statistics ---


def test_nine_numbers_of_nothing(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", None), ("b", 2.0), ("b", float("inf")), ("b", 4.0)], "k string, x double")
    got = {r.k: r for r in stats.nine_number(df, ["k"], F.col("x")).collect()}
    assert got["a"].n == 0 and got["a"].high_key == 1.0 and got["a"].p50 == 0.0
    assert got["b"].n == 2 and got["b"].p50 == 3.0


def test_difference_of_equal_series(spark):
    df = spark.createDataFrame([(1, 2.0, 2.0), (1, 3.0, 3.0)], "k int, v double, r double")
    assert values(stats.difference_metrics(df, ["k"], "v", "r"), "rmse", "psnr") == [(0.0, None)]


def test_budget_missing(spark):
    ref = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "c string, v double")
    now = spark.createDataFrame([("a", 1.2), ("b", 1.4)], "c string, v double")
    assert dict(values(stats.budget_report(ref, now, "c", "v", 0.35, 0.25), "c", "verdict")) == {"a": "pass", "b": "fail", "c": "missing"}


# --- ordered ---


def test_islands_and_gaps(spark):
    df = spark.createDataFrame([("k", i, s, v) for i, (s, v) in enumerate([("a", None), ("a", 1.0), (None, None), (None, None), ("b", 4.0), ("a", None)])], "k string, i int, s string, v double")
    assert values(ordered.islands(df, ["k"], ["i"], "s").orderBy("run"), "s", "first", "last", "length") == [("a", 0, 1, 2), (None, 2, 3, 2), ("b", 4, 4, 1), ("a", 5, 5, 1)]
    assert [r.filled for r in ordered.interpolated(df, ["k"], "i", "v").orderBy("i").collect()] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_journal_files(spark, tmp_path):
    path = tmp_path / "j.jsonl"
    path.write_text('{"k":"a","v":1}\n{"k":"b","v":2}\n{"k":"a","v":3}\n{"k":"b"')
    found = journal.lines(spark, str(path))
    assert sorted(values(journal.last_state(journal.strict(found, "k string, v long"), ["k"]), "k", "v")) == [("a", 3), ("b", 2)]
    path.write_text('{"k":"a","v":1}\nbroken\n{"k":"a","v":3}\n')
    found = journal.lines(spark, str(path))
    assert values(journal.last_state(journal.tolerant(found, "k string, v long"), ["k"]), "k", "v") == [("a", 3)]
    with pytest.raises(PySparkException):
        journal.strict(found, "k string, v long").collect()


# --- graphs, gates ---


def test_closure_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8)], "a int, b int")
    assert sorted(values(graphs.closure(edges, spark.createDataFrame([(1,)], "node int")), "node", "hops")) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_bags_and_ranges(spark):
    left, right = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted(values(graphs.bag_difference(left, right), "side", "x")) == [("left", 1), ("left", 2), ("right", 3)]
    df = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 1.0)], "k string, v double")
    assert sorted(values(graphs.outside_range(df, df.where("v < 2 and k = 'a'"), ["k"], "v"), "k", "v", "in_range"), key=str) == [("a", 1.0, True), ("a", 5.0, False), ("b", 1.0, None)]
    assert values(graphs.repeated_identities(spark.createDataFrame([("x", 1), ("x", 2)], "a string, b int"), ["a", "b"]), "field", "value", "n") == [("a", "x", 2)]


def test_gates(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 50.0)], "i int, v double")
    rules = {"small": F.col("v") < 10, "positive": F.col("v") > 0}
    assert sorted(values(gates.violations(df, "i", rules), "i", "rule")) == [(2, "positive"), (2, "small"), (3, "small")]
    assert gates.enforced(df.where("i = 1"), rules).count() == 1
    with pytest.raises(PySparkException):
        gates.enforced(df, rules).collect()


# --- fits and rasters ---


def test_isotonic_is_the_best_monotone_fit(spark):
    r = random.Random(2)
    rows = [("k", i, r.random() * 5 + i / 5, r.choice((1.0, 2.0))) for i in range(30)]
    got = [x.fitted for x in fits.isotonic(spark.createDataFrame(rows, "k string, i int, v double, w double"), ["k"], "i", "v", "w").orderBy("i").collect()]
    mean = lambda a, b: sum(v * w for _, _, v, w in rows[a : b + 1]) / sum(w for *_, w in rows[a : b + 1])
    want = [max(min(mean(a, b) for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
    assert np.allclose(got, want)


def test_robust_fit_ignores_outliers(spark):
    r = np.random.default_rng(1)
    x = r.random((400, 2))
    y = 1 + 2 * x[:, 0] - 3 * x[:, 1]
    y[::20] += 50
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    out = fits.robust_fit(df, [F.lit(1.0), F.col("a"), F.col("b")], F.col("y"), passes=12, huber=0.5)
    assert np.allclose(out, [1, 2, -3], atol=0.4)


def test_rasters(spark):
    v = np.random.default_rng(3).random((8, 8))
    df = spark.createDataFrame([(1, v.ravel().tolist()), (2, None)], "i int, r array<double>")
    get = lambda f: np.array(df.select(f(F.col("r")).alias("x")).collect()[0].x).reshape(8, 8)
    want = np.array([[max(v[a, b] for a in range(8) for b in range(8) if (a - y) ** 2 + (b - x) ** 2 <= 4) for x in range(8)] for y in range(8)])
    assert np.allclose(get(raster.disc_maximum(8, 8, 2)), want)
    every = F.transform("r", lambda x: F.lit(True))
    assert np.allclose(get(lambda c: raster.box_blur(8, 8, 1)(c, every))[0, 0], v[:2, :2].mean())
    assert (get(lambda c: raster.box_blur(8, 8, 1)(c, F.transform(c, lambda x: x > 2))) == 0).all()
    smooth = get(raster.guided(8, 8, 2, 10.0))
    assert smooth.std() < v.std() and np.allclose(get(raster.guided(8, 8, 2, 0.0)), v)
    assert get(lambda c: raster.bilateral(8, 8)(c, c)).std() < v.std()
    step = F.transform("r", lambda x, i: F.when(i % 8 < 4, 0.0).otherwise(100.0))  # a guide with an edge: no smoothing over it
    kept = get(lambda c: raster.bilateral(8, 8)(step, step))
    assert np.allclose(kept[:, :4], 0) and np.allclose(kept[:, 4:], 100)
    means = df.select(raster.cell_means(F.col("r"), 8, 8, 2, 2).alias("m")).first().m
    assert np.allclose(means, [v[:4, :4].mean(), v[:4, 4:].mean(), v[4:, :4].mean(), v[4:, 4:].mean()])


# --- files ---


def test_brands_of_a_long_box(spark):
    """Time follows the length of the box, not its square; brands stand at multiples of four inside it."""
    box = lambda n, tail: (n * 4 + 12 + len(tail)).to_bytes(4, "big") + b"ftypavif" + b"mif1" * n + tail
    made = {"last": box(400_000, b"heic"), "none": box(400_000, b"mif1"), "aside": box(1, b"\0\0heic\0\0"), "cut": box(1, b"hei"), "behind": box(0, b"") + b"heic", "empty": b"", "null": None}
    df = spark.createDataFrame(list(made.items()), "n string, c binary")
    began = time.monotonic()
    got = {r.n: r.e for r in df.select("n", files.still_encoding(F.col("c")).alias("e")).collect()}
    assert got == dict.fromkeys(made) | {"last": "heic"} and time.monotonic() - began < 60


def test_files(spark, tmp_path):
    for name, data in {"a.jpg": b"\xff\xd8rest", "b.heic": b"\0\0\0\x18ftypmif1\0\0\0\0heicxxxx", "c.heic": b"\0\0\0\x10ftypmif1\0\0\0\0heic", ".d.jpg": b"x", "e.txt": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    found = files.scan(spark, [str(tmp_path)])
    got = {r.p: r.e for r in found.select(tx.stem(F.col("path")).alias("p"), files.still_encoding(F.col("content")).alias("e")).collect()}
    assert got == {"a": "jpeg", "b": "heic", "c": None}
    tail = 'xx[{"name":"old"}]yy[{"name":"a","offset":10,"length":4},{"name":"b","offset":20,"length":2},{"name":"c"}]zz'
    entries = spark.range(1).select(files.manifest(F.lit(tail)).alias("m")).first().m
    assert [(e.name, e.start, e.length) for e in entries] == [("b", -20, 2), ("a", -10, 4)]
    assert spark.range(1).select(files.byte_range(F.lit(b"abcdef"), F.lit(2), F.lit(3), 10).alias("b")).first().b == b"cde"


def test_media(spark):
    import struct

    from siftworks.sources import media

    exif = b"Exif\0\0MM\0*" + struct.pack(">I", 8) + struct.pack(">HHHII", 1, 0x8769, 4, 1, 26) + struct.pack(">I", 0) + struct.pack(">HHHIHH", 1, 0xA001, 3, 1, 65535, 0)
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 40, 60, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    one = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + frame + b"\xff\xda\0\x02ab\xff\0cd\xff\xd9"
    box = lambda kind, body: struct.pack(">I", len(body) + 8) + kind + body
    hvcc = bytes([1, 2] + [0] * 14 + [0xFC | 1, 0xF8 | 2, 0xF8 | 2])
    heif = box(b"ftyp", b"heic") + box(b"meta", b"\0\0\0\0" + box(b"iprp", box(b"ipco", box(b"hvcC", hvcc))))
    df = spark.createDataFrame([("a", bytearray(one + b"junk" + one)), ("b", bytearray(heif)), ("c", bytearray(one[:12])), ("d", None)], "path string, content binary")
    segments = values(media.jpeg_segments(df).where("path = 'a'").orderBy("start"), "image", "marker")
    assert segments == [(i, m) for i in (0, 1) for m in (0xD8, 0xE1, 0xC0, 0xDA, 0xD9)]
    assert values(media.jpeg_frames(df).where("image = 0 and path = 'a'"), "width", "height", "sampling") == [(60, 40, ["2x2", "1x1", "1x1"])]
    assert values(media.colour_space(media.exif_entries(df)), "path", "colour_space") == [("a", 65535)]
    boxes = media.iso_boxes(df.where("path = 'b'"))
    assert [b.kind for b in boxes.orderBy("start").collect()] == ["ftyp", "meta", "iprp", "ipco", "hvcC"]
    payload = media.box_fields(df, boxes, "hvcC").select(media.hevc_profile(F.col("payload")).alias("p")).first().p
    assert (payload.profile, payload.chroma_format, payload.luma_depth) == (2, 1, 10)
    assert values(spark.range(1), media.rational(F.lit(struct.pack(">iI", -3, 2)), 0, True)) == [(-1.5,)]


# --- against the rules as written, not against SQL of the same hand ---


def test_globs_are_those_of_fnmatch():
    import fnmatch
    import re

    from siftworks.functions import text as tx

    paths = ["a/b/c.md", "docs/x.py", "docs/sub/x.py", "x1", "x[", "a.b", "A.B", "x]y", "line\nend", "^a", "a^", "a&&b", "-a"]
    for pattern in ("*", "docs/*", "docs/**", "?1", "x[[]", "[!a]*", "[a-c].b", "*.py", "x[]]y", "[", "a[", "*end", "[\\^]a", "[^]a", "a[&][&]b", "[!]a]*"):
        for path in paths:
            assert bool(re.match(tx.glob_to_regex(pattern), path)) == fnmatch.fnmatchcase(path, pattern), (pattern, path)


def test_licences_zoom_and_splits(spark):
    from siftworks.functions import decisions as dc, text as tx

    names = {"CC0": True, "cc0": True, "Public Domain": True, "public-domain": True, "pd": False, "CC0 1.0": False, "CC BY 2.5": True, "CC BY-SA 4.0": True, "CC BY-NC 4.0": False, "CC BY 4.0 ": False}
    got = {r.n: r.ok for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", tx.open_licence(F.col("n")).alias("ok")).collect()}
    assert got == names
    zooms = [(0.5, "one-to-below-two"), (1.99, "one-to-below-two"), (2.0, "two-to-below-three"), (3.0, "three-to-below-six"), (5.99, "three-to-below-six"), (6.0, "six-to-ten"), (None, None)]
    assert [r.z for r in spark.createDataFrame([(z,) for z, _ in zooms], "z double").select(dc.zoom_bucket(F.col("z")).alias("z")).collect()] == [b for _, b in zooms]


def plain_early(m):
    """The early headroom model, one number at a time in 32-bit floats."""
    f = np.float32
    fma = lambda a, b, c: f(np.float64(a) * np.float64(f(b)) + np.float64(f(c)))
    if m[0] < 2:
        return 1.0
    if m[33] >= 1:
        return float(m[33])
    if m[32] <= 0:
        return 1.0
    face, light = f(m[24]), f(m[29])
    e = f(780.3) / (f(np.exp2(fma(m[32], -0.1175, -6.829))) + f(1)) + f(-772.3)
    if face > 0:
        e = fma(e - f(1), face if face < 1 else f(1) / face, 1)
    s = abs(f(np.sqrt(e))) - f(1)
    e = fma(s, 3.8, 1) if light < 200 else fma(s, 1.34, 1) if light >= 320 else fma(s, fma(light, -0.0205, 7.9), 1)
    if face > 0:
        e = fma(abs(f(np.sqrt(e))) - f(1), 1.85, 1)
    return float(e if light <= 320 else fma(e - f(1), 0.8, 1))


def test_early_headroom(spark):
    from siftworks.functions import headroom as hr

    r = np.random.default_rng(4)
    rows = []
    for _ in range(200):
        m = np.zeros(36, np.float32)
        m[0], m[23], m[24], m[29], m[32] = r.choice((1.5, 2.5)), 1, r.choice((0, 0.4, 3.0)), r.choice((150, 250, 400)), r.choice((0, 40, 400, 900))
        m[33] = r.choice((0, 0, 0, 4.25))
        rows.append((m.tolist(),))
    df = spark.createDataFrame([*rows, ([1.0] * 5,), (None,)], "m array<double>")
    got = [x.s for x in df.select(hr.headroom_scale(F.col("m")).alias("s")).collect()]
    assert np.allclose(got[:200], [plain_early(np.array(m, np.float32)) for (m,) in rows], rtol=1e-6) and got[200:] == [None, None]
    knees = [x.k for x in spark.createDataFrame([(2.0,), (4.0,), (1.0,)], "s double").select(hr.knee_point(F.col("s")).alias("k")).collect()]
    assert all(k is None or k < 1 for k in knees) and knees[0] is not None


def test_closure_of_a_long_chain_and_a_clique(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a < 60")
    assert graphs.closure(chain, spark.createDataFrame([(0,)], "node long")).count() == 61
    clique = spark.createDataFrame([(i, j) for i in range(12) for j in range(12)], "a long, b long")
    assert graphs.closure(clique, spark.createDataFrame([(0,)], "node long")).count() == 12


def test_leaves_of_deep_objects(spark):
    from siftworks.sources import pages

    text = '{"a":' * 14 + "1" + "}" * 14
    rows = pages.leaves(spark.createDataFrame([(1, text), (2, '{"b": [1], "c": {}}')], "i int, j string"), "i", "j").collect()
    assert sorted((r.i, r.path, r.value) for r in rows) == [(1, ".".join("a" * 14), "1"), (2, "b", "[1]")]


def test_scan_of_overlapping_roots(spark, tmp_path):
    from siftworks.sources import files

    (tmp_path / "a" / ".hid").mkdir(parents=True)
    for name in ("a/x.JPG", "a/y.heic", "a/z.txt", "a/.hid/w.jpg", "b.jpeg"):
        (tmp_path / name).write_bytes(b"\xff\xd8")
    found = files.scan(spark, [str(tmp_path), str(tmp_path / "a"), f"{tmp_path}/"])
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["b.jpeg", "x.JPG", "y.heic"]
