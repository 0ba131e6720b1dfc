"""Named queries over jobs of several steps: files that are written and probed, placement, publishing, fits by cell, tiles."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftworks.functions import colour
from siftworks.operators import lattice, local_fits, placement, raster, resample, tiles
from siftworks.operators.lineage import scratch_folder
from siftworks.plans.catalog import query, read
from siftworks.plans.heif import WRONG, heif
from siftworks.sources import dual_layer, files, item_graph, packed, probe
from siftworks.streaming.publish import Publisher

# --- files by byte ranges --------------------------------------------------------------------

_META = struct.pack("<36f", 3, 36, 144, 0, 0, -1, *[0] * 12, 10, 6, *[0] * 9, 500, *[0] * 6)
_INFO = struct.pack("<20f", *(3.5 if i == 4 else v for i, v in enumerate(probe.ULTRA_DEFAULT)))


def _containers(docs: DataFrame) -> DataFrame:
    """A file for each document, of seven kinds by its id, with its text inside: (name, content)."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    size, kind = F.length(text).cast("long"), F.pmod(F.col("doc_id"), F.lit(7))
    raw = lambda b: F.unhex(F.lit(b.hex()))
    string = lambda c: c.cast("string").cast("binary")

    def little(x: Column) -> Column:
        digits = F.lpad(F.hex(x.cast("long")), 8, "0")
        return F.unhex(F.concat(*(F.substring(digits, i, 2) for i in (7, 5, 3, 1))))

    def container(meta: tuple[str, bytes], mask: str) -> Column:
        parts = [f'[{{"name":"{meta[0]}","offset":', size + (len(meta[1]) + 2), f',"length":{len(meta[1])}}},{{"name":"{mask}","offset":', size + 2, ',"length":', size + 2, "}]"]
        manifest = F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).cast("binary")
        return F.concat(raw(b"\xff\xd8\xff\xe0"), text, raw(meta[1]), raw(b"\xff\xd8"), text, manifest, raw(b"\0jxrs"), little(F.length(manifest) + 9))

    def photo(length: Column) -> Column:
        return F.concat(raw(b"\xff\xd8"), F.lit('<x GCamera:MicroVideoOffset="').cast("binary"), string(length), F.lit('" GCamera:MicroVideoPresentationTimestampUs="77">').cast("binary"), text, raw(b"\0\0\0\x0cftypmp42"), text)

    local = container((probe.LOCAL_META, _META), probe.LOCAL_MASK)
    made = (
        F.when(kind == 0, local).when(kind == 1, container((probe.ULTRA_INFO, _INFO), probe.ULTRA_DATA)).when(kind == 2, container((probe.ULTRA_INFO, bytes(80)), probe.ULTRA_DATA))
        .when(kind == 3, photo(size + 12)).when(kind == 4, photo(F.lit(10**12))).when(kind == 5, text).otherwise(F.substring(local, 1, 2**30).substr(F.lit(1), F.length(local) - 1))
    )
    # Fixed value: folders the files are dealt to, so that none has to hold them all.
    name = F.concat(F.lit("d"), F.pmod(F.xxhash64("doc_id"), F.lit(1024)).cast("string"), F.lit("/f"), F.col("doc_id").cast("string"))
    return docs.select(name.alias("name"), made.alias("content"))


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n, doc_id % 7 AS k FROM documents)
SELECT doc_id, CASE WHEN k < 3 THEN 'pro-xdr' WHEN k = 3 THEN 'motion-photo' ELSE 'error' END AS kind,
 CASE k WHEN 4 THEN 'motion-photo' WHEN 5 THEN 'unsupported' WHEN 6 THEN 'unsupported' END AS stage,
 CASE k WHEN 4 THEN 'the video is not where the still says' WHEN 5 THEN 'no manifest' WHEN 6 THEN 'no marker' END AS reason,
 CASE k WHEN 0 THEN 'lhdr' WHEN 1 THEN 'uhdr' WHEN 2 THEN 'uhdr' END AS hdr_mode, CASE k WHEN 0 THEN 36 WHEN 1 THEN 20 WHEN 2 THEN 20 END AS n_floats,
 CASE k WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 3.5::DOUBLE WHEN 2 THEN 4.926::DOUBLE END AS fifth, CASE WHEN k = 3 THEN n + 12 END AS video_length, CASE WHEN k = 3 THEN 77 END AS presentation_us,
 CASE WHEN k = 0 THEN 4 + n + 144 WHEN k < 3 THEN 4 + n + 80 END AS gain_at, CASE WHEN k < 3 THEN sha256('\\xFF\\xD8'::BLOB || encode(t)) END AS gain_sha256, true AS reads_little
FROM d""")
def probe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as containers, stills with videos and foreign files, told by heads, tails and ranges of 1 kB."""
    folder = scratch_folder(spark)
    docs = read(spark, sf_dir, "documents").repartition(spark.sparkContext.defaultParallelism, "doc_id")
    probe.write_files(_containers(docs), folder).write.mode("overwrite").format("noop").save()
    found = probe.probe(probe.heads_and_tails(spark, [folder], head=1024, tail=1024))
    found = found.withColumn("reads_little", F.col("bytes_read") <= F.least(F.col("size"), F.lit(2048)) + 1024)
    parts = probe.extract(found).select("path", F.sha2("gain_map_bytes", 256).alias("gain_sha256"))
    return found.join(parts, "path", "left").select(
        F.regexp_extract("path", r"f(-?\d+)$", 1).cast("long").alias("doc_id"), "kind", "stage", "reason", "hdr_mode", F.when(F.col("kind") == "pro-xdr", F.size("metadata")).alias("n_floats"), F.round(F.col("metadata")[4], 5).alias("fifth"),
        F.col("video")["length"].alias("video_length"), "presentation_us", F.col("gain_map")["offset"].alias("gain_at"), "gain_sha256", "reads_little",
    )


# --- placement -------------------------------------------------------------------------------


def placement_inputs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents as assets of one to three files in a directory a language and source; each 50th document is a file that is there.

    A third of the assets share one name; others have names that look numbered, or their own.
    """
    d, digest = F.col("doc_id"), F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 8)
    folder = F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce("source", F.lit("")))
    n = F.pmod(d, F.lit(3))
    stem = F.when(n == 0, "IMG").when(n == 1, F.concat(F.lit("IMG ("), (F.pmod(d, F.lit(5)) + 1).cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("note"), F.pmod(d, F.lit(11)).cast("string")))
    endings = F.slice(F.array(F.lit("txt"), F.lit("json"), F.lit("md")), 1, (F.pmod(F.floor(d / 3), F.lit(3)) + 1).cast("int"))
    files = docs.select(folder.alias("directory"), d.cast("string").alias("asset"), stem.alias("stem"), digest.alias("digest"), F.explode(endings).alias("ending"))
    resources = files.select(
        "directory", "asset", F.concat(F.lpad("asset", 12, "0"), F.lit("."), "ending").alias("path"), F.concat("stem", F.lit("."), "ending").alias("name"), F.when(F.col("ending") == "json", F.lit("same")).otherwise(F.col("digest")).alias("fingerprint")
    )
    there = docs.where(F.pmod(d, F.lit(50)) == 7).select(folder.alias("directory"), F.lit("IMG (2).txt").alias("name"), digest.alias("fingerprint"))
    return resources, there


@query()
def placement_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations of all documents' files; tests replay the serial rule over the same table."""
    return placement.place(*placement_inputs(read(spark, sf_dir, "documents")))


# --- publication -----------------------------------------------------------------------------

_BATCHES = 3


def _publish_sql() -> str:
    """Batch after batch: judged against the files of those before."""
    out = [
        """r AS (SELECT CAST(doc_id // 2 AS VARCHAR) AS asset, (doc_id // 2) % 3 AS b, CASE WHEN doc_id % 7 = 0 THEN 'shared/' || (doc_id % 21) ELSE coalesce(lang, '') || '/' || (doc_id % 601) END AS destination,
 CASE WHEN doc_id % 7 = 0 THEN 'same' ELSE coalesce(text, '') END AS content, doc_id % 31 = 5 AS wrong FROM documents),
s AS (SELECT asset, b, destination, sha256(content) AS digest, bool_or(wrong) AS wrong FROM r GROUP BY ALL),
f0 AS (SELECT '' AS asset, '' AS destination, '' AS digest WHERE false)"""
    ]
    for i in range(_BATCHES):
        out.append(
            f"""c{i} AS (SELECT destination, min(asset) AS first, count(DISTINCT CASE WHEN wrong THEN 'bad' ELSE digest END) AS contents FROM s WHERE b = {i} GROUP BY 1),
j{i} AS (SELECT s.asset, bool_or(wrong) AS wrong, bool_or(coalesce(f.digest <> CASE WHEN wrong THEN 'bad' ELSE s.digest END, false) OR s.asset <> first AND contents > 1) AS clash, bool_and(f.digest IS NOT NULL) AS every FROM s JOIN c{i} USING (destination) LEFT JOIN f{i} f USING (destination) WHERE b = {i} GROUP BY 1),
t{i} AS (SELECT asset, 'batch-{i}' AS txn, CASE WHEN wrong THEN 'failed' WHEN clash THEN 'conflict' WHEN every THEN 'skipped' ELSE 'published' END AS status FROM j{i}),
n{i} AS (SELECT min(s.asset) AS asset, destination, any_value(digest) AS digest FROM s JOIN t{i} ON s.asset = t{i}.asset AND status = 'published' WHERE b = {i} AND destination NOT IN (SELECT destination FROM f{i}) GROUP BY destination),
f{i + 1} AS (SELECT * FROM f{i} UNION ALL SELECT * FROM n{i})"""
        )
    every = " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(_BATCHES))
    return "WITH " + ",\n".join(out) + f" SELECT t.asset, txn, status, count(f.destination) AS files, coalesce(md5(string_agg(digest, ',' ORDER BY digest)), '') AS digests FROM ({every}) t LEFT JOIN f{_BATCHES} f USING (asset) GROUP BY ALL"


class _Died(Exception):
    pass


@query(_publish_sql())
def publish_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents published as assets of two files in three transactions; each dies once in either phase and is run again."""
    publisher = Publisher(spark, scratch_folder(spark))
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    shared = d % 7 == 0
    content = F.when(shared, "same").otherwise(text)
    digest = F.when(d % 31 == 5, "bad").otherwise(F.sha2(content.cast("binary"), 256))
    destination = F.when(shared, F.concat(F.lit("shared/"), (d % 21).cast("string"))).otherwise(F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), (d % 601).cast("string")))
    files = read(spark, sf_dir, "documents").select(F.expr("cast(doc_id div 2 as string)").alias("asset"), (F.expr("doc_id div 2") % _BATCHES).alias("b"), destination.alias("destination"), content.alias("content"), digest.alias("digest"))

    def die(phase: str) -> None:
        if phase == dying:
            raise _Died

    for i in range(_BATCHES):
        for dying in ("prepared", "judged", ""):
            try:
                publisher.publish(files.where(F.col("b") == i), f"batch-{i}", die)
            except _Died:
                continue
    made = publisher.published().groupBy("asset").agg(F.count(F.lit(1)).alias("files"), F.md5(F.array_join(F.array_sort(F.collect_list("digest")), ",").cast("binary")).alias("digests"))
    return publisher.statuses().join(made, "asset", "left").select("asset", "txn", "status", F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.coalesce("digests", F.lit("")).alias("digests"))


# --- tiles and local fits --------------------------------------------------------------------

_WIDE = 125
_IMAGE_SQL = f"i AS (SELECT event_id // {_WIDE} AS y, event_id % {_WIDE} AS x, sqrt(least(1.0, abs(value) / 500.0)) AS r, (user_id % 11) / 10.0 AS g, (event_id * 7 % 13) / 12.0 AS b, event_type <> 'click' AS ok FROM events WHERE event_id >= 0 AND value IS NOT NULL)"


def image_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the pixels of one image, row by row as they were numbered."""
    e = F.col("event_id")
    shown = read(spark, sf_dir, "events").where("event_id >= 0 and value is not null")
    return shown.select(
        F.lit("events").alias("image"), F.expr(f"event_id div {_WIDE}").alias("y"), (e % _WIDE).alias("x"), F.sqrt(F.least(F.lit(1.0), F.abs("value") / 500.0)).alias("r"), ((F.col("user_id") % 11) / 10.0).alias("g"), ((e * 7 % 13) / 12.0).alias("b"),
        (F.col("event_type") != "click").cast("double").alias("ok"),
    )


@query(f"""
WITH {_IMAGE_SQL}, o AS (SELECT a.range AS dy, b.range AS dx FROM range(-2, 3) a, range(-2, 3) b),
s AS (SELECT y + dy AS y, x + dx AS x, r FROM i, o WHERE ok)
SELECT i.y, i.x, round(coalesce(sum(s.r) / greatest(count(s.r), 1), 0), 6) AS blurred FROM i LEFT JOIN s USING (y, x) GROUP BY ALL""")
def tiled_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the sound pixels around each pixel, on tiles of 32 x 32 with halos of two."""
    cut = tiles.cut(image_pixels(spark, sf_dir), ["image"], ["r", "ok"], 32)
    sound = cut.withColumn("ok", F.transform("ok", lambda v: F.when(F.isnan(v), 0.0).otherwise(v)))
    blurred = tiles.samples_of(tiles.filtered(sound, ["image"], ["r", "ok"], 2, raster.box_blur_kernel(2), "blurred"), ["image"], ["r", "blurred"])
    return blurred.where(~F.isnan("r")).select("y", "x", F.round("blurred", 6).alias("blurred"))


def _spot_sql(pixel: str, extent: str, count: int) -> str:
    pitch = f"(ceil({extent} / {count}.0) + ceil({extent} / {count}.0) % 2)"
    held = f"greatest({pitch} / 2 - 1, least({pitch} / 2 - 1 + {pitch} * {count - 1}, {pixel}))"
    return f"(0.5 + ({held} - ({pitch} / 2 - 1)) * {count - 1} / greatest(1.0, {pitch} * {count - 1}))"


_SPREAD_SQL = f"""{_IMAGE_SQL},
z AS (SELECT *, max(y) OVER () + 1 AS h, max(x) OVER () + 1 AS w FROM i),
p AS (SELECT *, {_spot_sql("y", "h", lattice.SHORT)} AS ay, {_spot_sql("x", "w", lattice.LONG)} AS ax, 0.5 * ((r + g + b) / 3 + greatest(r, g, b)) AS bright FROM z),
q AS (SELECT *, least(greatest(floor(ay), 0), {lattice.SHORT - 1}) AS y0, least(greatest(floor(ax), 0), {lattice.LONG - 1}) AS x0, list_transform(range(8), lambda k: exp(-0.5 * pow((bright - (k + 1) / 9.0) * 8 / 2.5, 2))) AS pw FROM p),
c AS (SELECT y, x, r, g, b, pw, unnest([{{'cy': y0, 'w': CASE WHEN y0 = {lattice.SHORT - 1} THEN 1 ELSE 1 - (ay - y0) END}}, {{'cy': y0 + 1, 'w': CASE WHEN y0 = {lattice.SHORT - 1} THEN 0 ELSE ay - y0 END}}]) AS cy, x0, ax FROM q),
d AS (SELECT y, x, r, g, b, pw, cy.cy AS cell_y, cy.w AS wy, unnest([{{'cx': x0, 'w': CASE WHEN x0 = {lattice.LONG - 1} THEN 1 ELSE 1 - (ax - x0) END}}, {{'cx': x0 + 1, 'w': CASE WHEN x0 = {lattice.LONG - 1} THEN 0 ELSE ax - x0 END}}]) AS cx FROM c),
e AS (SELECT y, x, r, g, b, CAST(cell_y AS INTEGER) AS cell_y, CAST(cx.cx AS INTEGER) AS cell_x, wy * cx.w AS share, pw, list_sum(pw) AS total, unnest(range(8)) AS plane FROM d WHERE wy * cx.w > 0),
v AS (SELECT y, x, r, g, b, cell_y, cell_x, CAST(plane AS INTEGER) AS plane, share * pw[plane + 1] / total AS weight FROM e)"""


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = image_pixels(spark, sf_dir)
    extent = shown.agg((F.max("y") + 1).alias("rows"), (F.max("x") + 1).alias("cols"))  # one row
    aim = {f"to_{c}": 0.9 * F.col(c) + 0.1 * F.col(c) * F.col(c) + 0.02 for c in "rgb"}
    return local_fits.local_moments(shown.join(F.broadcast(extent)).withColumns(aim), ["image"])


@query(f"""
WITH {_SPREAD_SQL}
SELECT cell_x, cell_y, plane, round(sum(weight), 6) AS weight, round(sum(weight * r * g), 6) AS red_green, round(sum(weight * b * b * b * b), 6) AS blue_4, round(sum(weight * g * (0.1 * r * r - 0.1 * r + 0.02)), 6) AS green_to_red, round(sum(weight * b * b * (0.1 * b * b - 0.1 * b + 0.02)), 6) AS blue_to_blue FROM v GROUP BY ALL""")
def local_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the weighted products of an image's colours, by cell and plane; five of the 85 that the fits use."""
    at = {pair: f"s{k}" for k, pair in enumerate(local_fits.UPPER)}
    n = len(local_fits.UPPER)
    some = {"weight": at[0, 0], "red_green": at[1, 2], "blue_4": at[9, 9], "green_to_red": f"s{n + 2 * 3}", "blue_to_blue": f"s{n + 9 * 3 + 2}"}
    return _moments(spark, sf_dir).select("cell_x", "cell_y", "plane", *(F.round(c, 6).alias(name) for name, c in some.items()))


@query()
def local_fit_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadratic blocks of every cell and plane of the image, changes held to 0.25 and 0.1; tests hold them against numpy."""
    return local_fits.local_fits(_moments(spark, sf_dir), ["image"], 0.25, 0.1)


@query(f"""
WITH {_SPREAD_SQL}, n AS (SELECT count(*) AS n FROM part), s AS (SELECT p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS nth FROM part),
t AS (SELECT v.y, v.x, v.r, v.g, v.b, weight, ((cell_x * {lattice.SHORT} + cell_y) * {lattice.PLANES} + plane) AS block, [1, r, g, b, r * r, r * g, r * b, g * g, g * b, b * b] AS basis FROM v),
u AS (SELECT y, x, weight * basis[k + 1] AS part, block * 30 + k * 3 AS place, k FROM (SELECT *, unnest(range(10)) AS k FROM t)),
m AS (SELECT y, x, part, k, c, (place + c) % n AS nth FROM (SELECT *, unnest(range(3)) AS c FROM u), n)
SELECT y, x, round(sum(part * ((p_size - 25) / 500.0 + CASE WHEN k = c + 1 THEN 1 ELSE 0 END)) FILTER (c = 0), 6) AS r, round(sum(part * ((p_size - 25) / 500.0 + CASE WHEN k = c + 1 THEN 1 ELSE 0 END)) FILTER (c = 1), 6) AS g, round(sum(part * ((p_size - 25) / 500.0 + CASE WHEN k = c + 1 THEN 1 ELSE 0 END)) FILTER (c = 2), 6) AS b
FROM m JOIN s USING (nth) GROUP BY y, x""")
def local_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lattice whose numbers are part sizes, applied to the image on tiles of 32 x 32."""
    sizes = placement.in_order(read(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_partkey"], "at").select((F.col("at") - 1).alias("at"), "p_size")
    n = sizes.agg(F.count(F.lit(1)).alias("n"))
    blocks = spark.range(lattice.LONG * lattice.SHORT * lattice.PLANES * lattice.BLOCK).join(F.broadcast(n)).withColumn("at", F.col("id") % F.col("n")).join(sizes, "at")
    place = F.col("id") % lattice.BLOCK
    number = (F.col("p_size") - 25) / 500.0 + F.when(place.isin(*lattice.UNIT), 1.0).otherwise(0.0)
    block = F.floor(F.col("id") / lattice.BLOCK)
    cells = blocks.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), number.alias("v")))).alias("c")).select(
        F.lit("events").alias("image"), F.floor(F.col("block") / (lattice.SHORT * lattice.PLANES)).cast("int").alias("cell_x"), (F.floor(F.col("block") / lattice.PLANES) % lattice.SHORT).cast("int").alias("cell_y"), (F.col("block") % lattice.PLANES).cast("int").alias("plane"), F.col("c.v").alias("coefficients")
    )
    cut = tiles.cut(image_pixels(spark, sf_dir), ["image"], ["r", "g", "b"], 32)
    shown = tiles.samples_of(tiles.apply_local(cut, ["image"], cells), ["image"], ["out_r", "out_g", "out_b"]).where(~F.isnan("out_r"))
    return shown.select("y", "x", *(F.round(f"out_{c}", 6).alias(c) for c in "rgb"))


# --- resampling ------------------------------------------------------------------------------


@query("SELECT r AS round, count(DISTINCT o_custkey) AS draws FROM orders, (SELECT unnest(range(50)) AS r) GROUP BY 1")
def bootstrap_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of 50 rounds draws exactly as many customers as have orders, from blocks of 256."""
    return resample.bootstrap_rounds(read(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", rounds=50, block=256).select("round", "draws")


# --- packed records --------------------------------------------------------------------------


def _bits(*fields: tuple[Column, int]) -> Column:
    """Fields one after the other as a string of bits, filled up to whole bytes."""
    bits = F.concat(*(F.lpad(F.conv(v.cast("string"), 10, 2), w, "0") for v, w in fields))
    return F.rpad(bits, sum(w for _, w in fields) + -sum(w for _, w in fields) % 8, "0")


def _packed(bits: Column) -> Column:
    """The bytes of a string of bits."""
    digits = F.transform(F.sequence(F.lit(1), F.length(bits), F.lit(8)), lambda i: F.lpad(F.conv(F.substr(bits, i, F.lit(8)), 2, 16), 2, "0"))
    return F.unhex(F.array_join(digits, ""))


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, p_partkey % 1000 AS a, p_size AS s FROM part)
SELECT p_partkey, CASE k WHEN 3 THEN 'statistics' WHEN 4 THEN 'truncated' END AS reason, CASE WHEN k IN (0, 2) THEN 1000 + s END AS maximum_content, CASE WHEN k IN (1, 2) THEN a END AS minimum, CASE WHEN k IN (1, 2) THEN a + s END AS average,
 CASE WHEN k IN (1, 2) THEN 2000 + s END AS target, CASE WHEN k IN (1, 2) THEN a * 16 END AS m_p, CASE WHEN k IN (1, 2) THEN p_partkey % 128 END AS delta, CASE WHEN k IN (1, 2) AND s % 2 = 0 THEN 3 * s END AS mb, CASE WHEN k IN (1, 2) THEN 255 - s END AS strength, CASE WHEN k IN (1, 2) THEN s || ',' || (s + 1) END AS gains FROM p""")
def registered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered HDR record for each part, packed bit by bit: display, statistics, a tone map with a base and a spline, gains; broken ones too."""
    p, s = F.col("p_partkey"), F.col("p_size").cast("long")
    k, a, one = p % 5, p % 1000, lambda v: F.lit(v)
    head = [(one(1), 8), (a, 12), (F.when(k == 3, F.lit(4095)).otherwise(a + s), 12), (s, 12), (a + s, 12), (one(1), 1), (one(0), 1), (2000 + s, 12), (one(1), 1)]
    base = [(a * 16, 14), (s % 64, 6), (a, 10), (s % 64, 6), (a, 10), (one(1), 2), (one(2), 2), (one(3), 4), (one(4), 3), (p % 128, 7)]
    # A spline with a threshold in one more byte, for even sizes, is the longer of two layouts.
    spline = lambda even: [(one(1), 1), (one(0), 1), (one(0 if even else 1), 2), *([(3 * s, 8)] if even else []), (s, 12), (s, 10), (s, 10), (255 - s, 8)]
    tail = [(one(1), 1), (one(2), 3), (s, 8), (s + 1, 8)]
    number = lambda v, w: F.unhex(F.lpad(F.hex(v.cast("long")), 2 * w, "0"))
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(s % 2 == 0, _bits(*head, *base, *spline(True), *tail)).otherwise(_bits(*head, *base, *spline(False), *tail)).alias("bits"))
    parts = parts.withColumn("moving", _packed(F.col("bits")))
    moving = F.col("moving")
    still = F.concat(F.unhex(F.lit("84D03E8033C286C41D4C0BB83D1340420098968000000032")), number(1000 + s, 2), number(F.lit(400), 2))
    with_still, with_moving = k.isin(0, 2, 4), k.isin(1, 2, 3)
    nothing = F.unhex(F.lit(""))
    section = F.concat(number(F.when(with_still, 28).otherwise(0), 2), F.when(with_still, still).otherwise(nothing), number(F.when(with_moving, F.length(moving)).otherwise(0), 2), F.when(with_moving, moving).otherwise(nothing))
    whole = F.concat(F.unhex(F.lit(packed.PREFIX.hex())), number(F.lit(packed.PLAIN), 4), number(F.length(section), 2), section)
    raw = F.when(k == 4, F.substr(whole, F.lit(1), F.length(whole) - 3)).otherwise(whole)
    got = packed.registered_hdr(parts.select("p_partkey", raw.alias("raw")), ["p_partkey"], "raw")
    tone = F.get("tone_maps", F.lit(0))
    return got.select(
        "p_partkey", "reason", F.col("display.maximum_content").alias("maximum_content"), F.col("statistics.minimum").alias("minimum"), F.col("statistics.average").alias("average"), tone["target"].alias("target"), tone["base"]["m_p"].alias("m_p"),
        tone["base"]["delta"].alias("delta"), F.get(tone["splines"], F.lit(0))["mb"].alias("mb"), F.get(tone["splines"], F.lit(0))["strength"].alias("strength"), F.array_join("gains", ",").alias("gains"),
    )


# --- dual-layer stills -----------------------------------------------------------------------


def _little(x: Column) -> Column:
    digits = F.lpad(F.hex(x.cast("long")), 8, "0")
    return F.unhex(F.concat(*(F.substring(digits, i, 2) for i in (7, 5, 3, 1))))


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, 104 + strlen(p_name) AS base, 14 + strlen(p_type) AS gain FROM part)
SELECT p_partkey, CASE k WHEN 2 THEN 'second entry' WHEN 3 THEN 'whole images' WHEN 4 THEN 'one index' WHEN 5 THEN 'index' END AS rule, CASE k WHEN 5 THEN 'count differs' END AS detail,
 CASE WHEN k < 2 THEN base END AS base_end, CASE WHEN k < 2 THEN base END AS gain_start, CASE WHEN k < 2 THEN base + gain END AS gain_end, CASE WHEN k < 2 THEN 10 END AS tiff FROM p""")
def dual_layer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stills and an index for each part, its name and type as their scans; cut, without an index, or with a false one too."""
    p, name, kind = F.col("p_partkey"), F.col("p_name").cast("binary"), F.col("p_type").cast("binary")
    k, raw = p % 6, lambda h: F.unhex(F.lit(h))
    base, gain = 104 + F.length(name), 14 + F.length(kind)
    still = lambda body, first=None: F.concat(raw("FFD8"), *([first] if first is not None else []), raw("FFDA000801010000003F"), body, raw("FFD9"))
    fields = "00B0070004000000" + "30313030" + "01B0040001000000", "02B0070020000000" + "32000000" + "00000000"
    entries = F.concat(raw("00000300"), _little(base), raw("0000000000000000"), raw("00000000"), _little(gain + F.when(k == 2, 2).otherwise(0)), _little(base - 10), raw("00000000"))
    index = F.concat(raw("FFE20058" + "4D504600" + "49492A0008000000" + "0300" + fields[0]), _little(F.when(k == 5, 3).otherwise(2)), raw(fields[1]), entries)
    with_index = F.concat(still(name, index), still(kind))
    content = F.when(k == 4, F.concat(still(name), still(kind))).when(k == 3, F.substr(with_index, F.lit(1), F.length(with_index) - 2)).otherwise(with_index)
    found = dual_layer.index_dual_layer(read(spark, sf_dir, "part").select(p.cast("string").alias("path"), content.alias("content")))
    return found.select(F.col("path").cast("long").alias("p_partkey"), "rule", "detail", "base_end", "gain_start", "gain_end", "tiff")


# --- item graphs -----------------------------------------------------------------------------


def _written(rows: DataFrame) -> DataFrame:
    """(path, rows, columns, width, height, depth, wrong) -> (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [heif(*row) for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return rows.select("path", "rows", "columns", "width", "height", "depth", "wrong").mapInArrow(run, "path string, content binary")


_CASES = list(WRONG)


@query(f"""
WITH p AS (SELECT p_partkey, p_size AS s, {[w for w in _CASES]!r}[p_partkey % {len(_CASES)} + 1] AS wrong, {[WRONG[w] or '' for w in _CASES]!r}[p_partkey % {len(_CASES)} + 1] AS told, 2 + p_size % 3 AS r, 1 + p_size % 4 AS c FROM part)
SELECT p_partkey, nullif(told, '') AS rule, CASE WHEN told = 'integrity' THEN wrong END AS detail, CASE WHEN told = '' THEN r * c END AS n_tiles, CASE WHEN told = '' THEN r END AS rows, CASE WHEN told = '' THEN c END AS columns, CASE WHEN told = '' THEN 100 + s END AS width, CASE WHEN told = '' THEN 200 + s END AS height,
 CASE WHEN told = '' THEN CASE WHEN s % 2 = 0 THEN 8 ELSE 10 END END AS depth, CASE WHEN told = '' THEN '10,10,10' END AS out_depths, CASE WHEN told = '' THEN 16 END AS transfer FROM p""")
def gain_map_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A HEIF file with a gain map for each part, of its size, sound or with one thing wrong, judged by joins of item facts."""
    s = F.col("p_size")
    wrong = F.element_at(F.array(*map(F.lit, _CASES)), (F.col("p_partkey") % len(_CASES) + 1).cast("int"))
    made = _written(read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), (2 + s % 3).alias("rows"), (1 + s % 4).alias("columns"), (100 + s).alias("width"), (200 + s).alias("height"), F.when(s % 2 == 0, 8).otherwise(10).alias("depth"), wrong.alias("wrong")))
    folder = scratch_folder(spark)
    item_graph.item_facts(made).write.parquet(folder)  # the facts are joined many times: the files are walked once
    found = item_graph.gain_map_semantics(spark.read.parquet(folder))
    return found.select(
        F.col("path").cast("long").alias("p_partkey"), "rule", "detail", "n_tiles", "rows", "columns", "width", "height", F.col("luma_depth").alias("depth"), F.array_join(F.transform("out_depths", lambda d: d.cast("string")), ",").alias("out_depths"), F.col("nclx.transfer").alias("transfer")
    )


# --- scans -----------------------------------------------------------------------------------

_TREE_SQL = "'lib' || (doc_id % 3) || CASE WHEN doc_id % 7 = 0 THEN '/.hid' WHEN doc_id % 2 = 0 THEN '/deep/er' ELSE '' END || '/' || CASE WHEN doc_id % 11 = 0 THEN '.' ELSE '' END || 'IMG_' || doc_id || '.' || ['jpg', 'HEIC', 'Mov', 'txt', 'JPEG', 'mp4'][doc_id % 6 + 1]"


@query(f"""
WITH f AS (SELECT doc_id, {_TREE_SQL} AS path, strlen(coalesce(text, '')) AS length FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0)
SELECT 'still' AS kind, path, length FROM f WHERE doc_id % 6 IN (0, 1, 4) UNION ALL SELECT 'video', path, length FROM f WHERE doc_id % 6 IN (2, 5) AND doc_id % 3 = 2""")
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a tree of files: stills below overlapping roots, and videos below one, each once, without hidden ones."""
    d = F.col("doc_id")
    ending = F.element_at(F.array(*map(F.lit, ("jpg", "HEIC", "Mov", "txt", "JPEG", "mp4"))), (d % 6 + 1).cast("int"))
    name = F.concat(F.lit("lib"), (d % 3).cast("string"), F.when(d % 7 == 0, "/.hid").when(d % 2 == 0, "/deep/er").otherwise(""), F.lit("/"), F.when(d % 11 == 0, ".").otherwise(""), F.lit("IMG_"), d.cast("string"), F.lit("."), ending)
    folder = scratch_folder(spark)
    docs = read(spark, sf_dir, "documents").select(name.alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    probe.write_files(docs.repartition(spark.sparkContext.defaultParallelism, "name"), folder).write.mode("overwrite").format("noop").save()
    stills = files.scan(spark, [folder, f"{folder}/lib0", f"{folder}/lib1/"]).select(F.lit("still").alias("kind"), "path", "length")
    videos = files.scan(spark, [f"{folder}/lib2"], video=True).select(F.lit("video").alias("kind"), "path", "length")
    return stills.unionByName(videos).select("kind", F.regexp_extract("path", r"(lib\d/.*)$", 1).alias("path"), "length")


# --- colour ----------------------------------------------------------------------------------

_LINES = ["l_orderkey", "l_linenumber"]
_CURVE = [(i / 255) ** 0.75 for i in range(256)]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(*_LINES, (F.col("l_quantity") / 50).alias("r"), (F.col("l_discount") * 10).alias("g"), (F.col("l_tax") * 10).alias("b"), (F.col("l_extendedprice") / 110000).alias("p"))


_LINES_SQL = "x AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS r, l_discount * 10 AS g, l_tax * 10 AS b, l_extendedprice / 110000 AS p FROM lineitem)"
_half_sql = lambda x: f"(sign({x}) * round_even(abs({x}) / pow(2.0, -24 + {' + '.join(f'CAST(abs({x}) >= {2.0**k!r} AS INTEGER)' for k in range(-13, 16))}), 0) * pow(2.0, -24 + {' + '.join(f'CAST(abs({x}) >= {2.0**k!r} AS INTEGER)' for k in range(-13, 16))}))"


@query(f"""
WITH {_LINES_SQL}, m AS (SELECT *, least(1, greatest(0, 0.9 * r + 0.2 * g - 0.1 * b)) AS u, least(1, greatest(0, 0.1 * r + 0.8 * g + 0.1 * b)) AS v, least(1, greatest(0, b - 0.3 * r)) AS w FROM x)
SELECT l_orderkey, l_linenumber, round((u + v) / 2, 6) AS red, round(v * w, 6) AS green, round(1 - u, 6) AS blue FROM m""")
def matrix_then_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, discount and tax as a colour, through a matrix whose results leave the domain, then through a table."""
    grid = [i / 4 for i in range(5)]
    table = raster.lut_trilinear(5, [((r + g) / 2, g * b, 1 - r) for b in grid for g in grid for r in grid])
    rgb = colour.mapped(F.col("r"), F.col("g"), F.col("b"), [[0.9, 0.2, -0.1], [0.1, 0.8, 0.1], [-0.3, 0.0, 1.0]], table)
    return _lines(spark, sf_dir).select(*_LINES, rgb.alias("rgb")).select(*_LINES, *(F.round(F.col("rgb")[i], 6).alias(n) for i, n in enumerate(("red", "green", "blue"))))


def _bt2020_sql() -> str:
    m = colour.TO_BT2020["p3"]
    row = lambda i, c: " + ".join(f"({m[i][j]!r}) * {c[j]}" for j in range(3))
    lit = lambda c: f"(pow(2.0, p * (-1 + pow(g, 1 / 1.5) * 3)) * ({c} + 0.015625) - 0.03125)"
    own = [lit(c) for c in "rgb"]
    wide = [lit(f"({row(i, 'rgb')})") for i in range(3)]
    return f"WITH {_LINES_SQL} SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({row(i, own)}, 6) AS own_{'rgb'[i]}, round({wide[i]}, 6) AS wide_{'rgb'[i]}" for i in range(3)) + " FROM x"


@query(_bt2020_sql())
def bt2020_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with a gain applied in their own primaries and in BT.2020, given in BT.2020."""
    base, made = [F.col(c) for c in "rgb"], {}
    for name, own in (("own", True), ("wide", False)):
        found = colour.reconstructed(base, [F.col("g")], F.col("p"), [F.lit(-1.0)], [F.lit(2.0)], [1.5], [0.015625], [0.03125], "p3", own)
        made |= {f"{name}_{c}": F.round(v, 6) for c, v in zip("rgb", found, strict=True)}
    return _lines(spark, sf_dir).select(*_LINES, *(v.alias(n) for n, v in made.items()))


@query(f"""
WITH {_LINES_SQL}, c AS (SELECT list_transform(range(256), lambda i: pow(i / 255.0, 0.75)) AS curve), y AS (SELECT *, least(1.3 * p, 1.0) AS x1 FROM x),
h AS (SELECT *, CAST(CAST(least(1, greatest(0, x1)) AS FLOAT) * CAST(255 AS FLOAT) AS DOUBLE) AS s FROM y), k AS (SELECT *, least(255.0, {_half_sql("s")}) AS place FROM h),
t AS (SELECT *, x1 * (1 - 0.6) + 0.6 * (curve[CAST(floor(place) AS INTEGER) + 1] * (1 - (place - floor(place))) + curve[CAST(least(255, floor(place) + 1) AS INTEGER) + 1] * (place - floor(place))) AS target FROM k, c),
q AS (SELECT *, CASE WHEN r - 0.02 < 1 / 255.0 THEN 0 ELSE target / (r - 0.02) END AS ratio FROM t),
z AS (SELECT *, ratio * 0.75 + 0.25 AS back, ratio * 0.5 + 0.5 AS fore FROM q)
SELECT l_orderkey, l_linenumber, round(((back * (1 - g) + least(back, 1) * g) * (1 - b) + (fore * 0.3 + least(fore, 1) * 0.7) * b) * (r - 0.02), 6) AS toned FROM z""")
def semantic_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tone stage over lines: quantity as the channel, price as its thumbnail, discount as a highlight and tax as the matte."""
    toned = colour.semantic_tone(F.col("r") - 0.02, F.col("p"), _CURVE, F.lit(1.3), F.lit(0.6), (F.lit(0.25), F.lit(0.5)), (F.col("g"), F.lit(0.7)), F.col("b"))
    return _lines(spark, sf_dir).select(*_LINES, F.round(toned, 6).alias("toned"))


@query(f"WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings) SELECT vec_id, CAST(place AS INTEGER) AS place, CASE WHEN v = 0 THEN 0 ELSE {_half_sql('v')} END AS value, true AS alike FROM e")
def half_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings packed as 16-bit floats and read back, against the rounding rule as a column expression."""
    packed_up = read(spark, sf_dir, "embeddings").select("vec_id", raster.unpack_half(raster.pack_half(F.col("embedding"))).alias("back"), "embedding")
    each = packed_up.select("vec_id", F.posexplode(F.arrays_zip("back", "embedding")).alias("place", "v"))
    return each.select("vec_id", "place", F.col("v.back").cast("double").alias("value"), (F.col("v.back").cast("double") == colour.half_rounded(F.col("v.embedding"))).alias("alike"))
