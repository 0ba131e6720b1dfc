"""More named queries: files and containers, text forms, inverse functions, sets, headroom and lattices.

Files are built from table rows, so the SQL states what was put in, not how it is found again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftworks.functions import decisions as dc, flags as fl, headroom as hr, text as tx, transfer as tr
from siftworks.operators import graphs, lattice, ordered, raster
from siftworks.operators.lineage import small_batches
from siftworks.plans.catalog import query, r6, read, rounded
from siftworks.sources import files, media


def _pick(at: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))


# --- files -----------------------------------------------------------------------------------

_PATH_SQL = "'/lib' || (doc_id % 2) || CASE WHEN doc_id % 7 = 0 THEN '/.hid/' ELSE '/' END || 'IMG_' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.conv (2)MP' WHEN doc_id % 5 = 1 THEN '.conv' ELSE '' END || '.' || [ 'jpg', 'HEIC', 'mov', 'txt' ][doc_id % 4 + 1]"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    path = F.concat(F.lit("/lib"), (d % 2).cast("string"), F.when(d % 7 == 0, "/.hid/").otherwise("/"), F.lit("IMG_"), d.cast("string"), F.when(d % 5 == 0, ".conv (2)MP").when(d % 5 == 1, ".conv").otherwise(""), F.lit("."), _pick(d, "jpg", "HEIC", "mov", "txt"))
    return read(spark, sf_dir, "documents").select("doc_id", path.alias("path"))


@query(f"SELECT doc_id, {_PATH_SQL} AS path, doc_id % 4 < 2 AS still, doc_id % 4 = 2 AS video, doc_id % 7 = 0 AS hidden, doc_id % 5 < 2 AS generated FROM documents")
def file_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, sf_dir).select("doc_id", "path", files.is_candidate(p).alias("still"), files.is_candidate(p, video=True).alias("video"), files.is_hidden(p).alias("hidden"), files.is_generated(p, "conv").alias("generated"))


@query(f"SELECT path, min(root) AS root FROM (SELECT {_PATH_SQL} AS path, '/lib' || (doc_id % 2) AS root FROM documents WHERE doc_id % 4 < 2 AND doc_id % 7 <> 0 UNION ALL SELECT {_PATH_SQL}, '/lib' || (doc_id % 2) FROM documents WHERE doc_id % 4 < 2 AND doc_id % 7 <> 0) GROUP BY path")
def file_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates below two lists of roots that overlap: each path once."""
    found = _paths(spark, sf_dir).where(files.is_candidate(F.col("path")) & ~files.is_hidden(F.col("path")))
    twice = found.unionByName(found).select("path", F.regexp_extract("path", r"^(/lib\d)", 1).alias("root"))
    return ordered.first_wins(twice, ["path"], ["root"])


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'heic' WHEN 2 THEN 'heic' END AS encoding FROM documents")
def still_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built heads: JPEG; a HEIC brand first; a HEIC brand behind 2,000 others; a brand that stands outside the box."""
    many = "000017E8" + "66747970" + "61766966" + "00000000" + "6D696631" * 1525 + "68656963"
    heads = ("FFD8FFE0", "00000018" + "66747970" + "68656963" + "00000000" + "6D696631" + "68656963", many, "00000010" + "66747970" + "61766966" + "00000000" + "68656963")
    head = F.unhex(_pick(F.col("doc_id"), *heads))
    return read(spark, sf_dir, "documents").select("doc_id", files.still_encoding(head).alias("encoding"))


@query("SELECT p_partkey, CASE WHEN p_size % 9 + 4 <= len(p_name) THEN substr(p_name, p_size % 9 + 1, 4) END AS part, substr(p_name, 3, 2) AS last_block, CAST(len(p_name) AS BIGINT) AS size, sha256(p_name) AS digest FROM part")
def byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges and named blocks of part names as bytes; of two blocks of a name the last counts, one outside is left out."""
    content = F.col("p_name").cast("binary")
    entry = lambda n, o, k: F.struct(F.lit(n).alias("name"), F.lit(o).cast("long").alias("offset"), F.lit(k).cast("long").alias("length"))
    named = files.blocks(content, F.array(entry("a", 0, 3), entry("b", 1, 2), entry("b", 2, 2), entry("b", 1000, 5)))
    cut = files.byte_range(content, F.col("p_size") % 9, F.lit(4), 64)
    sig = files.signature(content)
    return read(spark, sf_dir, "part").select("p_partkey", cut.cast("string").alias("part"), F.try_element_at(named, F.lit("b")).cast("string").alias("last_block"), sig["size"].alias("size"), sig["sha256"].alias("digest"))


@query("SELECT c_custkey, 'b,a' AS names, CAST(40 + c_nationkey AS BIGINT) AS furthest FROM customer")
def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest in the tail of a text, behind an older one; entries without an offset are left out."""
    tail = F.concat(F.lit('x[{"name":"old","offset":1,"length":1}]noise[{"name":"a","offset":3,"length":2},{"name":"b","offset":'), (F.col("c_nationkey") + 40).cast("string"), F.lit(',"length":9},{"name":"c"}]'))
    found = files.manifest(tail)
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(found, lambda x: x["name"]), ",").alias("names"), (-found[0]["start"]).alias("furthest"))


def _hex(x: Column, digits: int) -> Column:
    return F.lpad(F.hex(x), digits, "0")


def _jpegs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JPEG for each part: Exif with a colour space, a frame of size x (size + 1), sampled 2 x 2."""
    size = F.col("p_size").cast("long")
    exif = F.concat(F.lit("FFE10034" + "457869660000" + "49492A0008000000" + "0100" + "69870400" + "01000000" + "1A000000" + "00000000" + "0100" + "01A00300" + "01000000"), F.when(F.col("p_partkey") % 2 == 0, "0100").otherwise("FFFF"), F.lit("0000" + "00000000"))
    frame = F.concat(F.lit("FFC0000B08"), _hex(size + 1, 4), _hex(size, 4), F.lit("01012200"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.unhex(F.concat(F.lit("FFD8"), exif, frame, F.lit("FFD9"))).alias("content"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(marker AS INTEGER) AS marker, CAST(s AS BIGINT) AS start, CAST(n AS BIGINT) AS length FROM part, (VALUES (216, 0, 2), (225, 2, 54), (192, 56, 13), (217, 69, 2)) t(marker, s, n)")
def jpeg_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.jpeg_segments(_jpegs(spark, sf_dir)).select("path", "marker", "start", "length")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, p_size AS width, p_size + 1 AS height, 8 AS depth, '2x2' AS sampling, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 65535 END AS BIGINT) AS colour_space FROM part")
def jpeg_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _jpegs(spark, sf_dir)
    frames = media.jpeg_frames(made).select("path", "width", "height", "depth", F.array_join("sampling", ",").alias("sampling"))
    return frames.join(media.colour_space(media.exif_entries(made)), "path", "left")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS path, kind, depth, CAST(s AS BIGINT) AS start, CAST(n AS BIGINT) AS length FROM supplier, (VALUES ('ftyp', 0, 0, 16), ('moov', 0, 16, 43), ('trak', 1, 24, 35), ('hvcC', 2, 32, 27)) t(kind, depth, s, n)")
def iso_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.iso_boxes(_heifs(spark, sf_dir))


def _heifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ftyp, then moov > trak > hvcC of 19 bytes: profile 2, chroma format by supplier, 10 bits."""
    chroma = _hex((F.col("s_suppkey") % 4).cast("long") + 0xFC, 2)
    config = F.concat(F.lit("0000001B" + "68766343" + "0102" + "00" * 14), chroma, F.lit("FAFA"))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.unhex(F.concat(F.lit("00000010" + "66747970" + "6865696300000000" + "0000002B" + "6D6F6F76" + "00000023" + "7472616B"), config)).alias("content"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS path, CAST(2 AS BIGINT) AS profile, CAST(s_suppkey % 4 AS BIGINT) AS chroma_format, CAST(10 AS BIGINT) AS luma_depth FROM supplier")
def hevc_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _heifs(spark, sf_dir)
    found = media.box_fields(made, media.iso_boxes(made), "hvcC").withColumn("p", media.hevc_profile(F.col("payload")))
    return found.select("path", "p.profile", "p.chroma_format", "p.luma_depth")


# --- text forms ------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 3 THEN o_orderkey END AS parsed, CASE WHEN o_orderkey % 6 < 2 THEN o_orderkey END AS prefixed,
CASE WHEN o_orderkey % 6 < 2 OR o_orderkey % 6 = 3 THEN o_orderkey END AS scanned, CASE WHEN o_orderkey % 6 = 2 THEN o_orderkey END AS scanned_json,
CASE WHEN o_orderkey % 6 < 3 THEN 'ok' WHEN o_orderkey % 6 = 5 THEN 'missing-user-comment' ELSE 'malformed-user-comment' END AS status FROM orders""")
def flag_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments in six forms: two prefixes, JSON, a prefix behind one whose number is too large, none, empty."""
    k, n = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    raw = F.when(k % 6 == 0, F.concat(F.lit("ASCII oplus_"), n)).when(k % 6 == 1, F.concat(F.lit("OPPO_"), n, F.lit("x"))).when(k % 6 == 2, F.concat(F.lit('{"OplusTag": "'), n, F.lit('"}'))).when(k % 6 == 3, F.concat(F.lit("oplus_99999999999999999999 oplus_"), n)).when(k % 6 == 4, "nothing").otherwise(" ")
    df = read(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    as_long = lambda c: c.cast("long")
    r = F.col("raw")
    return df.select("o_orderkey", as_long(fl.parse_flags(r)).alias("parsed"), as_long(fl.parse_prefixed_flags(r)).alias("prefixed"), as_long(fl.scan_prefixed_flags(r)).alias("scanned"), as_long(fl.scan_json_flags(r)).alias("scanned_json"), fl.metadata_status(r, fl.parse_flags(r)).alias("status"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'classified' WHEN 1 THEN 'classified-with-unknown' WHEN 2 THEN 'unknown-flags' ELSE 'normal' END AS status FROM orders""")
def flag_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A known mode, a mode and an unknown bit, an unknown bit, no bit."""
    k = F.col("o_orderkey") % 4
    flags = F.when(k == 0, F.lit("2048")).when(k == 1, F.lit("2305843009213695984")).when(k == 2, F.lit("2305843009213693952")).otherwise("0").cast("decimal(20,0)")
    return read(spark, sf_dir, "orders").select("o_orderkey", fl.classification_status(fl.modes(flags), flags, F.lit("ok")).alias("status"))


_LICENCES = ("CC0", "Public domain", "public-domain", "CC BY 4.0", "CC BY-SA 3.0", "CC BY-NC 4.0", "cc0 1.0", "pd", "CC BY 3.5", "cc by 4.0")


@query(f"""SELECT p_partkey, licence FROM (SELECT p_partkey, {list(_LICENCES)}[p_partkey % 10 + 1] AS licence, p_size % 3 AS m FROM part) WHERE licence IN ('CC0', 'Public domain', 'public-domain', 'CC BY 4.0', 'CC BY-SA 3.0') AND m < 2""")
def open_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a free licence and an image type, of ten spellings of licences and three types."""
    df = read(spark, sf_dir, "part").select("p_partkey", _pick(F.col("p_partkey"), *_LICENCES).alias("licence"), _pick(F.col("p_size"), "image/jpeg", "image/webp", "image/gif").alias("mime"))
    return df.where(tx.open_licence(F.col("licence")) & F.col("mime").isin("image/jpeg", "image/png", "image/webp")).select("p_partkey", "licence")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS lens, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS agreed,
CASE p_partkey % 4 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN p_size / 4.0 WHEN 2 THEN CAST(p_size AS DOUBLE) END AS number FROM part""")
def lens_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    lens = F.when(k % 2 == 0, F.concat(F.lit("Phone back camera "), n, F.lit("mm f/1.8"))).otherwise(F.concat(F.lit("camera lens "), n, F.lit("mm")))
    size = F.col("p_size").cast("double")
    recorded = F.array(F.lit(0.0), size, F.when(k % 3 == 0, size + 0.0005).otherwise(size + 1))
    text = F.when(k % 4 == 0, F.concat(n, F.lit(".5"))).when(k % 4 == 1, F.concat(n, F.lit("/4"))).when(k % 4 == 2, F.concat(n, F.lit(" mm"))).otherwise(F.concat(n, F.lit("/0")))
    return read(spark, sf_dir, "part").select("p_partkey", tx.focal_from_lens(lens).alias("lens"), tx.resolved_focal(recorded).alias("agreed"), tx.number(text).alias("number"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 MILLISECOND * (o_orderkey % 1000) END AS taken FROM orders""")
def capture_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with fractions of a second; every third is no time."""
    stamp = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    raw = F.when(F.col("o_orderkey") % 3 < 2, stamp).otherwise(F.replace(stamp, F.lit(":"), F.lit("-")))
    return read(spark, sf_dir, "orders").select("o_orderkey", tx.capture_time(raw, F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0")).alias("taken"))


@query("""SELECT c_custkey, '{"a":"' || c_mktsegment || '","b":"' || c_nationkey || '"}' AS record, c_custkey % 2 = 0 AS digest, 'x/' || c_nationkey || '/' || c_mktsegment AS folder, c_custkey % 3 = 0 AS same FROM customer""")
def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    record = tx.canonical_json(F.create_map(F.lit("b"), nation, F.lit("a"), F.col("c_mktsegment")))
    digest = F.when(k % 2 == 0, tx.sha256(k)).otherwise(F.upper(F.concat(F.lit("A"), F.substring(tx.sha256(k), 2, 63))))
    base = lambda n, d: F.struct(F.lit(n).cast("long").alias("num"), F.lit(d).cast("long").alias("den"))
    same = tx.same_time(k * 3, base(1, 90), F.when(k % 3 == 0, k).otherwise(k + 1), base(1, 30))
    return read(spark, sf_dir, "customer").select("c_custkey", record.alias("record"), tx.is_digest(digest).alias("digest"), tx.folder(F.lit("x"), nation, F.col("c_mktsegment")).alias("folder"), same.alias("same"))


@query("""SELECT event_id, event_id % 4 < 2 AS good FROM events""")
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects, nested ones, repeated keys and numbers that are not finite."""
    k = F.col("event_id")
    raw = F.when(k % 4 == 0, '{"a": 1, "b": 2}').when(k % 4 == 1, '{"a": {"a": 1}}').when(k % 4 == 2, '{"x": [{"a": 1, "a": 2}]}').otherwise('{"a": NaN}')
    return read(spark, sf_dir, "events").select("event_id", tx.strict_json(raw).isNotNull().alias("good"))


# --- functions and their inverses ------------------------------------------------------------

_P, _H, _L = tr.PQ, tr.HLG, tr.LOG


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 50.0 AS x, l_discount AS y, l_tax AS z FROM lineitem)
SELECT l_orderkey, l_linenumber, round(pow(greatest(pow(x, {1 / _P['m2']}) - {_P['c1']}, 0) / ({_P['c2']} - {_P['c3']} * pow(x, {1 / _P['m2']})), {1 / _P['m1']}), 6) AS pq,
round(CASE WHEN x <= 0.5 THEN x * x / 3 ELSE (exp((x - {_H['c']}) / {_H['a']}) + {_H['b']}) / 12 END, 6) AS hlg,
CAST(round(greatest(0, least(1, {_L['a']} * log2(x / 2 + {_L['b']}) + {_L['c']})) * 65535) AS INTEGER) AS code16,
round(0.5 * x + 0.25 * y - z, 6) AS mixed, CAST(round(255 * pow((1 / (0.4 + x * 7) - 0.125) / (2.5 - 0.125), 1 / 1.5)) AS INTEGER) AS rank,
round(CASE CAST(l_linenumber AS INTEGER) WHEN 2 THEN 1 - x * 0.5 - 0.25 WHEN 3 THEN 1 - x * 0.5 - 0.25 WHEN 5 THEN y WHEN 6 THEN 1 - y - 0.5 WHEN 7 THEN 1 - y - 0.5 ELSE x * 0.5 END, 6) AS box_x FROM x""")
def inverse_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = F.col("l_quantity") / 50.0, F.col("l_discount"), F.col("l_tax")
    box = tr.oriented(x * 0.5, y, F.lit(0.25), F.lit(0.5), F.col("l_linenumber"))
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(tr.pq_decode(x)).alias("pq"), r6(tr.hlg_decode(x)).alias("hlg"), tr.log_code16(x, F.lit(2.0)).alias("code16"),
        r6(tr.matrix(x, y, z, [[0.5, 0.25, -1.0]])[0]).alias("mixed"), tr.depth_to_rank(0.4 + x * 7, 0.4, 8.0, 1.5).alias("rank"), r6(box[0]).alias("box_x"),
    )


@query("""SELECT p_partkey, round(p_size * 255.0 / 50 * (1 - pow((p_size % 256) / 255.0, 2)), 6) AS disparity, round((1 - pow(least(1, p_retailprice / 1500), 2)) * p_size, 6) AS focus,
round(log2(1 + p_size / 8.0) / 3, 6) AS master, round(1 - log2(1 + p_size / 8.0) / greatest(p_size / 10.0, 3), 6) AS retained, round(greatest(0, 1 - log2(1 + p_size / 8.0) / greatest(p_size / 10.0, 0.01)), 6) AS unconstrained,
CASE p_size % 5 WHEN 2 THEN 1 WHEN 4 THEN 2 END AS stops FROM part""")
def display_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size").cast("double")
    schedule = tr.display_schedule(1 + s / 8.0, s / 10.0)
    return read(spark, sf_dir, "part").select(
        "p_partkey", r6(tr.disparity(F.col("p_size") % 256, s / 50, 2)).alias("disparity"), r6(tr.focus_disparity(F.col("p_retailprice") / 1500 * 255, s, 2)).alias("focus"),
        *(r6(schedule[n]).alias(n) for n in ("master", "retained", "unconstrained")), dc.display_plan(F.col("p_size") % 5).alias("stops"),
    )


@query("""WITH x AS (SELECT p_partkey, p_size + 10.0 AS eq, 1 + (p_size % 4) / 2.0 AS dz, CASE WHEN p_partkey % 2 = 0 THEN 24.0 END AS lens FROM part),
y AS (SELECT *, coalesce(lens, eq / dz) AS opt FROM x), w AS (SELECT *, eq / opt AS ratio, 24.0 / least(eq, 44.9) AS crop FROM y)
SELECT p_partkey, round(opt, 6) AS optical, round(CASE WHEN abs(dz - ratio) <= greatest(0.08, ratio * 0.05) THEN dz ELSE greatest(ratio, 1) END, 6) AS zoom,
CAST(greatest(round(4032 * crop / 4) * 4, 4) AS INTEGER) AS width, round(2800.0 * 4000 / greatest(round(4032 * crop / 4) * 4, 4), 6) AS focal_pixels FROM w""")
def camera_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    eq = F.col("p_size") + 10.0
    lens = tr.optical_zoom(eq, 1 + (F.col("p_size") % 4) / 2.0, F.when(F.col("p_partkey") % 2 == 0, 24.0))
    profile = tr.cropped_profile(eq, F.lit(24.0), F.lit(44.9), F.lit(4032), F.lit(3024), F.lit(4000), F.lit(2800.0))
    return read(spark, sf_dir, "part").select("p_partkey", r6(lens["optical"]).alias("optical"), r6(lens["zoom"]).alias("zoom"), profile["width"].alias("width"), r6(profile["focal_pixels"]).alias("focal_pixels"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS near, l_orderkey % 3 AS scene, l_suppkey % 5 AS roi, l_returnflag = 'A' AS face, l_returnflag = 'N' AS portrait, l_linestatus = 'O' AS pet FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN near AND scene = 0 THEN 'near-object' WHEN near AND scene = 2 AND roi = 3 THEN 'pet-region' WHEN near OR roi = 2 THEN 'center-region' WHEN roi = 1 AND face THEN 'tapped-face' WHEN roi = 1 AND portrait THEN 'portrait-face'
WHEN roi = 3 AND pet THEN 'pet-region' WHEN roi IN (1, 3) OR portrait THEN 'portrait-without-face' ELSE 'disparity-histogram' END AS branch FROM x""")
def focus_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    branch = dc.focus_branch(c("l_linenumber") % 2 == 0, c("l_orderkey") % 3, c("l_suppkey") % 5, c("l_returnflag") == "A", c("l_returnflag") == "N", c("l_linestatus") == "O")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", branch.alias("branch"))


@query("""WITH x AS (SELECT o_orderkey, ['apple', 'samsung', 'huawei', 'honor', 'oppo', 'vivo'][o_orderkey % 6 + 1] AS t, o_orderstatus = 'F' AS heic, o_custkey % 2 = 0 AS box FROM orders),
y AS (SELECT *, t = 'honor' OR t = 'huawei' AND NOT box OR t IN ('oppo', 'vivo') AND heic AS moved FROM x)
SELECT o_orderkey, CASE WHEN moved THEN 'android-standard' ELSE t END AS effective, CASE WHEN moved THEN CASE t WHEN 'honor' THEN 'no native writer' WHEN 'huawei' THEN 'needs an existing motion container' ELSE 'no motion in this still format' END END AS fallback FROM y""")
def target_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = dc.target_plan(_pick(F.col("o_orderkey"), "apple", "samsung", "huawei", "honor", "oppo", "vivo"), F.col("o_orderstatus") == "F", F.col("o_custkey") % 2 == 0)
    return read(spark, sf_dir, "orders").select("o_orderkey", plan["effective"].alias("effective"), plan["fallback"].alias("fallback"))


@query("""SELECT vec_id, CAST(i AS INTEGER) AS place, round(CAST(embedding[i + 1] AS DOUBLE) + 2, 6) AS aperture, round(abs(CAST(embedding[i + 2] AS DOUBLE)), 6) AS blur FROM embeddings, range(0, 20) t(i) WHERE embedding[i + 1] + 2 > 0""")
def blur_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aperture and blur pairs from two arrays, invalid ones left out; places are those before the filter."""
    apertures = F.transform(F.slice("embedding", 1, 20), lambda v: v.cast("double") + 2)
    values = F.transform(F.slice("embedding", 2, 20), lambda v: F.abs(v.cast("double")))
    kept = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(apertures).alias("place", "a"), values.alias("b"))
    pair = dc.blur_curve(F.array("a"), F.slice("b", F.col("place") + 1, F.lit(1)))
    return kept.select("vec_id", "place", pair.alias("p")).where("p is not null").select("vec_id", "place", r6(F.col("p")[0]["aperture"]).alias("aperture"), r6(F.col("p")[0]["value"]).alias("blur"))


# --- headroom --------------------------------------------------------------------------------

_META_SQL = "WITH m AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber % 2 AS DOUBLE) AS cfg, CASE WHEN l_linestatus = 'O' THEN 0.9 ELSE 1.0 END AS normal, l_discount * 20 AS face, l_quantity * 9 AS light, l_extendedprice / 200 AS gain FROM lineitem)"


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = {hr.VERSION: F.lit(3.0), hr.NORMAL: F.when(F.col("l_linestatus") == "O", 0.9).otherwise(1.0), hr.FACE: F.col("l_discount") * 20, hr.HIGHLIGHT: F.col("l_quantity") * 9, hr.GAIN: F.col("l_extendedprice") / 200, hr.CONFIG: (F.col("l_linenumber") % 2).cast("double")}
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(*(at.get(i, F.lit(0.0)) for i in range(36))).alias("meta"))


@query(f"""{_META_SQL}, a AS (SELECT *, greatest(light, 1) AS h, 780.3 / (pow(2, gain * -0.1175 - 6.829) + 1) - 772.3 AS raw FROM m),
b AS (SELECT *, CASE WHEN face > 0 THEN (raw - 1) * CASE WHEN face < 1 THEN face ELSE 1 / face END + 1 ELSE raw END AS f1 FROM a),
c AS (SELECT *, (sqrt(abs(f1)) - 1) * CASE WHEN h >= 320 THEN 1.34 WHEN h >= 200 THEN h * -0.0205 + 7.9 ELSE 3.8 END + 1 AS f2 FROM b),
d AS (SELECT *, CASE WHEN cfg >= 1 THEN (sqrt(abs(f2)) - 1) * 1.3 + 1 ELSE (CASE WHEN face > 0 THEN (sqrt(abs(f2)) - 1) * 1.85 ELSE f2 - 1 END) * CASE WHEN h > 320 THEN 0.8 ELSE 1 END + 1 END AS f3,
log2(gain * 1023 / 65535 * 63 + 1) / h * 100 AS s FROM c),
e AS (SELECT *, greatest(1, least(7.9, CASE WHEN normal <= 0.99 THEN f3 WHEN h <= 210 THEN s * 0.3456 + 1.824 WHEN h > 340 THEN s * 0.1046 + 1.878 ELSE s * 0.5883 + 1.401 END)) AS scale FROM d)
SELECT l_orderkey, l_linenumber, round(scale, 6) AS scale, round(log2(scale), 6) AS alternate, round(1 / pow(1 / scale, 1 / 2.2) - 1, 6) AS headroom_scale, round(CASE WHEN scale > 1 THEN 255 / log2(scale) ELSE 0 END, 4) AS log2_scale, round(CASE WHEN scale > 1 THEN scale ELSE 2 END, 6) AS max_boost FROM e""")
def headroom_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headroom from capture metadata of version 3, the resolved record and the numbers derived from it."""
    df = _meta(spark, sf_dir).withColumn("s", hr.modern_scale(F.col("meta")))
    df = df.withColumn("r", hr.resolved(F.col("meta"), F.lit(False), F.col("s")))
    p = hr.gain_map_parameters(F.col("r.edr_scale"), F.lit(0.0))
    return df.select("l_orderkey", "l_linenumber", r6("r.edr_scale").alias("scale"), r6("r.alternate_headroom").alias("alternate"), r6(p["headroom_scale"]).alias("headroom_scale"), F.round(p["log2_scale"], 4).alias("log2_scale"), r6(p["max_boost"]).alias("max_boost"))


@query("""WITH c AS (SELECT p_partkey, p_size, 1.5005 + p_size / 10.0 AS scale, p_partkey % 256 AS code FROM part), a AS (SELECT *, pow(least(floor(code / 255.0 * 1000), 1000) / 1000.0, 0.625) AS grey, 1 / pow(1 / scale, 1 / 2.2) - 1 AS hs FROM c),
b AS (SELECT *, pow(least(floor(grey * 1000), 1000) / 1000.0, 2.2) AS lin FROM a), d AS (SELECT *, pow(least(floor(lin * 1000), 1000) / 1000.0 * hs + 1, 2.2) AS boost FROM b),
e AS (SELECT *, CASE WHEN boost < 1 THEN 1 ELSE least(floor(least(boost, 8) * 1000), 8000) / 1000.0 END AS x FROM d)
SELECT p_partkey, CASE WHEN x >= scale THEN 255 ELSE CAST(greatest(0, least(255, trunc(255 / log2(scale) * log2(greatest(x, 1))))) AS INTEGER) END AS gain FROM e""")
def gain_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask codes as log gains through truncated tables; the scales lie between the tables' steps, where engines agree."""
    p = hr.gain_map_parameters(1.5005 + F.col("p_size") / 10.0, F.lit(0.0))
    return read(spark, sf_dir, "part").select("p_partkey", hr.gain_code(F.col("p_partkey") % 256, p).alias("gain"))


@query("""WITH x AS (SELECT p_partkey, CAST(pow(2, log2(1.5 + p_size / 10.0)) AS FLOAT) AS top, CAST(1.5 + p_size / 10.0 AS FLOAT) AS s FROM part)
SELECT p_partkey, round(CAST(top AS DOUBLE), 5) AS ratio_max, 3.0::DOUBLE AS units, round(CAST(s AS DOUBLE), 5) AS scale, 20 AS n FROM x""")
def info_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    single = hr.resolved(F.array(*[F.lit(3.0)] * 36), F.lit(False), 1.5 + F.col("p_size") / 10.0)
    v = hr.info_vector(single)
    return read(spark, sf_dir, "part").select("p_partkey", F.round(v[4], 5).alias("ratio_max"), (v[0] + v[3] + v[7]).alias("units"), F.round(v[18], 5).alias("scale"), F.size(v).alias("n"))


@query("""WITH x AS (SELECT p_partkey, 1 + p_size / 50.0 AS base, p_retailprice / 100 AS hdr, p_size / 10.0 AS stops FROM part), y AS (SELECT *, hdr / base AS ratio FROM x)
SELECT p_partkey, round(round(greatest(4, least(10.4, ratio / 0.40126406)) * 65) / 65, 6) AS exposure, round(greatest(0.5, least(2.5, 1.51271843 + 0.15670632 * stops + 0.14766724 * ratio)), 6) AS gain FROM y""")
def linear_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lattice.linear_metadata(1 + F.col("p_size") / 50.0, F.col("p_retailprice") / 100, F.col("p_size") / 10.0)
    return read(spark, sf_dir, "part").select("p_partkey", r6(found["exposure"]).alias("exposure"), r6(found["gain"]).alias("gain"))


# --- lattices and samples --------------------------------------------------------------------

_LONG = "e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))


@query(f"WITH {_LONG} SELECT vec_id, CAST(i % 3 AS INTEGER) AS channel, round(min(v), 6) AS minimum, round(max(v), 6) AS maximum FROM e GROUP BY 1, 2")
def channel_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lattice.channel_range(_samples(spark, sf_dir), ["vec_id"], "i", "v"))


@query(f"""WITH {_LONG}, g AS (SELECT *, v - CASE WHEN i % 30 IN (3, 7, 11) THEN 1 ELSE 0 END AS gap FROM e)
SELECT vec_id, count(*) AS n, round(min(v), 6) AS minimum, round(max(v), 6) AS maximum, round(sqrt(avg(gap * gap)), 6) AS identity_rmse, round(max(abs(gap)), 6) AS identity_max FROM g GROUP BY 1""")
def payload_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lattice.payload_facts(_samples(spark, sf_dir), ["vec_id"], "i", "v"))


@query(f"""WITH {_LONG}, c AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v, v * v - v AS d FROM e WHERE (i // 8 + i % 8) % 5 <> 0),
t AS (SELECT a.vec_id, avg(abs(a.v - b.v)) AS variation FROM c a JOIN c b ON a.vec_id = b.vec_id AND (a.y = b.y AND a.x = b.x - 1 OR a.x = b.x AND a.y = b.y - 1) GROUP BY 1)
SELECT vec_id, round(sqrt(avg(v * v)), 6) AS residual_rms, round(max(abs(v)), 6) AS residual_max, round(sqrt(avg(d * d)), 6) AS disagreement_rms, round(quantile_cont(abs(v), 0.99), 6) AS residual_p99, round(any_value(variation), 6) AS variation FROM c JOIN t USING (vec_id) GROUP BY 1""")
def gate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of 8 x 8 grids in which every fifth diagonal is masked out."""
    cells = _samples(spark, sf_dir).select("vec_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("long").alias("x"), F.lit(0).alias("place"), F.col("v").alias("residual"), (F.col("v") * F.col("v") - F.col("v")).alias("disagreement"))
    return rounded(lattice.gate_scores(cells.where((F.col("y") + F.col("x")) % 5 != 0), ["vec_id"]))


@query(f"""WITH {_LONG}, m AS (SELECT vec_id, i, v > 0 AS here, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY i) AS r FROM e)
SELECT vec_id, CAST(i AS INTEGER) AS i, CASE WHEN here THEN (r * 2 - 1) * 0.5 ELSE 0 END::DOUBLE AS value FROM m""")
def sparse_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th positive sample's place takes the packed number 2 k, less 1 and halved."""
    mask = _samples(spark, sf_dir).select("vec_id", "i", (F.col("v") > 0).alias("on"))
    packed = read(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(1).cast("long"), F.size("embedding").cast("long"))).alias("rank")).withColumn("packed", F.col("rank") * 2.0)
    return lattice.scattered(mask, packed, ["vec_id"], "i", F.lit(0.5), F.lit(1.0)).select("vec_id", "i", "value")


@query("""SELECT vec_id, true AS same, len(embedding) = 64 AS sized FROM embeddings""")
def lattice_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers packed as a lattice of half floats and unpacked again; arrays of another size give null."""
    values = F.transform(F.sequence(F.lit(0), F.lit(lattice._SLOTS - 1)), lambda i: ((i + F.col("vec_id")) % 2048).cast("float"))
    wide = F.col("vec_id") % 2 == 0
    df = read(small_batches(spark), sf_dir, "embeddings").select("vec_id", "embedding", values.alias("values"))
    back = lattice.unpack_lattice(lattice.pack_lattice(F.col("values"), wide), wide)
    return df.select("vec_id", (back == F.col("values")).alias("same"), (lattice.pack_lattice(F.col("embedding"), wide).isNull() & (F.size("embedding") == 64)).alias("sized"))


@query(f"""WITH {_LONG}, g AS (SELECT a AS cell, least(3, greatest(0, (a // 8 + 0.5) / 2 - 0.5)) AS fy, least(3, greatest(0, (a % 8 + 0.5) / 2 - 0.5)) AS fx FROM range(64) t(a)),
h AS (SELECT cell, fy, fx, least(2, floor(fy)) AS y0, least(2, floor(fx)) AS x0 FROM g), k AS (SELECT cell, dy, dx, (CASE WHEN dy = 0 THEN 1 - (fy - y0) ELSE fy - y0 END) * (CASE WHEN dx = 0 THEN 1 - (fx - x0) ELSE fx - x0 END) AS w, CAST((y0 + dy) * 4 + x0 + dx AS BIGINT) AS pos FROM h, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dy, dx)),
c AS (SELECT vec_id, cell, sum(w * ((vec_id * 7 + pos * 13) % 256)) AS code FROM embeddings, k GROUP BY 1, 2)
SELECT vec_id, CAST(cell AS INTEGER) AS cell, round((v + 0.015625) * pow(2, 0.8 * (-1 + code / 255 * 3)) - 0.015625, 6) AS value FROM c JOIN (SELECT vec_id, i AS cell, v FROM e) USING (vec_id, cell)""")
def gain_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 samples under a 4 x 4 gain map."""
    codes = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: ((F.col("vec_id") * 7 + i * 13) % 256).cast("int"))
    apply = raster.gain_raster(8, 8, 4, 4, 1.0, -1.0, 2.0, 0.8, 1 / 64, 1 / 64)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(apply(F.col("embedding"), codes)).alias("cell", "value")).withColumn("value", r6("value"))


# --- order and sets --------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred dearest orders, ties by key: a top-k report."""
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SELECT o_custkey AS k FROM orders UNION SELECT l_suppkey FROM lineitem")
def key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of two tables in order, each once."""
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).union(read(spark, sf_dir, "lineitem").select("l_suppkey")).distinct().orderBy("k")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def unexpected_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey").exceptAll(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct())


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 3 END AS place FROM events")
def total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of -0.0, 0.0, -1.0 and NaN in the complete order of doubles."""
    name = lambda text: F.lit(float(text))
    x = F.when(F.col("event_id") % 4 == 0, name("-0.0")).when(F.col("event_id") % 4 == 1, name("0.0")).when(F.col("event_id") % 4 == 2, name("-1.0")).otherwise(name("nan"))
    order = F.array_sort(F.array(*(tx.total_order(name(v)) for v in ("0.0", "nan", "-1.0", "-0.0"))))
    here = F.transform(order, lambda v: v["nan"].cast("string").eqNullSafe(tx.total_order(x)["nan"].cast("string")) & (v["value"].cast("string") == x.cast("string")))
    return read(spark, sf_dir, "events").select("event_id", (F.array_position(here, F.lit(True)) - 1).cast("int").alias("place"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part UNION ALL SELECT p_partkey, p_partkey // 2 FROM part), n AS (SELECT max(p_partkey) AS top FROM part)
SELECT CAST(i AS BIGINT) AS node FROM range(0, (SELECT top + 2 FROM n)) t(i)""")
def deep_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything is reachable from the middle: up by one at a time, down by halves, round in cycles."""
    keys = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"))
    edges = keys.select("a", (F.col("a") + 1).alias("b")).unionByName(keys.select("a", F.floor(F.col("a") / 2).alias("b")))
    top = keys.agg(F.max("a").alias("top"))
    return graphs.closure(edges, top.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("top"), F.lit(40).cast("long"))).alias("node"))).select("node")
