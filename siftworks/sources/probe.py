"""Probing containers by byte ranges: a data source of heads and tails, ranges on request, tagged rows.

A file of gigabytes is told by a few kilobytes.  ``heads_and_tails`` lists folders in tasks and reads
the head and the tail of each file and the headers of its top-level boxes, by seeks; ``ByteRanges`` does
so as a data source, whose partitions the driver plans, for as many files as it can hold;
``with_ranges`` then reads the byte ranges that a column asks for.  What they find is judged in
column expressions: ``probe`` gives one tagged row a file, also for those that are no container,
and ``extract`` the metadata and the mask of those that are.

Files are reached through pyarrow's file systems (local, hdfs, s3, gs).  A path of another scheme
gives an error row; such files can be read whole with Spark's binaryFile source.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import pandas_udf

from siftworks.operators.lineage import scratch_folder

HEAD, TAIL = 64 << 10, 64 << 10
FILES = 256  # files of a partition, at most
INSPECTION_VERSION = 1

# Names of a manifest's blocks, and the metadata that stands for a missing one.
LOCAL_META, LOCAL_MASK = "local.hdr.meta.data", "local.hdr.linear.mask"
ULTRA_INFO, ULTRA_DATA = "local.uhdr.gainmap.info", "local.uhdr.gainmap.data"
ULTRA_DEFAULT = (1.0, 1.0, 1.0, 1.0, 4.926, 4.926, 4.926, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 4.926, 4.926, 0.0)
ULTRA_POSITIVE = (0, 4, 7, 16, 17)  # places that are above zero in a sound one
LOCAL_FLOATS, ULTRA_FLOATS = 36, 20

_ERRORS = (OSError, ValueError, pa.ArrowException)


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


_ENDS = "path string, size long, head binary, tail binary, boxes array<struct<kind:string,start:long,length:long>>, bytes_read long, error string"
_ENDS_ARROW = pa.schema([
    ("path", pa.string()), ("size", pa.int64()), ("head", pa.binary()), ("tail", pa.binary()),
    ("boxes", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))), ("bytes_read", pa.int64()), ("error", pa.string()),
])


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, str | None]]):
        self.files = files


def _boxes(file: pa.NativeFile, size: int) -> tuple[list[dict], int]:
    """Top-level boxes, reading 16 bytes of each; a box that ends outside the file is the last, as it stands."""
    found, at, read = [], 0, 0
    while at + 8 <= size:
        file.seek(at)
        raw = file.read(16)
        read += len(raw)
        length, kind = struct.unpack(">I4s", raw[:8])
        if length == 1 and len(raw) == 16:
            length = struct.unpack(">Q", raw[8:])[0]
        length = size - at if length == 0 else length
        if length < 8:
            break
        found.append({"kind": kind.decode("latin-1"), "start": at, "length": length})
        at += length
    return found, read


def _ends(path: str, size: int, error: str | None, most_head: int, most_tail: int) -> tuple:
    """A row of _ENDS for one file."""
    if error:
        return path, size, None, None, None, 0, error
    try:
        system, inner = _file_system(path)
        with system.open_input_file(inner) as file:
            if size <= most_head + most_tail:
                whole = file.read(size)
                head, tail, read = whole[:most_head], whole[max(0, size - most_tail) :], len(whole)
            else:
                head = file.read(most_head)
                file.seek(size - most_tail)
                tail = file.read(most_tail)
                read = len(head) + len(tail)
            boxes, more = _boxes(file, size) if head[4:8] == b"ftyp" else ([], 0)
        return path, size, head, tail, boxes, read + more, None
    except _ERRORS as failed:
        return path, size, None, None, None, 0, f"not read: {type(failed).__name__}"


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.head, self.tail = int(options.get("head", HEAD)), int(options.get("tail", TAIL))

    def partitions(self) -> list[InputPartition]:
        """Files by falling size, dealt so that a partition has as many bytes to read as another, and FILES at most."""
        files: dict[str, tuple[str, int, str | None]] = {}
        for root in self.paths:
            try:
                system, path = _file_system(root)
                info = system.get_file_info(path)
                if info.type == pafs.FileType.NotFound:
                    files[root] = (root, 0, "not found")
                    continue
                each = [info] if info.is_file else system.get_file_info(pafs.FileSelector(path, recursive=True))
                prefix = root[: len(root) - len(path)] if root.endswith(path) else root.partition("://")[0] + "://" if "://" in root else ""
                for i in each:
                    if i.is_file and not i.base_name.startswith((".", "_")):
                        files[prefix + i.path] = (prefix + i.path, i.size, None)
            except _ERRORS as error:
                files[root] = (root, 0, f"not listed: {type(error).__name__}")
        each = sorted(files.values(), key=lambda f: (-f[1], f[0]))
        n = max(1, -(-len(each) // FILES))
        return [_Files(each[i::n]) for i in range(n)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path, size, error in partition.files:
            yield _ends(path, size, error, self.head, self.tail)


class ByteRanges(DataSource):
    """spark.read.format("byte_ranges").option("paths", json list of files and folders): one row a file."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return _ENDS

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def _inside(root: str) -> Iterator[tuple[str, int, bool, str | None]]:
    """(path, size, is a folder, error) of what stands in a folder, or of a file; a local folder is never held whole."""
    try:
        system, path = _file_system(root)
        info = system.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            yield root, 0, False, "not found"
        elif info.is_file:
            yield root, info.size, False, None
        else:
            prefix = root[: len(root) - len(path)] if root.endswith(path) else root.partition("://")[0] + "://" if "://" in root else ""
            if isinstance(system, pafs.LocalFileSystem):
                with os.scandir(path) as entries:
                    each = ((e.path, e.name, e.stat().st_size if e.is_file() else 0, e.is_file(), e.is_dir()) for e in entries)
                    for at, name, size, is_file, is_folder in each:
                        if is_folder or is_file and not name.startswith((".", "_")):
                            yield prefix + at, size, is_folder, None
            else:
                for i in system.get_file_info(pafs.FileSelector(path)):
                    if not i.is_file or not i.base_name.startswith((".", "_")):
                        yield prefix + i.path, i.size or 0, not i.is_file, None
    except _ERRORS as error:
        yield root, 0, False, f"not listed: {type(error).__name__}"


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("is_folder", pa.bool_()), ("error", pa.string())])
    for batch in batches:
        found = (row for root in batch.column(0).to_pylist() for row in _inside(root))
        while some := list(itertools.islice(found, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, size, error) of the files below paths, each once; hidden files are left out.

    Folders are listed in tasks, level by level, and what they hold stays in tables: the driver holds
    the paths that it is given and nothing that it finds.
    """
    folders, levels = spark.createDataFrame([(p,) for p in paths], "path string"), []
    while True:
        levels.append(scratch_folder(spark))
        folders.mapInArrow(_list, "path string, size long, is_folder boolean, error string").write.parquet(levels[-1])
        below = spark.read.parquet(levels[-1]).where("is_folder").select("path").distinct()
        n = below.count()
        if not n:
            return spark.read.parquet(*levels).where("not is_folder").groupBy("path").agg(F.min("size").alias("size"), F.min("error").alias("error"))
        folders = below.repartition(min(n, 4 * spark.sparkContext.defaultParallelism), "path")


def heads_and_tails(spark: SparkSession, paths: list[str], head: int = HEAD, tail: int = TAIL) -> DataFrame:
    """What the data source gives, with the listing done now, and in tasks: for folders of any number of files."""
    folder = scratch_folder(spark)
    listed(spark, paths).write.parquet(folder)
    files = spark.read.parquet(folder)
    n = files.count()
    tasks = max(1, -(-n // (8 * FILES)), min(spark.sparkContext.defaultParallelism, -(-n // FILES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            held, size = [], 0
            for row in (_ends(*f, head, tail) for f in each):
                held.append(row)
                size += len(row[2] or b"") + len(row[3] or b"")
                if size >= 4 << 20:
                    yield _rows(held)
                    held, size = [], 0
            if held:
                yield _rows(held)

    return files.repartition(tasks, "path").mapInArrow(run, _ENDS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ENDS_ARROW.types, strict=True)], schema=_ENDS_ARROW)


def with_ranges(df: DataFrame, ranges: str, name: str = "parts") -> DataFrame:
    """df (path, size, bytes_read, ...) with name: map of the ranges array<struct<name,start,length>> that lie in the file.

    Ranges that do not lie in the file, or cannot be read, are missing from the map.  bytes_read grows.
    """
    kept = [c for c in df.columns if c != ranges]
    at = {c: i for i, c in enumerate(df.columns)}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != ranges) + f", {name} map<string,binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, read = [], []
            for path, size, wanted, before in zip(*(batch.column(at[c]).to_pylist() for c in ("path", "size", ranges, "bytes_read")), strict=True):
                got = []
                if wanted := [w for w in wanted or [] if w["start"] is not None and w["start"] >= 0 and (w["length"] or 0) > 0 and w["start"] + w["length"] <= size]:
                    try:
                        system, inner = _file_system(path)
                        with system.open_input_file(inner) as file:
                            for w in wanted:
                                file.seek(w["start"])
                                got.append((w["name"], file.read(w["length"])))
                    except _ERRORS:
                        pass
                out.append(dict(got))
                read.append((before or 0) + sum(len(b) for _, b in got))
            parts = pa.array([list(x.items()) for x in out], pa.map_(pa.string(), pa.binary()))
            columns = [pa.array(read, pa.int64()) if c == "bytes_read" else batch.column(at[c]) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, parts], names=[*kept, name])

    return df.mapInArrow(run, schema)


def floats(n: int):
    """A function of a binary column: its first n little-endian 32-bit floats, null if it is shorter."""

    @pandas_udf("array<double>")
    def unpack(raw):
        return raw.map(lambda b: np.frombuffer(b, "<f4", n).astype(float).tolist() if b is not None and len(b) >= 4 * n else None)

    return unpack


def _latin(raw: Column) -> Column:
    """Bytes as text, a character each."""
    return F.decode(raw, "ISO-8859-1")


def _last(text: Column, mark: str) -> Column:
    """Place of the last mark, from 0; -1 if there is none."""
    back = F.instr(F.reverse(text), mark[::-1])
    return F.when(back > 0, F.length(text) - back + 1 - len(mark)).otherwise(F.lit(-1)).cast("long")


def _little(raw: Column) -> Column:
    """Four bytes as an unsigned little-endian number."""
    return F.conv(F.concat(*(F.substring(F.hex(raw), 2 * i - 1, 2) for i in (4, 3, 2, 1))), 16, 10).cast("long")


_ENTRY = "name string, offset double, length double"


def located(read: DataFrame) -> DataFrame:
    """heads_and_tails() with json_start, entries (name, offset, start, length, in file order), extension_start and why.

    The manifest is the last JSON array of objects in the tail.  It counts if a marker box, or a
    footer with the right length, vouches for it; why says what is missing.
    """
    tail, head = _latin(F.col("tail")), _latin(F.col("head"))
    start = _last(tail, "[{")
    text = F.when(start >= 0, F.regexp_extract(F.substr(tail, (start + 1).cast("int")), r"(?s)^(\[\{[^\]]*\])", 1))
    each = F.from_json(F.decode(F.encode(F.col("_json"), "ISO-8859-1"), "UTF-8"), "array<string>")
    parsed = F.transform(each, lambda e: F.from_json(e, _ENTRY))  # one by one: an entry that is no object is left out alone
    whole = lambda c: c.cast("long")
    used = F.filter(parsed, lambda e: (F.abs(e["offset"]) < 2.0**62) & (F.abs(e["length"]) < 2.0**62))
    entries = F.array_sort(F.transform(used, lambda e, i: F.struct((whole(e["offset"]) - whole(e["length"])).alias("start"), i.alias("place"), F.coalesce(e["name"], F.lit("")).alias("name"), whole(e["offset"]).alias("offset"), whole(e["length"]).alias("length"))))
    box = F.get(F.filter("boxes", lambda b: b["kind"] == "QTI "), F.lit(0))
    boxed = F.when(F.size("boxes") > 0, box["start"] + box["length"])
    at = F.instr(head, "QTI ")
    size = F.conv(F.hex(F.substr(F.col("head"), at - 4, F.lit(4))), 16, 10).cast("long")
    marked = F.when((at > 4) & (size >= 8) & (at - 5 + size <= F.col("size")), at - 5 + size)
    footer = F.col("tail").isNotNull() & (F.hex(F.substr(F.col("tail"), F.length("tail") - 8, F.lit(5))) == F.lit(b"\0jxrs".hex().upper()))
    out = read.withColumn("_json", text).withColumn("json_start", F.when(start >= 0, F.col("size") - F.length("tail") + start)).withColumn("entries", entries)
    out = out.withColumn("_vouched", footer & (_little(F.substr(F.col("tail"), F.length("tail") - 3, F.lit(4))) == F.col("size") - F.col("json_start")))
    out = out.withColumn("_marked", F.coalesce(F.when(boxed <= F.col("size"), boxed), marked))
    nearest = F.array_min(F.filter(F.transform("entries", lambda e: F.col("json_start") - e["offset"]), lambda x: x >= 0))
    why = F.when(F.col("error").isNotNull(), "io").when(F.col("json_start").isNull() | F.col("entries").isNull(), "no manifest").when(F.col("_marked").isNull() & ~F.coalesce("_vouched", F.lit(False)), "no marker")
    return out.withColumn("extension_start", F.coalesce("_marked", nearest, "json_start")).withColumn("why", why).drop("_json", "_vouched", "_marked")


def _video(head: Column) -> tuple[Column, Column, Column]:
    """What the XMP of a still says of a video behind it: source kind, length, presentation time in microseconds."""
    text = _latin(head)
    number = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("long")
    legacy = number(r"""MicroVideoOffset\s*=\s*["'](\d{1,18})["']""")
    item = F.regexp_extract(text, r"""(?s)(<[^<>]*Item:Semantic\s*=\s*["']MotionPhoto["'][^<>]*>)""", 1)
    modern = F.nullif(F.regexp_extract(item, r"""Item:Length\s*=\s*["'](\d{1,18})["']""", 1), F.lit("")).cast("long")
    time = number(r"""(?:MotionPhoto|MicroVideo)PresentationTimestampUs\s*=\s*["'](\d{1,18})["']""")
    return F.when(modern.isNotNull(), "motionPhoto").when(legacy.isNotNull(), "legacyMicroVideo"), F.coalesce(modern, legacy), time


def _sound(x: Column) -> Column:
    """Score of 36 floats as local metadata; six or more count."""
    # Place, value and points.
    near = ((2, 144.0, 5), (5, -1.0, 3), (18, 10.0, 2), (19, 6.0, 2))
    points = sum((F.when(F.abs(x[i] - v) < 0.01, p).otherwise(0) for i, v, p in near), F.lit(0))
    return points + F.when(x[0].between(2.0, 5.0), 2).otherwise(0) + F.when(x[29].between(0.0, 2000.0), 1).otherwise(0)


def probe(read: DataFrame) -> DataFrame:
    """heads_and_tails() -> one tagged row a file.

    kind is motion-photo, pro-xdr or error.  An error has a stage (io, motion-photo, unsupported) and
    a reason.  A still that names no video falls through to the manifest; one that names a video which
    is not there does not, it is an error of its own.
    """
    source, length, time = _video(F.col("head"))
    asked = located(read).withColumns({"source_kind": source, "video_length": length, "presentation_us": time})
    entry = lambda name: F.get(F.filter("entries", lambda e: e["name"] == name), F.lit(0))
    ask = lambda name, start, size: F.struct(F.lit(name).alias("name"), start.alias("start"), size.cast("long").alias("length"))
    local, ultra, mask, data = entry(LOCAL_META), entry(ULTRA_INFO), entry(LOCAL_MASK), entry(ULTRA_DATA)
    before, after = lambda e: F.col("json_start") - e["offset"], lambda e: F.col("extension_start") + e["start"]
    want = [
        ask("video", F.col("size") - F.col("video_length") + 4, F.lit(4)),
        *(ask(f"meta{i}", s, F.when(local["length"] >= 4 * LOCAL_FLOATS, 4 * LOCAL_FLOATS)) for i, s in enumerate((before(local), F.col("extension_start") + local["offset"], after(local)))),
        *(ask(f"mask{i}", s, F.when(s + mask["length"] <= F.col("size"), 2)) for i, s in enumerate((after(mask), before(mask), F.col("extension_start") + mask["offset"]))),
        *(ask(f"info{i}", s, F.when(ultra["length"] >= 4 * ULTRA_FLOATS, 4 * ULTRA_FLOATS)) for i, s in enumerate((before(ultra), after(ultra)))),
    ]
    got = with_ranges(asked.withColumn("_want", F.when(F.col("error").isNull(), F.array(*want))), "_want")
    part = lambda name: F.col("parts")[name]
    got = got.withColumns({f"_m{i}": floats(LOCAL_FLOATS)(part(f"meta{i}")) for i in range(3)}).withColumn("_u", floats(ULTRA_FLOATS)(F.coalesce(part("info0"), part("info1"))))
    meta = F.coalesce(*(F.when(_sound(F.col(f"_m{i}")) >= 6, F.col(f"_m{i}")) for i in range(3)))
    told = lambda x: ~F.exists(x, F.isnan) & F.exists(x, lambda v: v != 0) & ~F.exists(x, lambda v: F.abs(v) == float("inf")) & F.least(*(x[i] for i in ULTRA_POSITIVE)).__gt__(0)
    is_ultra = ultra.isNotNull() & data.isNotNull()
    whole = F.coalesce(F.when((before(data) >= 0) & (before(data) + data["length"] <= F.col("size")), before(data)), F.when(after(data) >= 0, after(data)))
    inside = whole.isNotNull() & (data["length"] >= 0) & (whole + data["length"] <= F.col("size"))
    starts = F.array(*(F.when(F.hex(F.substring(part(f"mask{i}"), 1, 2)) == "FFD8", s) for i, s in enumerate((after(mask), before(mask), F.col("extension_start") + mask["offset"]))))
    mask_start = F.get(F.filter(starts, lambda s: s.isNotNull()), F.lit(0))
    got = got.withColumns({
        "_floats": F.when(is_ultra, F.when(told(F.col("_u")), F.col("_u")).otherwise(F.array(*map(F.lit, ULTRA_DEFAULT)))).otherwise(meta),
        "_payload": F.when(is_ultra, F.when(inside, F.struct(whole.alias("start"), data["length"].alias("length")))).otherwise(F.when(mask_start.isNotNull(), F.struct(mask_start.alias("start"), mask["length"].alias("length")))),
        "_video": F.col("size") - F.col("video_length"),
    })
    photo = F.col("video_length").isNotNull()
    sound_photo = photo & (F.col("_video") > 0) & F.coalesce(part("video").cast("string") == "ftyp", F.lit(False))
    reason = (
        F.when(F.col("why") == "io", F.col("error")).when(photo & ~sound_photo, "the video is not where the still says").when(photo, None).when(F.col("why").isNotNull(), F.col("why"))
        .when(F.col("_floats").isNull(), "no metadata").when(F.col("_payload").isNull(), F.when(is_ultra, "data outside the file").otherwise("no mask"))
    )
    stage = F.when(reason.isNull(), None).when(F.col("why") == "io", "io").when(photo, "motion-photo").otherwise("unsupported")
    kind = F.when(reason.isNotNull(), "error").when(photo, "motion-photo").otherwise("pro-xdr")
    tagged = got.withColumns({"kind": kind, "stage": stage, "reason": reason})
    is_kind = lambda k, c: F.when(F.col("kind") == k, c)
    span = lambda start, length: F.struct(start.cast("long").alias("offset"), length.cast("long").alias("length"))
    return tagged.select(
        F.lit(INSPECTION_VERSION).alias("schema_version"), "path", "size", "kind", "stage", "reason",
        is_kind("motion-photo", F.col("source_kind")).alias("source_kind"), is_kind("motion-photo", span(F.lit(0), F.col("_video"))).alias("still"), is_kind("motion-photo", span(F.col("_video"), F.col("video_length"))).alias("video"),
        is_kind("motion-photo", F.col("presentation_us")).alias("presentation_us"), is_kind("pro-xdr", F.when(is_ultra, "uhdr").otherwise("lhdr")).alias("hdr_mode"), is_kind("pro-xdr", F.col("_floats")).alias("metadata"),
        is_kind("pro-xdr", span(F.col("_payload")["start"], F.col("_payload")["length"])).alias("gain_map"), is_kind("pro-xdr", F.size("entries")).alias("manifest_entries"), is_kind("pro-xdr", ~is_ultra).alias("has_local_info"), "bytes_read",
    )


def inspect(spark: SparkSession, paths: list[str]) -> DataFrame:
    return probe(heads_and_tails(spark, paths))


def extract(probed: DataFrame) -> DataFrame:
    """The containers among probe()'s rows, with the bytes of their gain map; nothing else of the files is read."""
    asked = probed.where("kind = 'pro-xdr'").withColumn("_want", F.array(F.struct(F.lit("gain_map").alias("name"), F.col("gain_map")["offset"].alias("start"), F.col("gain_map")["length"].alias("length"))))
    got = with_ranges(asked, "_want")
    return got.select("path", "hdr_mode", "metadata", F.coalesce(F.col("parts")["gain_map"], F.lit(b"")).alias("gain_map_bytes"), "bytes_read")


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """df (name, content) as files of a folder, each moved to its name when whole; -> path, size.

    A repeated task writes the same file again.  A name may lead through folders.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = f"{root}/.{uuid.uuid4().hex}"
                if "/" in name:
                    system.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(part) as out:
                    out.write(content or b"")
                system.move(part, f"{root}/{name}")
                paths.append(f"{folder}/{name}")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "size"])

    return df.select("name", "content").mapInArrow(run, "path string, size long")
