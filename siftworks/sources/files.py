"""Files as rows: directory scans, candidate predicates, format sniffing and byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftworks.functions.text import extension, stem

# Extensions of still and video candidates, and brands of still images.
STILLS = ("heic", "heif", "jpg", "jpeg")
VIDEOS = ("mov", "mp4", "m4v", "avi", "mkv")
HEIC_BRANDS = ("heic", "heix", "hevc", "hevx")


def scan(spark: SparkSession, roots: list[str], recursive: bool = True, video: bool = False) -> DataFrame:
    """binaryFile rows of candidates below the roots: no dot-files, no own outputs, each path once.

    Repeated roots, and roots below others, are left out before the scan, so that no content is
    shuffled to find repeated paths.
    """
    top = sorted({r.rstrip("/") for r in roots})
    if recursive:
        top = [r for r in top if not any(r.startswith(f"{o}/") for o in top)]
    any_case = "{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in (VIDEOS if video else STILLS)) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", f"*.{any_case}").load(top)
    return files.where(is_candidate(F.col("path"), video) & ~is_hidden(F.col("path")))


def is_candidate(path: Column, video: bool = False) -> Column:
    return extension(path).isin(*(VIDEOS if video else STILLS))


def is_hidden(path: Column) -> Column:
    return path.rlike(r"/\.[^/]+(?:/|$)|\.pvt/")


def is_generated(path: Column, marker: str) -> Column:
    """The stem ends in '.marker', with an optional ' (N)' and 'MP'."""
    return stem(path).rlike(rf"\.{marker}( \(\d+\))?(MP)?$")


def still_encoding(content: Column) -> Column:
    """'jpeg' for FFD8, 'heic' for an ftyp box with a HEIC brand inside that box, else null.

    Brands are found by one pass over the box's hex digits, eight to a brand.
    """
    head = F.hex(F.substring(content, 1, 4))
    size = F.conv(head, 16, 10).cast("long")
    brands = F.hex(F.substr(content, F.lit(9), F.greatest(F.lit(0), F.least(size, F.length(content)) - 8).cast("int")))
    any_brand = "|".join(b.encode().hex().upper() for b in HEIC_BRANDS)
    is_ftyp = F.substring(content, 5, 4).cast("string") == "ftyp"
    return F.when(F.substring(head, 1, 4) == "FFD8", "jpeg").when(is_ftyp & brands.rlike(f"^(?:.{{8}})*?(?:{any_brand})"), "heic")


def byte_range(content: Column, offset: Column, length: Column, most: int) -> Column:
    """Bytes [offset, offset + length); null where they are more than most or lie outside."""
    return F.when((length <= most) & (offset >= 0) & (offset + length <= F.length(content)), F.substr(content, (offset + 1).cast("int"), length.cast("int")))


def blocks(content: Column, entries: Column) -> Column:
    """name -> bytes of the entries array<struct<name,offset,length>> that lie inside the content; of one name the last."""
    inside = F.filter(entries, lambda x: (x["offset"] >= 0) & (x["length"] >= 0) & (x["offset"] + x["length"] <= F.length(content)))
    last = F.filter(inside, lambda x, i: ~F.exists(F.slice(inside, i + 2, F.size(inside)), lambda y: y["name"] == x["name"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["name"], F.substr(content, (x["offset"] + 1).cast("int"), x["length"].cast("int")))))


def signature(content: Column) -> Column:
    """struct<size, sha256> of a file's bytes."""
    return F.struct(F.length(content).cast("long").alias("size"), F.sha2(content, 256).alias("sha256"))


def manifest(tail: Column) -> Column:
    """Entries of the last JSON array of {name, offset, length} in a text, by offset from the end, then order."""
    raw = F.regexp_extract(tail, r"(?s).*(\[\{.*?\])", 1)
    rows = F.from_json(raw, "array<struct<name:string,offset:bigint,length:bigint>>")
    used = F.filter(rows, lambda x: x["offset"].isNotNull() & x["length"].isNotNull())
    return F.array_sort(F.transform(used, lambda x, i: F.struct((-x["offset"]).alias("start"), i.alias("order"), x["name"].alias("name"), x["length"].alias("length"))))


def write_new(df: DataFrame, path: str, existing: DataFrame | None, keys: list[str]) -> None:
    """Append the rows whose key is not there yet; readers see a committed write or none."""
    fresh = df if existing is None else df.join(existing.select(*keys).distinct(), keys, "left_anti")
    fresh.dropDuplicates(keys).write.mode("append").parquet(path)
