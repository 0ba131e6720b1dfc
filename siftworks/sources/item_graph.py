"""The item graph of a HEIF file as tables, and the rules of a gain map as joins.

One walk over a file gives its facts: items, references, properties, associations, locations, the
primary item.  Whether they hang together - what a reference, an association or a place points to
is there - and whether they form a gain map are joins and aggregations over those facts of all
files together.  Each broken rule is a row (path, rule, item); a file that breaks none has one row
of structure.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftworks.sources.media import _rows, _unsigned, hevc_profile

_KEPT = 4096  # bytes of a property that are kept


class _Reader:
    """Fields of a box, one after the other; a field beyond its end is an error."""

    def __init__(self, data: bytes, at: int, end: int):
        self.data, self.at, self.end = data, at, min(end, len(data))

    def take(self, n: int) -> bytes:
        if self.at + n > self.end:
            raise struct.error("beyond the box")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def boxes(self) -> Iterator[tuple[str, "_Reader"]]:
        while self.at + 8 <= self.end:
            start, size, kind = self.at, self.number(4), self.take(4).decode("latin-1")
            size = self.number(8) if size == 1 else size or self.end - start
            if start + size > self.end or size < self.at - start:
                raise struct.error("a box ends outside its parent")
            yield kind, _Reader(self.data, self.at, start + size)
            self.at = start + size


def _facts(data: bytes) -> Iterator[dict]:
    try:
        top = list(_Reader(data, 0, len(data)).boxes())
        metas = [r for kind, r in top if kind == "meta"]
        if len(metas) != 1 or sum(kind == "ftyp" for kind, _ in top) != 1:
            yield {"fact": "broken", "kind": "not one ftyp and meta"}
            return
        metas[0].take(4)
        parts = list(metas[0].boxes())
        idat = next(((r.at, r.end) for kind, r in parts if kind == "idat"), None)
        for kind, r in parts:
            if kind == "pitm":
                wide = r.number(4) >> 24
                yield {"fact": "primary", "item": r.number(4 if wide else 2)}
            elif kind == "iinf":
                r.take(4 if r.number(4) >> 24 else 2)
                for one, e in r.boxes():
                    version = e.number(4) >> 24
                    if one == "infe" and version >= 2:
                        item = e.number(4 if version > 2 else 2)
                        e.take(2)
                        yield {"fact": "item", "item": item, "kind": e.take(4).decode("latin-1")}
            elif kind == "iref":
                width = 4 if r.number(4) >> 24 else 2
                for i, (one, e) in enumerate(r.boxes()):
                    item = e.number(width)
                    for k in range(e.number(2)):
                        yield {"fact": "reference", "item": item, "kind": one, "ordinal": k, "other": e.number(width), "start": i}
            elif kind == "iprp":
                for one, e in r.boxes():
                    if one == "ipco":
                        for i, (name, body) in enumerate(e.boxes()):
                            yield {"fact": "property", "ordinal": i + 1, "kind": name, "payload": data[body.at : min(body.end, body.at + _KEPT)]}
                    elif one == "ipma":
                        flags = e.number(4)
                        for _ in range(e.number(4)):
                            item = e.number(4 if flags >> 24 else 2)
                            for k in range(e.number(1)):
                                index = e.number(2) & 0x7FFF if flags & 1 else e.number(1) & 0x7F
                                if index:
                                    yield {"fact": "association", "item": item, "ordinal": k, "other": index}
            elif kind == "iloc":
                version = r.number(4) >> 24
                sizes = r.number(2)
                width, long, base_size, index_size = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0
                for _ in range(r.number(4 if version == 2 else 2)):
                    item = r.number(4 if version == 2 else 2)
                    inside = version > 0 and r.number(2) & 15 == 1
                    r.take(2)
                    base = r.number(base_size)
                    for k in range(r.number(2)):
                        r.take(index_size)
                        start, length = base + r.number(width), r.number(long)
                        start, end = (idat[0] + start, idat[1]) if inside and idat else (start, len(data))
                        fits = start + length <= end and not (inside and idat is None)
                        yield {"fact": "location", "item": item, "ordinal": k, "start": start, "length": length, "other": int(fits), "payload": data[start : start + length] if fits and length <= 64 else None}
    except struct.error as error:
        yield {"fact": "broken", "kind": str(error)}


_FIELDS = {"fact": pa.string(), "item": pa.int64(), "kind": pa.string(), "ordinal": pa.int32(), "other": pa.int64(), "start": pa.int64(), "length": pa.int64(), "payload": pa.binary()}


def item_facts(df: DataFrame) -> DataFrame:
    """df (path, content) -> (path, fact, item, kind, ordinal, other, start, length, payload).

    fact is item, reference (to other), property (by ordinal), association (of property other), location
    (other: it lies in the file), primary or broken; payload is that of properties and of small places.
    """
    return _rows(df, _facts, _FIELDS, "fact string, item long, kind string, ordinal int, other long, start long, length long, payload binary")


def _of(facts: DataFrame, fact: str, *columns: str) -> DataFrame:
    return facts.where(F.col("fact") == fact).select("path", *columns)


def integrity_problems(facts: DataFrame) -> DataFrame:
    """(path, rule, item): what of a file's facts does not hang together."""
    items = _of(facts, "item", "item")
    known, properties = items.distinct(), _of(facts, "property", F.col("ordinal").cast("long").alias("other"))
    references, associations, places, primary = _of(facts, "reference", "item", "other"), _of(facts, "association", "item", "other"), _of(facts, "location", "item", "other"), _of(facts, "primary", "item")
    rule = lambda df, name, item="item": df.select("path", F.lit(name).alias("rule"), F.col(item).alias("item") if item else F.lit(None).cast("long").alias("item"))
    to = known.withColumnRenamed("item", "other")
    found = [
        rule(_of(facts, "broken", F.lit(None).cast("long").alias("item")), "broken"),
        rule(facts.groupBy("path").agg(F.count_if(F.col("fact") == "primary").alias("n"), F.bool_or(F.col("fact") == "broken").alias("b")).where("n <> 1 and not b"), "primary", None),
        rule(primary.join(known, ["path", "item"], "left_anti"), "primary"),
        rule(items.groupBy("path", "item").count().where("count > 1"), "item twice"),
        rule(references.join(known, ["path", "item"], "left_anti"), "reference"), rule(references.join(to, ["path", "other"], "left_anti"), "reference", "other"),
        rule(associations.join(known, ["path", "item"], "left_anti"), "association"), rule(associations.join(properties, ["path", "other"], "left_anti"), "association"),
        rule(places.join(known, ["path", "item"], "left_anti"), "location"), rule(places.where("other = 0"), "location"),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _properties(facts: DataFrame, kind: str, name: str) -> DataFrame:
    """(path, item, name, n): the payload of the item's property of a kind, and how many it has."""
    asked = _of(facts, "association", "item", F.col("other").cast("int").alias("ordinal"))
    of_kind = facts.where((F.col("fact") == "property") & (F.col("kind") == kind)).select("path", "ordinal", "payload")
    return asked.join(of_kind, ["path", "ordinal"]).groupBy("path", "item").agg(F.min("payload").alias(name), F.count(F.lit(1)).alias(f"n_{name}"))


def _dimensions(payload: Column) -> tuple[Column, Column]:
    return _unsigned(payload, 4, 4), _unsigned(payload, 8, 4)


def gain_map_structures(facts: DataFrame) -> DataFrame:
    """One row a file: primary, tone-map and gain-map items, tiles, sizes, channels, depths; rule is the first that is broken."""
    items = _of(facts, "item", "item", "kind")
    dimg = facts.where("fact = 'reference' and kind = 'dimg'")
    sets = dimg.groupBy("path", "item").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "ordinal", "other"))), lambda x: x["other"]).alias("to"), F.count_distinct("start").alias("n_sets"))
    paths = facts.select("path").distinct()
    primary = _of(facts, "primary", "item").groupBy("path").agg(F.min("item").alias("primary"))
    tmaps = items.where("kind = 'tmap'").groupBy("path").agg(F.min("item").alias("tmap"), F.count(F.lit(1)).alias("n_tmaps"))
    base = paths.join(primary, "path", "left").join(tmaps, "path", "left").join(sets.select("path", F.col("item").alias("tmap"), F.col("to").alias("inputs"), F.col("n_sets").alias("n_inputs")), ["path", "tmap"], "left")
    base = base.withColumn("gain", F.when((F.size("inputs") == 2) & (F.col("n_inputs") == 1), F.get("inputs", F.lit(1))))
    kinds = items.groupBy("path", "item").agg(F.min("kind").alias("gain_kind"))
    small = facts.where("fact = 'location' and payload is not null").groupBy("path", "item").agg(F.min_by("payload", "ordinal").alias("grid"))
    keyed = lambda df: df.withColumnRenamed("item", "gain")
    base = base.join(keyed(kinds), ["path", "gain"], "left").join(keyed(sets).withColumnRenamed("to", "tiles"), ["path", "gain"], "left").join(keyed(small), ["path", "gain"], "left")
    base = base.join(keyed(_properties(facts, "ispe", "ispe")), ["path", "gain"], "left").join(keyed(_properties(facts, "pixi", "pixi")), ["path", "gain"], "left")
    wide = _unsigned(F.col("grid"), 1, 1) % 2 == 1
    side = lambda i: F.when(wide, _unsigned(F.col("grid"), 4 + 4 * i, 4)).otherwise(_unsigned(F.col("grid"), 4 + 2 * i, 2))
    is_grid = F.col("gain_kind") == "grid"
    base = base.withColumns({
        "rows": F.when(is_grid, _unsigned(F.col("grid"), 2, 1) + 1).otherwise(F.lit(1)), "columns": F.when(is_grid, _unsigned(F.col("grid"), 3, 1) + 1).otherwise(F.lit(1)), "grid_width": F.when(is_grid, side(0)), "grid_height": F.when(is_grid, side(1)),
        "width": _dimensions(F.col("ispe"))[0], "height": _dimensions(F.col("ispe"))[1], "n_sets": F.coalesce("n_sets", F.lit(0)), "tile_list": F.when(is_grid, F.coalesce("tiles", F.array().cast("array<long>"))).otherwise(F.array("gain")),
    })
    # Every tile with what is known of it, then one row a file.
    tiles = base.select("path", "primary", F.explode("tile_list").alias("item"))
    shared = dimg.join(primary, "path").where(F.col("item") == F.col("primary")).select("path", F.col("other").alias("item")).unionByName(primary.select("path", F.col("primary").alias("item"))).distinct().withColumn("of_primary", F.lit(True))
    filled = _of(facts, "location", "item", "length").groupBy("path", "item").agg(F.sum("length").alias("bytes"))
    each = tiles.join(kinds.withColumnRenamed("gain_kind", "kind"), ["path", "item"], "left").join(shared, ["path", "item"], "left").join(sets.select("path", "item", F.lit(True).alias("derived")), ["path", "item"], "left")
    each = each.join(filled, ["path", "item"], "left").join(_properties(facts, "hvcC", "hvcc"), ["path", "item"], "left").join(_properties(facts, "ispe", "size"), ["path", "item"], "left").withColumn("codec", hevc_profile(F.col("hvcc")))
    told = each.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_tiles"), F.count_distinct("item").alias("n_distinct"), F.bool_and(F.col("kind").eqNullSafe(F.lit("hvc1"))).alias("all_coded"), F.bool_or(F.coalesce("of_primary", F.lit(False))).alias("any_shared"), F.bool_or(F.coalesce("derived", F.lit(False))).alias("any_derived"),
        F.bool_and(F.coalesce("bytes", F.lit(0)) > 0).alias("all_filled"), F.bool_and((F.coalesce("n_hvcc", F.lit(0)) == 1) & (F.coalesce("n_size", F.lit(0)) == 1)).alias("all_told"), F.count_distinct("codec").alias("n_codecs"), F.max("codec").alias("codec"),
    )
    pixi = F.col("pixi")
    channels = _unsigned(pixi, 4, 1)
    depths = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), channels - 1).cast("int")), lambda i: F.conv(F.hex(F.substr(pixi, i + 6, F.lit(1))), 16, 10).cast("long"))
    joined = base.join(told, "path", "left").withColumn("channels", channels).withColumn("depths", depths)
    luma, chroma = F.col("codec.luma_depth"), F.col("codec.chroma_depth")
    broken = integrity_problems(facts).groupBy("path").agg(F.min("rule").alias("loose"))
    joined = joined.join(broken, "path", "left")
    rules = [
        ("integrity", F.col("loose").isNotNull()), ("tone map", ~F.col("n_tmaps").eqNullSafe(F.lit(1))), ("tone-map inputs", F.col("gain").isNull() | ~F.get("inputs", F.lit(0)).eqNullSafe(F.col("primary"))),
        ("roles", (F.col("gain") == F.col("primary")) | (F.col("gain") == F.col("tmap")) | (F.col("tmap") == F.col("primary"))), ("gain-map kind", ~F.coalesce(F.col("gain_kind").isin("grid", "hvc1"), F.lit(False))),
        ("gain-map references", F.when(is_grid, F.col("n_sets") != 1).otherwise(F.col("n_sets") != 0)), ("repeated tiles", F.col("n_distinct") < F.col("n_tiles")), ("grid tiles", is_grid & ~(F.col("rows") * F.col("columns")).eqNullSafe(F.col("n_tiles"))),
        ("dimensions", F.coalesce(F.col("n_ispe"), F.lit(0)) != 1), ("grid dimensions", is_grid & ~((F.col("grid_width") == F.col("width")) & (F.col("grid_height") == F.col("height")))),
        ("tile kind", ~F.col("all_coded")), ("shared tiles", F.col("any_shared")), ("derived tiles", F.col("any_derived")), ("empty tiles", ~F.col("all_filled")), ("tile properties", ~F.coalesce(F.col("all_told"), F.lit(False)) | F.col("codec").isNull()), ("tile codecs", F.col("n_codecs") != 1),
        ("channels", (F.coalesce(F.col("n_pixi"), F.lit(0)) != 1) | ~F.coalesce(F.col("channels").isin(1, 3), F.lit(False)) | (F.col("channels") != F.when(F.col("codec.chroma_format") == 0, 1).otherwise(3))),
        ("depths", F.col("depths") != F.when(F.col("channels") == 1, F.array(luma)).otherwise(F.array(luma, chroma, chroma))),
    ]
    rule = F.lit(None).cast("string")
    for name, test in reversed(rules):
        rule = F.when(test, name).otherwise(rule)
    joined = joined.withColumn("rule", rule)
    sound = lambda c: F.when(F.col("rule").isNull(), c)
    return joined.select(
        "path", "rule", F.when(F.col("rule") == "integrity", F.col("loose")).alias("detail"), *(sound(F.col(c)).alias(c) for c in ("primary", "tmap", "gain", "rows", "columns", "width", "height", "channels")),
        sound(F.col("n_tiles")).alias("n_tiles"), sound(F.col("codec.profile")).alias("profile"), sound(F.col("codec.chroma_format")).alias("chroma_format"), sound(luma).alias("luma_depth"), sound(chroma).alias("chroma_depth"),
    )


def gain_map_semantics(facts: DataFrame) -> DataFrame:
    """gain_map_structures() with the derived image's output: its three channels' depths and its colour.

    More rules for files that are sound so far: the tone-map item needs one size, depths of three channels,
    none of them 0, and one colour, which is a profile or names its primaries and transfer.
    """
    told = gain_map_structures(facts)
    keyed = lambda df: df.withColumnRenamed("item", "tmap")
    both = told.join(keyed(_properties(facts, "pixi", "out_pixi")), ["path", "tmap"], "left").join(keyed(_properties(facts, "ispe", "out_size")), ["path", "tmap"], "left").join(keyed(_properties(facts, "colr", "colr")), ["path", "tmap"], "left")
    kind, word = F.substring("colr", 1, 4).cast("string"), lambda at: _unsigned(F.col("colr"), at, 2)
    named = (kind == "nclx") & (F.length("colr") == 11) & ~word(4).isin(0, 2) & ~word(6).isin(0, 2) & (_unsigned(F.col("colr"), 10, 1) % 128 == 0)
    depths = [_unsigned(F.col("out_pixi"), 5 + i, 1) for i in range(3)]
    wrong = (
        F.when(F.col("rule").isNotNull(), F.col("rule")).when(F.coalesce(F.col("n_out_size"), F.lit(0)) != 1, "output size")
        .when((F.coalesce(F.col("n_out_pixi"), F.lit(0)) != 1) | (_unsigned(F.col("out_pixi"), 4, 1) != 3) | (F.length("out_pixi") < 8) | (F.least(*depths) == 0), "output depths")
        .when((F.coalesce(F.col("n_colr"), F.lit(0)) != 1) | ~F.coalesce(named | kind.isin("prof", "rICC"), F.lit(False)), "output colour")
    )
    out = both.withColumn("rule", wrong)
    sound = lambda c: F.when(F.col("rule").isNull(), c)
    kept = [F.col(c) if c in ("path", "rule", "detail") else sound(F.col(c)).alias(c) for c in told.columns]
    return out.select(*kept, sound(F.array(*depths)).alias("out_depths"), sound(F.when(kind == "nclx", F.struct(word(4).alias("primaries"), word(6).alias("transfer"), word(8).alias("matrix"), (_unsigned(F.col("colr"), 10, 1) >= 128).alias("full_range")))).alias("nclx"))
