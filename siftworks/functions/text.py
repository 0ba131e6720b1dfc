"""Strings: digests, buckets, file names, times and numbers in metadata."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf


def sha256(x: Column) -> Column:
    """Lower-case hex; a null is digested as empty."""
    return F.sha2(F.coalesce(x.cast("string"), F.lit("")).cast("binary"), 256)


def is_digest(x: Column) -> Column:
    return x.rlike("^[0-9a-f]{64}$")


def hash_bucket(identity: Column, buckets: int = 100) -> Column:
    """First 32 bits of the identity's SHA-256 modulo buckets."""
    return (F.conv(F.substring(sha256(identity), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def hash_split(identity: Column, train: int = 70, validation: int = 15) -> Column:
    bucket = hash_bucket(identity)
    return F.when(bucket < train, "train").when(bucket < train + validation, "calibration").otherwise("heldout")


def sequenced_name(stem: Column, extension: Column, k: Column) -> Column:
    """stem.ext, from the second on stem (k).ext."""
    return F.concat(stem, F.when(k > 1, F.concat(F.lit(" ("), k.cast("string"), F.lit(")"))).otherwise(F.lit("")), F.lit("."), extension)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def folder(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def capture_time(text: Column, fraction: Column | None = None) -> Column:
    """'yyyy:MM:dd HH:mm:ss' with sub-second digits, to microseconds; null if it is no such time."""
    good = text.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$")
    seconds = F.try_to_timestamp(F.when(good, text), F.lit("yyyy:MM:dd HH:mm:ss"))
    if fraction is None:
        return seconds.cast("timestamp_ntz")
    digits = F.rpad(F.substring(F.regexp_replace(F.coalesce(fraction, F.lit("")), r"\D", ""), 1, 6), 6, "0")
    return F.timestamp_micros(F.unix_micros(seconds) + digits.cast("long")).cast("timestamp_ntz")


def number(text: Column) -> Column:
    """A finite double from '12', '1.5', 'a/b' or 'n unit'; null otherwise."""
    t = F.trim(text)
    ratio = F.try_divide(F.regexp_extract(t, r"^([-+]?[0-9.]+)\s*/", 1).try_cast("double"), F.regexp_extract(t, r"/\s*([-+]?[0-9.]+)$", 1).try_cast("double"))
    lone = F.regexp_extract(t, r"^([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)(?:\s+[A-Za-z]+)?$", 1).try_cast("double")
    value = F.when(t.contains("/"), ratio).otherwise(lone)
    return F.when(F.abs(value) < float("inf"), value)


def focal_from_lens(text: Column) -> Column:
    """'<n>mm' as the word after the first 'camera', else null."""
    return F.regexp_extract(text, r"(?i)^(?:.*?\s)??camera\s+([0-9]+(?:\.[0-9]+)?)mm(?:\s|$)", 1).try_cast("double")


def resolved_focal(values: Column) -> Column:
    """The one focal length of an array: zeros ignored, 1 to 300; null unless all agree within 0.001."""
    used = F.filter(values, lambda x: x != 0)
    first = F.try_element_at(used, F.lit(1))
    return F.when(first.between(1, 300) & F.forall(used, lambda x: F.abs(x - first) <= 0.001), first)


# Names of licences that leave a work free, and the versions of those that ask for the author's name.
def open_licence(name: Column) -> Column:
    return F.lower(name).isin("cc0", "public domain", "public-domain") | name.rlike(r"^CC BY(-SA)? (1\.0|2\.0|2\.5|3\.0|4\.0)$")


def glob_to_regex(pattern: str) -> str:
    """A path pattern (* and ? over any characters, / too; [...] and [!...] classes) as a regular expression for the whole path."""
    out, i = "", 0
    while i < len(pattern):
        c, end = pattern[i], pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "!"))
        if c == "[" and end > 0:
            inside = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("^", "\\^")
            out, i = out + "[" + ("^" + inside[1:] if inside.startswith("!") else inside) + "]", end + 1
            continue
        out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return f"(?s)^{out}(?![\\s\\S])"


def canonical_json(values: Column) -> Column:
    """A map<string,string> as JSON with sorted keys and no spaces."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def same_time(ticks_a: Column, base_a: Column, ticks_b: Column, base_b: Column) -> Column:
    """Equality of rational times ticks * (num / den), bases as struct<num,den>."""
    wide = lambda x: x.cast("decimal(38,0)")
    return wide(ticks_a) * base_a["num"] * base_b["den"] == wide(ticks_b) * base_b["num"] * base_a["den"]


def numeric_features(*columns: Column) -> list[Column]:
    """Values with null as 0, and a mask of what was observed."""
    return [F.array(*(F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns)), F.array(*(c.isNotNull() for c in columns))]


def strict_json(text: Column) -> Column:
    """text if it is JSON without a repeated key in an object and without NaN or Infinity, else null."""
    def once(pairs: list) -> dict:
        out = dict(pairs)
        if len(out) < len(pairs):
            raise ValueError("repeated key")
        return out

    def refuse(word: str) -> None:
        raise ValueError(word)

    @pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def checked(v: str | None) -> str | None:
            try:
                json.loads(v, object_pairs_hook=once, parse_constant=refuse)
            except (TypeError, ValueError, RecursionError):
                return None
            return v

        return values.map(checked)

    return run(text)


def total_order(x: Column) -> Column:
    """A key that sorts doubles completely: -0.0 before 0.0, NaN last."""
    return F.struct(F.isnan(x).alias("nan"), x.alias("value"), (x.cast("string") != "-0.0").alias("sign"))
