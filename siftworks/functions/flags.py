"""Bit flags in capture metadata: reading them from comments and classifying records by them.

Flags are unsigned 64-bit; they are held as decimal(20,0) and tested through two 32-bit halves.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Mode names by priority, each with its bit; the two masks; prefixes and JSON key.
MODES = {
    "master": 0x1_0000_0000, "ricoh-gr": 0x8000_0000, "professional": 0x100, "portrait": 0x10, "night": 0x800, "panorama": 0x4, "time-lapse": 0x8,
    "ultra-high-resolution": 0x2000, "id-photo": 0x4000, "sticker": 0x200, "enhanced-text": 0x1000, "group-photo": 0x40_0000, "double-exposure": 0x8000, "beauty": 0x2,
}
KNOWN_MASK = 0x4000_0003_FFFF_FFFF
MAPPED_MASK = 0x1_8040_FB1E
PREFIXES = ("oplus_", "oppo_")
JSON_KEY = "oplustag"
_U64 = "decimal(20,0)"
_MAX = "18446744073709551615"
_HALF = 1 << 32


def _u64(digits: Column) -> Column:
    """Digits as an unsigned 64-bit number, null if they are none or too large."""
    value = digits.try_cast("decimal(38,0)")
    return F.when((F.length(F.ltrim(digits, F.lit("0"))) <= 20) & (value <= F.lit(_MAX).cast("decimal(38,0)")), value).cast(_U64)


def parse_json_flags(raw: Column, key: str = JSON_KEY) -> Column:
    """The value of the least key that equals key but for case: a number, or a string of one."""
    entries = F.map_entries(F.from_json(raw, "map<string,string>"))
    hits = F.array_sort(F.filter(entries, lambda e: F.lower(e["key"]) == key))
    return _u64(_digits_only(F.trim(F.try_element_at(hits, F.lit(1))["value"])))


def _digits_only(text: Column) -> Column:
    found = F.regexp_extract(text, r"^(\d+)$", 1)
    return F.when(found != "", found)


def parse_prefixed_flags(raw: Column) -> Column:
    """Digits after the first occurrence of each prefix, in prefix order; a prefix without digits is passed over.

    A number too large gives null and ends the search.
    """
    text = F.translate(raw, "\0", "")
    out = F.lit(None).cast(_U64)
    for prefix in reversed(PREFIXES):
        at = F.instr(F.lower(text), F.lit(prefix))
        digits = F.regexp_extract(F.substr(text, at + len(prefix)), r"^(\d+)", 1)
        out = F.when((at > 0) & (digits != ""), _u64(digits)).otherwise(out)
    return out


def parse_flags(raw: Column) -> Column:
    return F.coalesce(parse_json_flags(raw), parse_prefixed_flags(raw))


def scan_prefixed_flags(raw: Column) -> Column:
    """Leftmost prefix whose digits fit; others are passed over."""
    found = F.regexp_extract_all(raw, F.lit(f"(?i)(?:{'|'.join(PREFIXES)})(\\d+)"), F.lit(1))
    return F.try_element_at(F.filter(F.transform(found, _u64), lambda x: x.isNotNull()), F.lit(1))


def scan_json_flags(raw: Column, key: str = JSON_KEY) -> Column:
    found = F.regexp_extract_all(raw, F.lit(f'(?i){key}["\\s]*:\\s*"?(\\d+)'), F.lit(1))
    return F.try_element_at(F.filter(F.transform(found, _u64), lambda x: x.isNotNull()), F.lit(1))


def halves(flags: Column) -> tuple[Column, Column]:
    """High and low 32 bits as longs.  A decimal quotient is rounded to six places, so only what divides is divided."""
    wide, half = flags.cast("decimal(38,0)"), F.lit(_HALF).cast("decimal(38,0)")
    low = wide % half
    return ((wide - low) / half).cast("long"), low.cast("long")


def _and(flags: Column, mask: int) -> Column:
    high, low = halves(flags)
    return (high.bitwiseAND(F.lit(mask >> 32)).cast(_U64) * F.lit(_HALF).cast(_U64) + low.bitwiseAND(F.lit(mask & 0xFFFFFFFF)).cast(_U64)).cast(_U64)


def modes(flags: Column) -> Column:
    """Modes whose bit is set, by priority."""
    high, low = halves(flags)
    part = lambda bit: high.bitwiseAND(F.lit(bit >> 32)) if bit >> 32 else low.bitwiseAND(F.lit(bit))
    return F.array_compact(F.array(*(F.when(part(bit) != 0, F.lit(name)) for name, bit in MODES.items())))


def recognized(flags: Column) -> Column:
    return _and(flags, MAPPED_MASK)


def known_unmapped(flags: Column) -> Column:
    return _and(flags, KNOWN_MASK & ~MAPPED_MASK)


def unknown(flags: Column) -> Column:
    return _and(flags, ~KNOWN_MASK & ((1 << 64) - 1))


def metadata_status(raw: Column, flags: Column) -> Column:
    return F.when(raw.isNull() | (F.trim(raw) == ""), "missing-user-comment").when(flags.isNull(), "malformed-user-comment").otherwise("ok")


def primary_mode(found: Column, flags: Column, status: Column) -> Column:
    """First mode by priority; 'normal' for a readable record without any and without unknown bits."""
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.when((status == "ok") & flags.isNotNull() & (unknown(flags) == 0), "normal"))


def classification_status(found: Column, flags: Column, status: Column) -> Column:
    return F.when(status != "ok", status).when(F.size(found) > 0, F.when(unknown(flags) != 0, "classified-with-unknown").otherwise("classified")).when(unknown(flags) != 0, "unknown-flags").otherwise("normal")


def set_bits(flags: Column, bits: int) -> Column:
    """Long flags with bits set."""
    return flags.bitwiseOR(F.lit(bits))


def clear_bits(flags: Column, bits: int) -> Column:
    return flags.bitwiseAND(F.lit(~bits))


def padded(flags: Column, original: Column) -> Column:
    """Digits at no less than the original's width."""
    digits = flags.cast("string")
    return F.when(F.length(digits) < F.length(original), F.lpad(digits, F.length(original), "0")).otherwise(digits)
