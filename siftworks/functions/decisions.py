"""Decision tables on record facts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def capabilities(content: Column, markers: Mapping[str, list[bytes]]) -> Column:
    """Names, sorted, all of whose byte markers are in the content."""
    held = [F.when(_all([F.contains(content, F.lit(m)) for m in marks]), F.lit(name)) for name, marks in sorted(markers.items())]
    return F.array_compact(F.array(*held))


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def tags(*sources: Column) -> Column:
    """Sorted distinct union of tag arrays; null arrays count as empty."""
    return F.array_sort(F.array_distinct(F.concat(*(F.coalesce(s, F.expr("cast(array() as array<string>)")) for s in sources))))


def zoom_bucket(zoom: Column) -> Column:
    """Region of a zoom ratio; bounds 2, 3 and 6 belong to the upper region.  A null zoom has none."""
    return F.when(zoom < 2, "one-to-below-two").when(zoom < 3, "two-to-below-three").when(zoom < 6, "three-to-below-six").when(zoom.isNotNull(), "six-to-ten")


def blur_curve(apertures: Column, values: Column) -> Column:
    """Pairs (aperture, value) of two arrays that are finite, the aperture positive, the value not negative; null if none is left."""
    finite = lambda x: ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf"))
    n = F.least(F.size(apertures), F.size(values))
    pairs = F.zip_with(F.slice(apertures, F.lit(1), n), F.slice(values, F.lit(1), n), lambda a, v: F.struct(a.cast("double").alias("aperture"), v.cast("double").alias("value")))
    good = F.filter(pairs, lambda p: finite(p["aperture"]) & finite(p["value"]) & (p["aperture"] > 0) & (p["value"] >= 0))
    return F.when(F.size(good) > 0, good)


def focus_branch(near: Column, scene: Column, roi: Column, face: Column, portrait: Column, pet: Column) -> Column:
    """Where the focus of a portrait is taken from: near objects go by scene class, all others by the kind of the region."""
    by_scene = F.when(scene == 0, "near-object").when((scene == 2) & (roi == 3), "pet-region").otherwise("center-region")
    no_face = F.lit("portrait-without-face")
    by_region = (
        F.when(roi == 1, F.when(face, "tapped-face").when(portrait, "portrait-face").otherwise(no_face))
        .when(roi == 2, "center-region")
        .when(roi == 3, F.when(pet, "pet-region").otherwise(no_face))
        .otherwise(F.when(portrait, no_face).otherwise("disparity-histogram"))
    )
    return F.when(near, by_scene).otherwise(by_region)


#: Targets for which a fallback has a reason when the file goes to the standard container instead.
FALLBACKS = {"huawei": "needs an existing motion container", "honor": "no native writer", "oppo": "no motion in this still format", "vivo": "no motion in this still format", "xiaomi": "no motion in this still format"}


def target_plan(target: Column, heic: Column, motion_container: Column) -> Column:
    """struct<effective, fallback>: the container that a target's file really gets, and why, if it is not the target's own."""
    standard = F.lit("android-standard")
    native = F.when(target == "huawei", motion_container).when(target == "honor", F.lit(False)).when(target.isin("oppo", "vivo", "xiaomi"), ~heic).otherwise(F.lit(True))
    reason = F.create_map(*(F.lit(x) for pair in FALLBACKS.items() for x in pair))
    return F.struct(F.when(native, target).otherwise(standard).alias("effective"), F.when(~native, F.try_element_at(reason, target)).alias("fallback"))


def display_plan(headroom: Column) -> Column:
    """Stops of a display headroom of 2, 4 or 8; null for others."""
    return F.when(headroom.isin(2, 4, 8), F.log2(headroom.cast("double")).cast("int"))


def lens_profile(physical: Column, equivalent: Column) -> Column:
    """Profile by physical focal length (up to 11, under 28 mm) and then by equivalent focal length (under 45 mm)."""
    return F.when(physical <= 11, F.when(equivalent < 45, "phone-wide").otherwise("phone-tele")).when(physical < 28, "short").otherwise("long")


def resolved_layout(wanted: Column, supported: list[str], promotions: Mapping[str, str]) -> Column:
    """The wanted layout if it is supported, else what it is promoted to if that is, else null."""
    promoted = F.lit(None).cast("string")
    for a, b in promotions.items():
        promoted = F.when(wanted == a, b).otherwise(promoted)
    return F.when(wanted.isin(supported), wanted).when(promoted.isin(supported), promoted)


def has_foreground(samples: Column, level: int = 128, least: int = 16) -> Column:
    """At least that many samples reach the level."""
    return F.size(F.filter(samples, lambda v: v >= level)) >= least


def output_name(stem: Column, marker: str, k: Column, motion: Column, extension: Column) -> Column:
    """stem.marker, ' (k)' from the second on, 'MP' for motion assets, extension."""
    return F.concat(stem, F.lit(f".{marker}"), F.when(k > 1, F.concat(F.lit(" ("), k.cast("string"), F.lit(")"))).otherwise(F.lit("")), F.when(motion, "MP").otherwise(F.lit("")), F.lit("."), extension)


def label_class(label: Column, synonyms: Mapping[str, list[str]]) -> Column:
    """The class whose synonyms hold the label, ignoring case; null if none does."""
    out = F.lit(None).cast("string")
    for name, words in synonyms.items():
        out = F.when(F.lower(label).isin([w.lower() for w in words]), name).otherwise(out)
    return out
