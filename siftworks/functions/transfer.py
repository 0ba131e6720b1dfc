"""Transfer curves, colour matrices and gain maps as column expressions on doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# SMPTE ST 2084, ITU-R BT.2100 HLG, the log curve and Display P3 luminance.
PQ = {"m1": 2610 / 16384, "m2": 2523 / 4096 * 128, "c1": 3424 / 4096, "c2": 2413 / 4096 * 32, "c3": 2392 / 4096 * 32}
HLG = {"a": 0.17883277, "b": 0.28466892, "c": 0.55991073}
LOG = {"a": 0.08550479263067245, "b": 0.009640520438551903, "c": 0.693369448184967}
P3_LUMINANCE = (0.22897456, 0.69173855, 0.07928691)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def pq_encode(x: Column) -> Column:
    """Light in [0, 1] to code; null outside."""
    p = F.pow(x, F.lit(PQ["m1"]))
    return F.when(x.between(0, 1), F.pow((PQ["c1"] + PQ["c2"] * p) / (1 + PQ["c3"] * p), F.lit(PQ["m2"])))


def pq_decode(code: Column) -> Column:
    p = F.pow(code, F.lit(1 / PQ["m2"]))
    return F.when(code.between(0, 1), F.pow(F.greatest(p - PQ["c1"], F.lit(0.0)) / (PQ["c2"] - PQ["c3"] * p), F.lit(1 / PQ["m1"])))


def hlg_encode(x: Column) -> Column:
    return F.when(x.between(0, 1), F.when(x <= 1 / 12, F.sqrt(3 * x)).otherwise(HLG["a"] * F.log(F.greatest(12 * x - HLG["b"], F.lit(1e-12))) + HLG["c"]))


def hlg_decode(code: Column) -> Column:
    return F.when(code.between(0, 1), F.when(code <= 0.5, code * code / 3).otherwise((F.exp((code - HLG["c"]) / HLG["a"]) + HLG["b"]) / 12))


def srgb_decode(code: Column) -> Column:
    return F.when(code <= 0.04045, code / 12.92).otherwise(F.pow((F.greatest(code, F.lit(0.0)) + 0.055) / 1.055, F.lit(2.4)))


def srgb_encode(x: Column) -> Column:
    return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(F.greatest(x, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


def log_encode(x: Column) -> Column:
    """a * log2(x + b) + c held to [0, 1]; 0 where x + b is not positive."""
    lifted = x + LOG["b"]
    return F.when(lifted > 0, clamp(LOG["a"] * F.log2(F.when(lifted > 0, lifted).otherwise(F.lit(1.0))) + LOG["c"], 0.0, 1.0)).otherwise(F.lit(0.0))


def log_decode(code: Column) -> Column:
    return F.pow(F.lit(2.0), (clamp(code, 0.0, 1.0) - LOG["c"]) / LOG["a"]) - LOG["b"]


def log_code16(x: Column, exposure: Column) -> Column:
    """16-bit log code of x / exposure; null where the exposure is not positive."""
    return F.when(exposure > 0, F.round(log_encode(x / exposure) * 65535).cast("int"))


def matrix(r: Column, g: Column, b: Column, rows: list[list[float]]) -> list[Column]:
    return [m[0] * r + m[1] * g + m[2] * b for m in rows]


def p3_luminance(r: Column, g: Column, b: Column) -> Column:
    return matrix(r, g, b, [list(P3_LUMINANCE)])[0]


def gain_weight(target: Column, base: Column, alternate: Column) -> Column:
    """Share of a gain map at a headroom: sign(span) * clamp((target - base) / span); no span: full from the base on."""
    span = alternate - base
    share = clamp(F.try_divide(target - base, span), 0.0, 1.0)
    return F.when(span == 0, F.when(target >= base, 1.0).otherwise(0.0)).otherwise(F.signum(span) * share)


def gain_apply(base: Column, code: Column, weight: Column, low: Column, high: Column, gamma: float, base_offset: float, alternate_offset: float) -> Column:
    log_gain = low + F.pow(code, F.lit(1 / gamma)) * (high - low)
    return F.pow(F.lit(2.0), weight * log_gain) * (base + base_offset) - alternate_offset


def exposure_boost(goal: Column, present: Column) -> Column:
    """sqrt(goal / present) held to [1, 2.5]; 1 where either is not positive."""
    return F.when((goal > 0) & (present > 0), clamp(F.sqrt(F.try_divide(goal, present)), 1.0, 2.5)).otherwise(F.lit(1.0))


def quadratic_basis(r: Column, g: Column, b: Column) -> Column:
    return F.array(F.lit(1.0), r, g, b, r * r, r * g, r * b, g * g, g * b, b * b)


def budget(reference: Column, fraction: float, absolute: float) -> Column:
    return F.greatest(reference * (1 + fraction), reference + absolute)


def equivalent_focal(focal: Column, sensor_width: Column, sensor_height: Column) -> Column:
    """Focal length with the diagonal view of 36 x 24 mm."""
    return F.try_divide(focal * F.hypot(F.lit(36.0), F.lit(24.0)), F.hypot(sensor_width, sensor_height))


def even_fit(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Dimensions scaled down to most, never up, rounded to even, at least 2."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    even = lambda x: F.greatest(F.lit(2), (F.round(x * scale / 2) * 2).cast("int"))
    return even(width), even(height)


def rank_to_depth(rank: Column, near: float, far: float, exponent: float) -> Column:
    """Depth of an 8-bit rank through disparity: 1 / (far' + (rank / 255)**exponent * (near' - far')), capped."""
    disparity = 1 / far + F.pow(rank / 255, F.lit(exponent)) * (1 / near - 1 / far)
    return F.least(F.lit(140000.0), 1 / disparity)


def depth_to_rank(depth: Column, near: float, far: float, exponent: float) -> Column:
    share = clamp((1 / depth - 1 / far) / F.lit(1 / near - 1 / far), 0.0, 1.0)
    return F.round(255 * F.pow(share, F.lit(1 / exponent))).cast("int")


def oriented(x: Column, y: Column, w: Column, h: Column, orientation: Column) -> list[Column]:
    """A normalised box (x, y, w, h) after an EXIF orientation 1..8; other values leave it."""
    o = orientation
    swapped = o.isin(5, 6, 7, 8)
    nx = F.when(o.isin(2, 3), 1 - x - w).when(o.isin(5, 8), y).when(o.isin(6, 7), 1 - y - h).otherwise(x)
    ny = F.when(o.isin(3, 4), 1 - y - h).when(o.isin(5, 6), x).when(o.isin(7, 8), 1 - x - w).otherwise(y)
    return [nx, ny, F.when(swapped, h).otherwise(w), F.when(swapped, w).otherwise(h)]


def disparity(rank: Column, scale: Column, exponent: int) -> Column:
    """Disparity of an 8-bit rank, falling from 255 * scale to 0; null where the scale is not positive or the exponent not 1 or 2."""
    if exponent not in (1, 2):
        return F.lit(None).cast("double")
    span = scale * 255.0
    return F.when(scale > 0, span - F.pow(rank / 255.0, F.lit(exponent)) * span)


def focus_disparity(rank: Column, span: Column, exponent: int) -> Column:
    """Disparity of a focus rank, the rank held to 0..255."""
    if exponent not in (1, 2):
        return F.lit(None).cast("double")
    return F.when(span >= 0, (1 - F.pow(clamp(rank / 255.0, 0.0, 1.0), F.lit(exponent))) * span)


def display_schedule(headroom: Column, gap: Column) -> Column:
    """struct of weights at a display headroom from 1 to 8 for a range gap in stops; null outside."""
    stops = F.log2(F.when(headroom >= 1, headroom).otherwise(F.lit(1.0)))
    some = F.greatest(gap, F.lit(0.01))
    return F.when(headroom.between(1, 8), F.struct((stops / 3).alias("master"), (1 - stops / F.greatest(some, F.lit(3.0))).alias("retained"), F.greatest(1 - stops / some, F.lit(0.0)).alias("unconstrained")))


def optical_zoom(equivalent: Column, digital: Column, anchor: Column) -> Column:
    """struct<optical, zoom>: the lens's own equivalent focal length and the digital zoom in front of it.

    The recorded zoom counts where it is at least 1 and within max(0.08, 5 %) of the ratio of focal
    lengths; else the ratio does, never below 1.
    """
    recorded = F.when(digital > 0, digital).otherwise(F.lit(1.0))
    optical = F.coalesce(anchor, equivalent / F.greatest(recorded, F.lit(1.0)))
    ratio = F.try_divide(equivalent, optical)
    near = (recorded >= 1) & (F.abs(recorded - ratio) <= F.greatest(F.lit(0.08), ratio * 0.05))
    return F.when((equivalent > 0) & (optical > 0), F.struct(optical.alias("optical"), F.when(near, recorded).otherwise(F.greatest(ratio, F.lit(1.0))).alias("zoom")))


def cropped_profile(equivalent: Column, anchor: Column, largest: Column, width: Column, height: Column, base_width: Column, focal_pixels: Column) -> Column:
    """struct of a lens profile cropped to an equivalent focal length: reference size in multiples of four and focal length in pixels of the image."""
    scale = anchor / F.least(equivalent, largest)
    four = lambda x: F.greatest(F.round(x * scale / 4) * 4, F.lit(4.0)).cast("int")
    return F.struct(four(width).alias("width"), four(height).alias("height"), (focal_pixels * base_width / four(width)).alias("focal_pixels"), ((width - four(width)) / 2.0).alias("offset_x"), ((height - four(height)) / 2.0).alias("offset_y"))
