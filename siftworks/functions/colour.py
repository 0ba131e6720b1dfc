"""Colour in steps: a matrix before a table, reconstruction in BT.2020, the semantic tone stage, half floats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from siftworks.functions.transfer import clamp, gain_apply, matrix

# Linear Display P3 and sRGB to BT.2020, D65; below DARK a tone ratio is cleared.
TO_BT2020 = {
    "p3": [[0.7538330343617218, 0.1985973690526163, 0.04756959658566188], [0.04574384896535833, 0.9417772198116935, 0.01247893122294812], [-0.001210340354518324, 0.01760171730108989, 0.9836086230534284]],
    "srgb": [[0.6274038959346986, 0.3292830383778837, 0.04331306568741723], [0.06909728935823207, 0.9195403950754587, 0.011362315566309177], [0.016391438875150280, 0.08801330787722578, 0.8955952532476239]],
    "bt2020": [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]],
}
DARK = 1.0 / 255.0


def mapped(r: Column, g: Column, b: Column, rows: list[list[float]], table: Callable[[Column, Column, Column], Column] | None = None) -> Column:
    """A 3 x 3 matrix, then a table if there is one (which holds its input to its domain): array of three.  Null where an input is not finite."""
    out = matrix(r, g, b, rows)
    found = table(*out) if table else F.array(*out)
    sound = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in (r, g, b)]
    return F.when(sound[0] & sound[1] & sound[2], found)


def reconstructed(base: list[Column], codes: list[Column], weight: Column, low: list[Column], high: list[Column], gamma: list[float], base_offset: list[float], alternate_offset: list[float], base_space: str, in_base_space: bool) -> list[Column]:
    """Linear BT.2020 of a base pixel with its gain applied, in the base's primaries or in BT.2020; the offset goes before the change of primaries.

    A single code, or single parameters, count for all three channels.
    """
    one = lambda v, i: v[i] if len(v) > 1 else v[0]
    start = base if in_base_space else matrix(*base, TO_BT2020[base_space])
    lit = [gain_apply(start[i], one(codes, i), weight, one(low, i), one(high, i), one(gamma, i), one(base_offset, i), one(alternate_offset, i)) for i in range(3)]
    return matrix(*lit, TO_BT2020[base_space]) if in_base_space else lit


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x worked out once, however often use names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def half_rounded(x: Column) -> Column:
    """x as the nearest 16-bit float, ties to even; for |x| up to 65,504."""

    def rounded(v: Column) -> Column:
        size = F.abs(v)
        step = _let(F.greatest(F.lit(-14.0), F.floor(F.log2(size)).cast("double")), lambda e: F.pow(F.lit(2.0), e + F.when(F.pow(F.lit(2.0), e + 1) <= size, 1).when((F.pow(F.lit(2.0), e) > size) & (e > -14), -1).otherwise(0) - 10))
        return F.when(size == 0, v).otherwise(F.signum(v) * _let(step, lambda q: F.rint(size / q) * q))

    return _let(x.cast("double"), rounded)


def tone_curve_at(samples: list[float], code: Column) -> Column:
    """256 samples read linearly at a code held to [0, 1], whose place is a 16-bit float of a 32-bit product."""
    if len(samples) != 256:
        raise ValueError("a tone curve has 256 samples")
    place = F.least(half_rounded(clamp(code, 0.0, 1.0).cast("float") * F.lit(255.0).cast("float")), F.lit(255.0))
    table = F.array(*map(F.lit, samples))

    def at(v: Column) -> Column:
        low = F.floor(v).cast("int")
        return F.get(table, low) * (1 - (v - low)) + F.get(table, F.least(low + 1, F.lit(255))) * (v - low)

    return _let(place, at)


def semantic_tone(primary: Column, thumbnail: Column, samples: list[float], exposure: Column, mix: Column, tone: tuple[Column, Column], highlight: tuple[Column, Column], person: Column) -> Column:
    """A channel after tone mapping, apart for background and foreground, then blended by the person's matte.

    tone and highlight are (background, foreground).
    """
    blend = lambda a, b, w: a * (1 - w) + b * w
    target = _let(F.least(exposure * thumbnail, F.lit(1.0)), lambda x: blend(x, tone_curve_at(samples, x), mix))

    def side(ratio: Column, t: Column, h: Column) -> Column:
        return _let(blend(ratio, F.lit(1.0), t), lambda lifted: blend(lifted, F.least(lifted, F.lit(1.0)), h)) * primary

    ratio = F.when(primary < DARK, 0.0).otherwise(F.try_divide(target, primary))
    return _let(ratio, lambda r: blend(side(r, tone[0], highlight[0]), side(r, tone[1], highlight[1]), person))
