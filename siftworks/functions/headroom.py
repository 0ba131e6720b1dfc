"""Headroom of gain maps: scale from capture metadata, knee point, derived parameters, code mapping, info vector.

Metadata is an array of floats: 36 of the single-channel form, at least 20 of the per-channel form.
"""

from __future__ import annotations

import pandas as pd
import numpy as np
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf

# Places in the 36 floats, and the constants of the headroom model.
VERSION, NORMAL, FACE, HIGHLIGHT, GAIN, PRECOMPUTED, CONFIG = 0, 23, 24, 29, 32, 33, 34
SIGMOID = {"slope": -0.1175, "shift": -6.829, "top": 780.3, "base": -772.3}
LINES = ((210.0, 0.3456, 1.824), (340.0, 0.5883, 1.401), (None, 0.1046, 1.878))  # highlight up to, slope, offset
LEAST, MOST = 1.0, 7.9


def _held(x: Column) -> Column:
    return F.greatest(F.lit(LEAST), F.least(F.lit(MOST), x))


def _root(x: Column, by: Column | float) -> Column:
    """1 + by * (sqrt|x| - 1)."""
    return (F.sqrt(F.abs(x)) - 1) * by + 1


def _sigmoid_scale(gain: Column, face: Column, highlight: Column, config: Column) -> Column:
    raw = SIGMOID["top"] / (F.pow(F.lit(2.0), gain * SIGMOID["slope"] + SIGMOID["shift"]) + 1) + SIGMOID["base"]
    faced = F.when(face > 0, (raw - 1) * F.when(face < 1, face).otherwise(F.try_divide(F.lit(1.0), face)) + 1).otherwise(raw)
    lit = _root(faced, F.when(highlight >= 320, 1.34).when(highlight >= 200, highlight * -0.0205 + 7.9).otherwise(3.8))
    dimmed = lambda x: F.when(highlight > 320, (x - 1) * 0.8 + 1).otherwise(x)
    return F.when(config, _root(lit, 1.3)).otherwise(dimmed(F.when(face > 0, _root(lit, 1.85)).otherwise(lit)))


def _linear_scale(gain: Column, highlight: Column) -> Column:
    x = F.log2(gain * 1023.0 / 65535.0 * 63.0 + 1) / highlight * 100.0
    out = x * LINES[-1][1] + LINES[-1][2]
    for top, slope, offset in reversed(LINES[:-1]):
        out = F.when(highlight <= top, x * slope + offset).otherwise(out)
    return out


def modern_scale(meta: Column) -> Column:
    """Headroom scale of metadata of version 3 or later; null for earlier versions, see early_scale()."""
    at = lambda i: F.get(meta, F.lit(i)).cast("double")
    highlight = F.greatest(at(HIGHLIGHT), F.lit(1.0))
    config = (at(CONFIG) >= 1) & (at(CONFIG) < 2)
    modelled = _held(F.when(at(NORMAL) <= 0.99, _sigmoid_scale(at(GAIN), at(FACE), highlight, config)).otherwise(_linear_scale(F.greatest(at(GAIN), F.lit(0.0)), highlight)))
    return F.when(at(VERSION) >= 3, F.when(at(PRECOMPUTED) >= 1, at(PRECOMPUTED)).when(at(GAIN) <= 0, 1.0).otherwise(modelled))


def early_scale(meta: Column) -> Column:
    """Headroom scale of metadata before version 3, in 32-bit floats with fused products; null from version 3 on."""

    @pandas_udf("double")
    def run(rows: pd.Series) -> pd.Series:
        out = np.full(len(rows), np.nan)
        some = [i for i, r in enumerate(rows) if r is not None and len(r) == 36 and r[VERSION] < 3]
        if some:
            m = np.stack([np.asarray(rows.iloc[i], np.float32) for i in some])
            out[some] = _early(m)
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return run(meta)


def _early(m: np.ndarray) -> np.ndarray:
    f = np.float32

    def fused(a, b, c):  # a * b is exact in 64 bits, so one rounding remains
        return (np.asarray(a, np.float64) * np.float64(f(b)) + np.float64(f(c))).astype(f) if np.isscalar(b) else (np.asarray(a, np.float64) * np.asarray(b, np.float64) + np.float64(f(c))).astype(f)

    root = lambda x: np.abs(np.sqrt(x)) - f(1)
    face, light, gain = m[:, FACE], m[:, HIGHLIGHT], m[:, GAIN]
    with np.errstate(all="ignore"):
        raw = f(SIGMOID["top"]) / (np.exp2(fused(gain, SIGMOID["slope"], SIGMOID["shift"])) + f(1)) + f(SIGMOID["base"])
        share = np.where(face < 1, face, f(1) / face)
        faced = np.where(face > 0, fused(raw - f(1), share, 1.0), raw)
        s = root(faced)
        lit = np.where(light >= 320, fused(s, 1.34, 1.0), np.where(light >= 200, fused(s, fused(light, -0.0205, 7.9), 1.0), fused(s, 3.8, 1.0)))
        inner = np.where(face > 0, fused(root(lit), 1.85, 1.0), lit)
        found = np.where(light <= 320, inner, fused(inner - f(1), 0.8, 1.0))
        # the switch is a bit pattern here, not a number
        found = np.where(np.ascontiguousarray(m[:, CONFIG]).view(np.uint32) == 1, fused(root(lit), 1.3, 1.0), found)
        found = np.where(gain <= 0, f(1), found)
        found = np.where(m[:, PRECOMPUTED] >= 1, m[:, PRECOMPUTED], found)
        return np.where(m[:, VERSION] < 2, f(1), found).astype(np.float64)


def headroom_scale(meta: Column) -> Column:
    return F.coalesce(modern_scale(meta), early_scale(meta))


def safe_log2(x: Column) -> Column:
    """0 where x is not a positive number."""
    return F.when((x > 0) & (x < float("inf")), F.log2(F.when(x > 0, x).otherwise(F.lit(1.0)))).otherwise(F.lit(0.0))


def resolved(meta: Column, per_channel: Column, scale: Column) -> Column:
    """One record for both forms; null where the floats are too few (per channel) or not 36 (single).

    scale is headroom_scale(meta), which only the single-channel form uses.
    """
    at = lambda i: F.get(meta, F.lit(i)).cast("double")
    part = lambda a, f=lambda x: x: F.transform(F.slice(meta, a + 1, 3), lambda x: f(x.cast("double")))
    one = lambda x: F.array(x)
    edr, zero, unit = _held(scale), F.lit(0.0), F.lit(1.0)

    def record(channels: int, source: str, values: dict[str, Column]) -> Column:
        return F.struct(*(c.alias(n) for n, c in values.items()), F.lit(channels).alias("channels"), F.lit(source).alias("source"))

    names = ("edr_scale", "ratio_min", "ratio_max", "gamma", "epsilon_sdr", "epsilon_hdr", "display_ratio_sdr", "display_ratio_hdr", "scale", "gain_map_min", "gain_map_max", "base_headroom", "alternate_headroom", "channel_min", "channel_max", "channel_gamma", "channel_base_offset", "channel_alternate_offset")
    many = (at(18), at(0), at(4), at(7), at(10), at(13), at(16), at(17), at(18), *map(safe_log2, (at(0), at(4), at(16), at(17))), part(0, safe_log2), part(4, safe_log2), part(7), part(10), part(13))
    single = (edr, unit, edr, unit, zero, zero, unit, edr, edr, zero, safe_log2(edr), zero, safe_log2(edr), one(zero), one(safe_log2(edr)), one(unit), one(zero), one(zero))
    three = record(3, "per-channel", dict(zip(names, many, strict=True)))
    alone = record(1, "single", dict(zip(names, single, strict=True)))
    return F.when(per_channel, F.when(F.size(meta) >= 20, three)).otherwise(F.when(F.size(meta) == 36, alone))


def knee_point(scale: Column) -> Column:
    """Knee of early metadata, in 32-bit floats; null where it is not a number."""

    @pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        f, s = np.float32, x.to_numpy(np.float32)
        power = f(0.45454544)
        with np.errstate(all="ignore"):
            t = f(1) / (s * f(100))
            low = f(1) / s**power
            y = (((f(0.98) - t) / (f(1) - t)) ** power * f(1.003937) - low) / (f(1) - low)
            p = y**power
            raw = p * f(255) + f(-254)
            whole = raw / (p - f(1))
            whole = np.copysign(np.floor(np.abs(whole) + f(0.5)), whole)
            out = np.where(whole <= 0, raw, whole) / f(255)
            out = np.where(np.isfinite(y) & (y > 0) & np.isfinite(p) & (p != 1), out, f("nan")).astype(np.float64)
        return pd.Series(out).astype(object).where(np.isfinite(out), None)

    return run(scale)


def gain_map_parameters(scale: Column, knee: Column) -> dict[str, Column]:
    """Derived numbers of a gain map; all null where the scale is not positive and finite or the knee leaves no range."""
    base = F.pow(F.try_divide(F.lit(1.0), scale), F.lit(1 / 2.2))
    ok = (scale > 0) & (scale < float("inf")) & (knee < 1)
    found = {"knee": knee, "knee_range": 1 - knee, "headroom_scale": F.try_divide(1 - base, base), "max_boost": F.when(scale > 1, scale).otherwise(2.0), "log2_scale": F.when(scale > 1, F.try_divide(F.lit(255.0), F.log2(F.when(scale > 1, scale).otherwise(F.lit(2.0))))).otherwise(0.0)}
    return {n: F.when(ok, c) for n, c in found.items()}


def gain_code(code: Column, p: dict[str, Column]) -> Column:
    """8-bit mask code to 8-bit log gain; tables with 1000 steps a unit are read at truncated places.

    From max_boost on the gain is 255, which 255 / log2(scale) * log2(scale) gives but for its last bit.
    """
    step = lambda x, top: F.least(F.floor(x * 1000), F.lit(top)) / 1000.0
    grey = F.pow(step(code / 255.0, 1000), F.lit(0.625))
    linear = F.pow(step(F.try_divide(grey - p["knee"], p["knee_range"]), 1000), F.lit(2.2))
    boosted = F.when(grey < p["knee"], 1.0).otherwise(F.pow(step(linear, 1000) * p["headroom_scale"] + 1, F.lit(2.2)))
    at = F.when(boosted < 1, 1.0).otherwise(step(F.least(boosted, F.lit(8.0)), 8000))
    gain = p["log2_scale"] * F.log2(F.greatest(at, F.lit(1.0)))
    whole = F.greatest(F.lit(0), F.least(F.lit(255), gain.cast("int")))
    return F.when((at >= p["max_boost"]) & (p["log2_scale"] > 0), 255).otherwise(whole)


def info_vector(r: Column) -> Column:
    """The 20 floats of the per-channel form from a resolved record, each rounded to 32 bits; missing channels repeat the first."""
    def three(name: str, f=lambda x: x) -> list[Column]:
        return [f(F.coalesce(F.get(r[name], F.lit(i)), F.get(r[name], F.lit(0)))) for i in range(3)]

    two = lambda x: F.pow(F.lit(2.0), x)
    values = [*three("channel_min", two), F.lit(1.0), *three("channel_max", two), *three("channel_gamma"), *three("channel_base_offset"), *three("channel_alternate_offset"), r["display_ratio_sdr"], r["display_ratio_hdr"], r["scale"], F.lit(0.0)]
    return F.array(*(v.cast("float").cast("double") for v in values))
