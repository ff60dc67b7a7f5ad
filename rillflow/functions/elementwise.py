"""Stateless scalar operators as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def gain(x: Column, g: float) -> Column:
    return x * F.lit(float(g))


def gain_fixed(code: Column, g: int, frac: int = 15, bits: int = 16) -> Column:
    """Fixed point: bias, arithmetic shift (half towards plus infinity), saturate."""
    product = code.cast("long") * F.lit(g) + F.lit(1 << (frac - 1))
    return clamp(F.shiftright(product, frac), -(1 << (bits - 1)), (1 << (bits - 1)) - 1).cast("long")


def trim(x: Column, db: float) -> Column:
    return x * F.lit(10.0 ** (db / 20.0))


def soft_clip(x: Column, drive: float) -> Column:
    u = clamp(x * F.lit(float(drive)), -1.0, 1.0)
    return (u - u * u * u / 3.0) / F.lit(float(drive))


def feature_map(x: Column, scale: float, bias: float, lo: float, hi: float) -> Column:
    return clamp(x * F.lit(float(scale)) + F.lit(float(bias)), lo, hi)


def wrap_phase(p: Column) -> Column:
    return p - F.floor(p)


def quantise(x: Column, frac: int = 15) -> Column:
    """Float to fixed code, rounding half away from zero, saturating."""
    top = 1 << frac
    return clamp(F.round(x * F.lit(float(top))), -top, top - 1).cast("long")


#: name: (signed, bits, float)
PCM = {"u8": (False, 8), "s8": (True, 8), "s16": (True, 16), "u16": (False, 16), "s24": (True, 24), "s32": (True, 32), "u32": (False, 32)}


def pcm_decode(code: Column, form: str) -> Column:
    signed, bits = PCM[form]
    mid = float(1 << (bits - 1))
    return (code.cast("double") if signed else code.cast("double") - mid) / mid


def pcm_encode(x: Column, form: str, dither: Column | None = None) -> Column:
    """Hard saturation, never wraps."""
    signed, bits = PCM[form]
    mid = float(1 << (bits - 1))
    v = (x * mid if signed else (x + 1.0) * mid) + (F.lit(0.0) if dither is None else dither)
    lo, hi = (-mid, mid - 1) if signed else (0.0, 2 * mid - 1)
    return clamp(F.round(v), lo, hi).cast("long")


def pcm_bytes(code: Column, form: str, little: bool = True) -> Column:
    """The code's bytes in either byte order."""
    _, bits = PCM[form]
    raw = F.unhex(F.lpad(F.hex(F.pmod(code.cast("long"), F.lit(1 << bits))), bits // 4, "0"))
    return F.unhex(F.concat(*[F.substring(F.hex(raw), 2 * k + 1, 2) for k in reversed(range(bits // 8))])) if little else raw


def tpdf(seed: int, *keys: str) -> Column:
    """Triangular dither from two uniform draws that the row's keys decide, so it is the same under any partitioning."""
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed + k), *keys), F.lit(1 << 32)) / float(1 << 32)
    return draw(0) + draw(1) - 1.0


def polyblep(p: Column, dt: float) -> Column:
    """The residual that smooths a step at phase 0."""
    a, b = p / dt, (p - 1.0) / dt
    return F.when(p < dt, a + a - a * a - 1.0).when(p > 1.0 - dt, b * b + b + b + 1.0).otherwise(0.0)


def phase(n: Column, increment: float) -> Column:
    return wrap_phase(n * F.lit(float(increment)))


def wave(p: Column, form: str) -> Column:
    return {
        "sine": lambda: F.sin(2 * math.pi * p),
        "triangle": lambda: 1.0 - 4.0 * F.abs(p - 0.5),
        "saw": lambda: 2.0 * p - 1.0,
        "square": lambda: F.when(p < 0.5, 1.0).otherwise(-1.0),
    }[form]()
