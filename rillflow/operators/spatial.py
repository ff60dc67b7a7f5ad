"""Channel and mixing operators: projections, coefficient joins, labelled zips."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions import tables
from rillflow.functions.elementwise import gain_fixed


def pan(x: Column, position: float) -> tuple[Column, Column]:
    """Constant power: angle (p + 1) pi / 4."""
    t = (position + 1) * math.pi / 4
    return x * math.cos(t), x * math.sin(t)


def mix_matrix(m: Sequence[Sequence[float]], channels: Sequence[Column]) -> list[Column]:
    return [reduce(lambda a, b: a + b, [c * F.lit(float(v)) for v, c in zip(row, channels, strict=True)]) for row in m]


def balance(left: Column, right: Column, b: float) -> tuple[Column, Column]:
    """Attenuates one side only."""
    return left * min(1.0, 1.0 - b), right * min(1.0, 1.0 + b)


def width(left: Column, right: Column, w: float) -> tuple[Column, Column]:
    mid, side = (left + right) / 2, (left - right) / 2
    return mid + w * side, mid - w * side


def vbap(azimuth: float, speakers: Sequence[float]) -> list[float]:
    """Gains of the speaker pair that encloses a direction (degrees): pairs solved, both gains not under zero, the narrowest
    arc wins, unit power."""
    best, unit = None, lambda a: np.array([math.cos(math.radians(a)), math.sin(math.radians(a))])
    for i in range(len(speakers)):
        for j in range(i + 1, len(speakers)):
            m = np.stack([unit(speakers[i]), unit(speakers[j])], axis=1)
            if abs(np.linalg.det(m)) < 1e-9:
                continue
            g = np.linalg.solve(m, unit(azimuth))
            if min(g) >= -1e-9:
                arc = float(unit(speakers[i]) @ unit(speakers[j]))
                if best is None or arc > best[0] + 1e-12:
                    best = (arc, i, j, g)
    out = [0.0] * len(speakers)
    if best:
        _, i, j, g = best
        g = np.maximum(g, 0) / np.linalg.norm(np.maximum(g, 0))
        out[i], out[j] = float(g[0]), float(g[1])
    return out


def encode(x: Column, azimuth: float, elevation: float, order: int) -> list[Column]:
    return [x * v for v in tables.sh(azimuth, elevation, order)]


def decode(channels: Sequence[Column], directions: Sequence[tuple[float, float]], order: int) -> list[Column]:
    n = len(directions)
    return [reduce(lambda a, b: a + b, [c * (y / n) for c, y in zip(channels, tables.sh(a, e, order), strict=True)]) for a, e in directions]


def concat(inputs: dict[str, DataFrame], on: Sequence[str] = ("signal_id", "hop")) -> DataFrame:
    """A labelled zip: each input has the keys and one more column, which gets the label. Same keys everywhere, inner join."""
    named = []
    for label, df in inputs.items():
        rest = [c for c in df.columns if c not in on]
        if len(rest) != 1:
            raise TypeError(f"input {label} must have one column besides {', '.join(on)}")
        named.append(df.select(*on, F.col(rest[0]).alias(label)))
    return reduce(lambda a, b: a.join(b, list(on)), named).select(*on, *inputs)


def summing_mixer(*inputs: DataFrame) -> DataFrame:
    both = reduce(DataFrame.unionByName, [d.select("signal_id", "n", "x") for d in inputs])
    return both.groupBy("signal_id", "n").agg(F.sum("x").alias("y"))


def matrix_router(df: DataFrame, m: Sequence[Sequence[float]]) -> DataFrame:
    """(signal_id, n, ch, x) by a coefficient table: (signal_id, n, out, y)."""
    rows = [(j, k, float(v)) for j, row in enumerate(m) for k, v in enumerate(row)]
    coeff = F.broadcast(df.sparkSession.createDataFrame(rows, "out int, ch int, c double"))  # the matrix's size
    return df.join(coeff, "ch").groupBy("signal_id", "n", "out").agg(F.sum(F.col("x") * F.col("c")).alias("y"))


def _stored(wide: Column, bits: int) -> Column:
    return F.greatest(F.lit(-(1 << (bits - 1))), F.least(F.lit((1 << (bits - 1)) - 1), wide)).cast("long")


def mix_fixed(codes: Sequence[Column], bits: int = 16) -> Column:
    """A sum of codes that saturates once, at the end."""
    return _stored(reduce(lambda a, b: a + b, [c.cast("long") for c in codes]), bits)


def route_fixed(m: Sequence[Sequence[float]], codes: Sequence[Column], bits: int = 16) -> list[Column]:
    """A matrix with bits - 2 fraction bits: a wide sum, one rounding shift, saturation."""
    frac = bits - 2
    rows = [[round(v * (1 << frac)) for v in row] for row in m]
    total = lambda row: reduce(lambda a, b: a + b, [c.cast("long") * v for v, c in zip(row, codes, strict=True)])
    return [_stored(F.shiftright(total(row) + (1 << (frac - 1)), frac), bits) for row in rows]


def pan_fixed(code: Column, position: float, bits: int = 16) -> tuple[Column, Column]:
    """Constant power by gains with bits - 1 fraction bits."""
    t, top = (position + 1) * math.pi / 4, 1 << (bits - 1)
    gains = [min(top - 1, round(v * top)) for v in (math.cos(t), math.sin(t))]
    return tuple(gain_fixed(code, g, bits - 1, bits) for g in gains)


def dry_wet(dry: DataFrame, wet: DataFrame, mix: float) -> DataFrame:
    m = min(1.0, max(0.0, mix))
    both = dry.select("signal_id", "n", F.col("x").alias("d")).join(wet.select("signal_id", "n", F.col("x").alias("w")), ["signal_id", "n"])
    return both.select("signal_id", "n", ((1 - m) * F.col("d") + m * F.col("w")).alias("y"))


def interleave(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    c = len(channels)
    return df.select("signal_id", "n", F.posexplode(F.array(*channels)).alias("ch", "x")).select("signal_id", (F.col("n") * c + F.col("ch")).alias("pos"), "x")


def deinterleave(df: DataFrame, names: Sequence[str], order: Sequence[int] | None = None) -> DataFrame:
    """Frame-major samples (signal_id, pos, x) to one column per channel; order[k] is where channel k lies."""
    c = len(names)
    at = order or range(c)
    pick = [F.max(F.when(F.col("pos") % c == p, F.col("x"))).alias(k) for k, p in zip(names, at, strict=True)]
    return df.groupBy("signal_id", F.expr(f"pos div {c}").alias("n")).agg(*pick)


def fdn_matrix(n: int, gain: float = 0.85) -> list[list[float]]:
    return (gain * tables.hadamard(n)).tolist()


def scan_band(df: DataFrame, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """The band of bins that holds the middle of a signal's mean power."""
    mean = df.select("signal_id", F.posexplode("p").alias("k", "v")).groupBy("signal_id", "k").agg(F.avg("v").alias("v"))
    run = F.sum("v").over(Window.partitionBy("signal_id").orderBy("k")) / F.sum("v").over(Window.partitionBy("signal_id"))
    at = mean.withColumn("c", run)
    return at.groupBy("signal_id").agg(F.min(F.when(F.col("c") >= lo, F.col("k"))).alias("lo"), F.min(F.when(F.col("c") >= hi, F.col("k"))).alias("hi"))
