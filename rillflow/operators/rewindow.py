"""Hopping count windows, spectra and wavelets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions.ship import ship
from rillflow.functions.tables import hann


def frames(df: DataFrame, frame: int, hop: int, window: bool = True) -> DataFrame:
    """(signal_id, hop, s): frame h covers n in [(h+1) hop - frame, (h+1) hop), zeros before the start, times a periodic
    Hann window; only whole hops. A hop is complete when its last sample is, so no count of the signal is needed."""
    if frame & (frame - 1) or not 0 < hop <= frame:
        raise ValueError("frame must be a power of two and hop at most frame")
    return cut(df, frame, hop, window)


def cut(df: DataFrame, frame: int, hop: int, window: bool = True) -> DataFrame:
    """frames() of any length."""
    first, last = F.expr(f"n div {hop}"), F.expr(f"(n + {frame}) div {hop} - 1")
    at = df.select("signal_id", "n", "x", F.explode(F.sequence(first, last)).alias("hop"))
    at = at.withColumn("j", (F.col("n") - ((F.col("hop") + 1) * hop - frame)).cast("int"))
    got = at.groupBy("signal_id", "hop").agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("g"), F.max("j").alias("top"))
    got = got.where(F.col("top") == frame - 1)
    pad = F.concat(F.array_repeat(F.lit(0.0), frame - F.size("g")), F.transform("g", lambda v: v["x"]))
    w = F.array(*[F.lit(float(v)) for v in hann(frame)])
    return got.select("signal_id", "hop", (F.zip_with(pad, w, lambda a, b: a * b) if window else pad).alias("s"))


def _rfft(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        s = np.array(b.column(2).to_pylist(), float)
        z = np.fft.rfft(s, axis=1) if b.num_rows else np.empty((0, 0), complex)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(z.real), pa.list_(pa.float64())), pa.array(list(z.imag), pa.list_(pa.float64()))], names=["signal_id", "hop", "re", "im"])


def spectrum(fr: DataFrame) -> DataFrame:
    """(signal_id, hop, re, im): the unnormalised half spectrum of each frame."""
    ship(fr.sparkSession)
    return fr.select("signal_id", "hop", "s").mapInArrow(_rfft, "signal_id string, hop long, re array<double>, im array<double>")


def stft(df: DataFrame, frame: int, hop: int) -> DataFrame:
    return spectrum(frames(df, frame, hop))


def relational_dft(fr: DataFrame, frame: int) -> DataFrame:
    """The same spectrum by higher-order functions alone; for short frames."""
    def part(f, k):
        row = F.array(*[F.lit(float(f(2 * math.pi * k * j / frame))) for j in range(frame)])
        return F.aggregate(F.zip_with("s", row, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    bins = range(frame // 2 + 1)
    return fr.select("signal_id", "hop", F.array(*[part(math.cos, k) for k in bins]).alias("re"), F.array(*[part(lambda t: -math.sin(t), k) for k in bins]).alias("im"))


def istft(spec: DataFrame, frame: int, hop: int) -> DataFrame:
    """Inverse transform and overlap-add without a synthesis window; hop samples per frame."""
    ship(spec.sparkSession)

    def inverse(it):
        for b in it:
            z = np.array(b.column(2).to_pylist(), float) + 1j * np.array(b.column(3).to_pylist(), float)
            s = np.fft.irfft(z, frame, axis=1) if b.num_rows else np.empty((0, frame))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(s), pa.list_(pa.float64()))], names=["signal_id", "hop", "s"])

    s = spec.select("signal_id", "hop", "re", "im").mapInArrow(inverse, "signal_id string, hop long, s array<double>")
    last = spec.groupBy("signal_id").agg((F.max("hop") + 1).alias("hops"))
    parts = s.select("signal_id", "hop", F.posexplode("s").alias("j", "v")).select("signal_id", (F.col("hop") * hop + F.col("j")).alias("n"), "v")
    return parts.groupBy("signal_id", "n").agg(F.sum("v").alias("y")).join(last, "signal_id").where(F.col("n") < F.col("hops") * hop).select("signal_id", "n", "y")


def power(spec: DataFrame) -> DataFrame:
    return spec.select("signal_id", "hop", F.zip_with("re", "im", lambda a, b: a * a + b * b).alias("p"))


def spectral_gate(spec: DataFrame, threshold: float) -> DataFrame:
    """Bins with re^2 + im^2 >= threshold^2 stay, the others are zero."""
    z = F.arrays_zip("re", "im")
    keep = lambda v: v["re"] * v["re"] + v["im"] * v["im"] >= threshold**2
    return spec.withColumn("_z", z).select("signal_id", "hop", F.transform("_z", lambda v: F.when(keep(v), v["re"]).otherwise(0.0)).alias("re"), F.transform("_z", lambda v: F.when(keep(v), v["im"]).otherwise(0.0)).alias("im"))


def spectral_eq(spec: DataFrame, gains: list[float]) -> DataFrame:
    g = F.array(*[F.lit(float(v)) for v in gains])
    return spec.select("signal_id", "hop", F.zip_with("re", g, lambda a, b: a * b).alias("re"), F.zip_with("im", g, lambda a, b: a * b).alias("im"))


def haar(df: DataFrame, col: str = "x") -> DataFrame:
    """One analysis stage (signal_id, m, lo, hi); an odd tail is dropped."""
    pick = lambda k: F.max(F.when(F.col("n") % 2 == k, F.col(col)))
    two = df.groupBy("signal_id", F.expr("n div 2").alias("m")).agg(pick(0).alias("a"), pick(1).alias("b")).where("b is not null")
    r = 2**-0.5
    return two.select("signal_id", "m", ((F.col("a") + F.col("b")) * r).alias("lo"), ((F.col("a") - F.col("b")) * r).alias("hi"))


def haar_inverse(df: DataFrame) -> DataFrame:
    r = 2**-0.5
    both = F.array((F.col("lo") + F.col("hi")) * r, (F.col("lo") - F.col("hi")) * r)
    return df.select("signal_id", "m", F.posexplode(both).alias("k", "y")).select("signal_id", (F.col("m") * 2 + F.col("k")).alias("n"), "y")


def dwt(df: DataFrame, levels: int) -> DataFrame:
    """(signal_id, level, m, c): details of levels 1 .. levels and the last approximation as level levels + 1."""
    out, now = None, df.select("signal_id", "n", "x")
    for level in range(1, levels + 1):
        stage = haar(now)
        band = stage.select("signal_id", F.lit(level).alias("level"), "m", F.col("hi").alias("c"))
        out = band if out is None else out.unionByName(band)
        now = stage.select("signal_id", F.col("m").alias("n"), F.col("lo").alias("x"))
    return out.unionByName(now.select("signal_id", F.lit(levels + 1).alias("level"), F.col("n").alias("m"), F.col("x").alias("c")))
