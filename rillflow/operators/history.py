"""Operators with a bounded history: window frames and index joins over (signal_id, n, x)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions import tables


def order():
    """The one window that all operators of a flow share, so Catalyst sorts once."""
    return Window.partitionBy("signal_id").orderBy("n")


def delay(df: DataFrame, length: int, col: str = "x", out: str = "y") -> DataFrame:
    """out[n] = in[n - length], zeros first."""
    return df.withColumn(out, F.lag(col, length, 0.0).over(order()) if length else F.col(col))


def fir(df: DataFrame, taps: Sequence[float], out: str = "y") -> DataFrame:
    """A sum of lags in one window pass up to 64 taps; more by one array over the frame."""
    if len(taps) <= 64:
        terms = [F.coalesce(F.lag("x", k, 0.0).over(order()), F.lit(0.0)) * F.lit(float(c)) for k, c in enumerate(taps)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return df.withColumn(out, total)
    past = F.collect_list("x").over(order().rowsBetween(-(len(taps) - 1), 0))
    held = df.withColumn("_h", F.reverse(past))
    c = F.slice(F.array(*[F.lit(float(t)) for t in taps]), F.lit(1), F.size("_h"))
    return held.withColumn(out, F.aggregate(F.zip_with("_h", c, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)).drop("_h")


def fir_fixed(df: DataFrame, taps: Sequence[int], frac: int = 15, bits: int = 16, col: str = "code", out: str = "y") -> DataFrame:
    """Integer taps: wide sum, one rounding shift, saturate."""
    total = F.lit(0).cast("long")
    for k, c in enumerate(taps):
        total = total + F.coalesce(F.lag(col, k, 0).over(order()), F.lit(0)) * F.lit(int(c))
    y = F.shiftright(total + F.lit(1 << (frac - 1)), frac)
    return df.withColumn(out, F.greatest(F.lit(-(1 << (bits - 1))), F.least(F.lit((1 << (bits - 1)) - 1), y)).cast("long"))


def gather(df: DataFrame, out_rows: DataFrame, index: Column, col: str = "x") -> DataFrame:
    """out_rows with the sample at an index (0 outside): an equi-join, so no window is needed."""
    src = df.select("signal_id", F.col("n").alias("_i"), F.col(col).alias("_v"))
    return out_rows.withColumn("_i", index.cast("long")).join(src, ["signal_id", "_i"], "left").withColumn("_v", F.coalesce("_v", F.lit(0.0))).drop("_i")


def varispeed(df: DataFrame, ratio: float) -> DataFrame:
    """Constant ratio of output to input rate: y[j] = x[i-1] + f (x[i] - x[i-1]) with i = floor(j / ratio)."""
    if not 0.25 <= ratio <= 4:
        raise ValueError("ratio must lie in 1/4 .. 4")
    prev = df.withColumn("p", F.lag("x", 1, 0.0).over(order()))
    # input sample i answers for the outputs j with floor(j / ratio) = i
    lo, hi = F.ceil(F.col("n") * ratio), F.ceil((F.col("n") + 1) * ratio) - 1
    some = prev.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").select("signal_id", "n", "x", "p", F.explode(F.sequence("lo", "hi")).alias("j"))
    f = F.col("j") / F.lit(float(ratio)) - F.col("n")
    return some.select("signal_id", F.col("j").alias("n"), (F.col("p") + f * (F.col("x") - F.col("p"))).alias("y"))


def planar_delay(df: DataFrame, length: int, channels: Sequence[str]) -> DataFrame:
    """Every channel column late by length, zeros first."""
    late = [F.lag(c, length, 0.0).over(order()).alias(c) if length else F.col(c) for c in channels]
    return df.select("signal_id", "n", *late)


def chorus(df: DataFrame, base: float, depth: float, rate: float, mix: float, top: int) -> DataFrame:
    """A swept linear-interpolated tap, dry/wet; feed-forward."""
    d = F.greatest(F.lit(1.0), F.least(F.lit(top - 2.0), F.lit(base) + F.lit(depth) * F.sin(2 * 3.141592653589793 * (F.col("n") * rate - F.floor(F.col("n") * rate)))))
    at = df.withColumn("d", d).withColumn("w", F.floor("d")).withColumn("f", F.col("d") - F.col("w"))
    one = gather(df, at, F.col("n") - F.col("w")).withColumnRenamed("_v", "a")
    two = gather(df, one, F.col("n") - F.col("w") - 1)
    wet = F.col("a") * (1 - F.col("f")) + F.col("_v") * F.col("f")
    return two.select("signal_id", "n", ((1 - mix) * F.col("x") + mix * wet).alias("y"))


def resample(df: DataFrame, up: int, down: int, proto: Sequence[float], shift: int = 0) -> DataFrame:
    """y[j] = sum of proto[t] x[(j down + shift - t) / up] over the t that divide. A sample meets only the taps t = shift - n up
    modulo down, each in one output; shift > 0 takes so much of the filter's delay away, shift < 0 adds delay."""
    first = F.pmod(F.lit(shift) - F.col("n") * up, F.lit(down))
    taps = F.array(*[F.lit(float(c)) for c in proto])
    met = df.select("signal_id", "n", "x", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit((len(proto) - 1) // down)), lambda k: first + k * down), lambda t: t < len(proto))).alias("t"))
    j = F.expr(f"(n * {up} + t - {shift}) div {down}")
    last = df.groupBy("signal_id").agg((F.max("n") + 1).alias("len"))
    y = met.where(F.expr(f"n * {up} + t >= {shift}")).groupBy("signal_id", j.alias("j")).agg(F.sum(F.col("x") * F.get(taps, F.col("t").cast("int"))).alias("y"))
    return y.join(last, "signal_id").where(F.col("j") * down < F.col("len") * up).select("signal_id", F.col("j").alias("n"), "y")


def streaming_resample(df: DataFrame, up: int, down: int, half: int) -> DataFrame:
    """The converter that computes an output before it takes the inputs of that output: the polyphase sum, one input late."""
    return resample(df, up, down, tables.resample_proto(up, down, half * max(up, down)), -up)


def resample_to(df: DataFrame, rate_in: int, rate_out: int) -> DataFrame:
    """Zero-phase rational conversion between two rates."""
    common = math.gcd(rate_in, rate_out)
    up, down = rate_out // common, rate_in // common
    if up == down:
        return df.select("signal_id", "n", F.col("x").alias("y"))
    return resample(df, up, down, tables.polyphase_proto(up, down), 10 * max(up, down))


def bank(df: DataFrame, bands: Sequence[Sequence[float]], out: str = "p") -> DataFrame:
    """A bank of FIR filters: one array per sample."""
    lags = [F.coalesce(F.lag("x", k, 0.0).over(order()), F.lit(0.0)) for k in range(len(bands[0]))]
    held = df.withColumn("_h", F.array(*lags))
    sums = [F.aggregate(F.zip_with("_h", F.array(*[F.lit(float(c)) for c in b]), lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v) for b in bands]
    return held.withColumn(out, F.array(*sums)).drop("_h")


def convolve(df: DataFrame, ir: Sequence[float]) -> DataFrame:
    """Linear convolution with a long impulse response, zero latency."""
    return fir(df, ir)
