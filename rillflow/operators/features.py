"""Per-window features over (signal_id, hop, p ARRAY<DOUBLE>) or frames (s): one value per hop, silent frames give 0."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions import tables
from rillflow.functions.ship import ship

def total(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def indexed(p: str = "p") -> Column:
    """sum over k of k p_k needs k: transform with its index."""
    return F.transform(p, lambda v, k: k.cast("double") * v)


def _safe(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(0.0)


def rms(p: str = "p") -> Column:
    return F.sqrt(total(p) / F.size(p))


def dominant(p: str = "p") -> Column:
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def centroid(p: str = "p") -> Column:
    return _safe(total(indexed(p)), total(p))


def hfc(p: str = "p") -> Column:
    return total(indexed(p))


def flatness(p: str = "p") -> Column:
    logs = total(F.transform(p, lambda v: F.log(F.greatest(v, F.lit(1e-20))))) / F.size(p)
    return F.when(total(p) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(logs) / (total(p) / F.size(p))))).otherwise(0.0)


def entropy(p: str = "p") -> Column:
    # -sum q ln q with q = p / t is ln t - sum p ln p / t
    inner = total(F.transform(p, lambda v: F.when(v > 0, v * F.log(v)).otherwise(0.0)))
    return F.when(total(p) > 0, (F.log(total(p)) - inner / total(p)) / F.log(F.size(p).cast("double"))).otherwise(0.0)


def crest(p: str = "p") -> Column:
    return _safe(F.array_max(p), total(p) / F.size(p))


def moment(order: int, c: Column, p: str = "p") -> Column:
    return total(F.transform(p, lambda v, k: F.pow(k - c, F.lit(float(order))) * v))


def spread(df: DataFrame) -> DataFrame:
    """spread, skewness and kurtosis (raw) about the centroid: two passes over the array."""
    held = df.withColumn("_c", centroid()).withColumn("_t", total("p"))
    held = held.withColumn("spread", F.sqrt(_safe(moment(2, F.col("_c")), F.col("_t"))))
    std = lambda k: F.when((F.col("_t") > 0) & (F.col("spread") > 0), moment(k, F.col("_c")) / F.col("_t") / F.pow("spread", F.lit(float(k)))).otherwise(0.0)
    return held.withColumn("skewness", std(3)).withColumn("kurtosis", std(4)).drop("_c", "_t")


def rolloff(share: float = 0.85, p: str = "p") -> Column:
    """The least k whose cumulative power reaches a share of all; one fold."""
    t = total(p)
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("k"), F.lit(-1).alias("at"))
    step = lambda s, v: F.struct((s["c"] + v).alias("c"), (s["k"] + 1).alias("k"), F.when((s["at"] < 0) & (s["c"] + v >= share * t), s["k"]).otherwise(s["at"]).alias("at"))
    return F.when(t > 0, F.aggregate(p, zero, step, lambda s: s["at"])).otherwise(0).cast("int")


def flux(df: DataFrame, out: str = "flux") -> DataFrame:
    """sqrt of the summed squares of rises since the hop before; the first is against zeros."""
    before = F.coalesce(F.lag("p", 1).over(Window.partitionBy("signal_id").orderBy("hop")), F.transform("p", lambda v: F.lit(0.0)))
    rise = F.zip_with("p", "_b", lambda a, b: F.pow(F.greatest(F.lit(0.0), a - b), F.lit(2.0)))
    return df.withColumn("_b", before).withColumn(out, F.sqrt(total(rise))).drop("_b")


def mat(m: np.ndarray, p: Column | str) -> Column:
    return F.array(*[total(F.zip_with(p, F.array(*[F.lit(float(v)) for v in row]), lambda a, b: a * b)) for row in m])


def mfcc(df: DataFrame, bins: int, n: int = 20, bands: int = 26) -> DataFrame:
    logs = F.transform(mat(tables.mel_bank(bins, bands), "p"), lambda e: F.log(F.greatest(e, F.lit(1e-10))))
    return df.withColumn("_e", logs).withColumn("mfcc", mat(tables.dct(n, bands), F.col("_e"))).drop("_e")


def pitch_class(bins: int, rate: float = 48000.0) -> list[int]:
    """The pitch class of each bin, -1 for bin 0 and below 20 Hz."""
    f = np.arange(bins) * rate / (2 * (bins - 1))
    return [int(np.floor(12 * np.log2(x / 440) + 0.5)) % 12 if x >= 20 else -1 for x in f]


def chroma(df: DataFrame, bins: int, rate: float = 48000.0) -> DataFrame:
    own = pitch_class(bins, rate)
    fold = F.array(*[sum((F.col("p")[k] for k in range(bins) if own[k] == c), F.lit(0.0)) for c in range(12)])
    return df.withColumn("_f", fold).withColumn("chroma", F.transform("_f", lambda v: F.when(F.array_max("_f") > 0, v / F.array_max("_f")).otherwise(0.0))).drop("_f")


def contrast_edges(bins: int, bands: int) -> list[int]:
    """Geometric band edges from 1 to bins - 1; the last is exclusive."""
    return [int(math.floor((bins - 1) ** (k / bands) + 0.5)) for k in range(bands)] + [bins - 1]


def contrast(df: DataFrame, bins: int, bands: int) -> DataFrame:
    e = contrast_edges(bins, bands)
    log = lambda v: F.log(v + 1e-10)
    part = lambda a, b: F.slice("p", a + 1, b - a)
    return df.withColumn("contrast", F.array(*[log(F.array_max(part(a, b))) - log(F.array_min(part(a, b))) if b > a else F.lit(0.0) for a, b in zip(e, e[1:])]))


def zcr(s: str = "s") -> Column:
    """Sign changes per step; zero counts as non-negative."""
    turn = F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: F.when((a < 0) != (b < 0), 1.0).otherwise(0.0))
    return total(turn) / (F.size(s) - 1)


def teo(s: str = "s") -> Column:
    """Mean of s[i]^2 - s[i-1] s[i+1] over the interior."""
    m = F.size(s) - 2
    part = lambda k: F.slice(s, F.lit(k), m)
    inner = F.zip_with(F.transform(part(2), lambda v: v * v), F.zip_with(part(1), part(3), lambda a, b: a * b), lambda a, b: a - b)
    return total(inner) / m


def peak(s: str = "s") -> Column:
    return F.array_max(F.transform(s, lambda v: F.least(F.lit(1.0), F.abs(v))))


def over_hops(df: DataFrame, fn, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.groupBy("signal_id").applyInPandas(fn, schema)


def ballistic(df: DataFrame, attack: float = 0.6, release: float = 0.05) -> DataFrame:
    """A rise-and-fall envelope of each frame's peak."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hop")
        e, out = 0.0, []
        for v in pdf["v"]:
            e += (attack if v > e else release) * (v - e)
            out.append(e)
        return pd.DataFrame({"signal_id": pdf["signal_id"], "hop": pdf["hop"], "envelope": out})

    return over_hops(df.select("signal_id", "hop", peak().alias("v")), one, "signal_id string, hop long, envelope double")


def dominant_hysteresis(df: DataFrame, keep: float = 0.7, margin: float = 1.5) -> DataFrame:
    """The held strongest bin of the smoothed power, bin 0 before any; it changes only for one stronger by the margin."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hop")
        s, held, out = 0.0, 0, []
        for p in pdf["p"]:
            s = keep * s + (1 - keep) * np.asarray(p, float)
            c = int(np.argmax(s))
            if s[c] > margin * s[held]:
                held = c
            out.append(held)
        return pd.DataFrame({"signal_id": pdf["signal_id"], "hop": pdf["hop"], "bin": out})

    return over_hops(df.select("signal_id", "hop", "p"), one, "signal_id string, hop long, bin int")
