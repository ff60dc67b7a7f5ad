"""Recurrences over (signal_id, n, x): a kernel maps arrays and a state to arrays and a state; batch runs it once per signal,
long signals by chunks with a lead-in, and streams by batch with the state kept."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.ship import ship

Kernel = Callable[..., tuple]


def run(df: DataFrame, kernel: Kernel, cols: tuple[str, ...] = ("x",), out: tuple[str, ...] = ("y",), kind: str = "double") -> DataFrame:
    """kernel(state or None, *arrays) -> (state, *arrays), over each signal in order of n."""
    ship(df.sparkSession)
    schema = "signal_id string, n long, " + ", ".join(f"{k} {kind}" for k in out)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        _, *ys = kernel(None, *(pdf[c].to_numpy() for c in cols))
        return pd.DataFrame({"signal_id": pdf["signal_id"].to_numpy(), "n": pdf["n"].to_numpy()} | dict(zip(out, ys, strict=True)))

    return df.select("signal_id", "n", *cols).groupBy("signal_id").applyInPandas(one, schema)


def run_chunked(df: DataFrame, kernel: Kernel, length: int, lead: int, cols: tuple[str, ...] = ("x",), out: tuple[str, ...] = ("y",)) -> DataFrame:
    """One long signal in many tasks: chunks of length samples, each after lead samples that are thrown away. Exact once the
    kernel has forgotten its state after lead samples."""
    ship(df.sparkSession)
    schema = "signal_id string, n long, " + ", ".join(f"{k} double" for k in out)
    chunk = F.expr(f"n div {length}")
    own = df.select("signal_id", "n", *cols, F.explode(F.when((F.col("n") % length >= length - lead), F.array(chunk, chunk + 1)).otherwise(F.array(chunk))).alias("chunk"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        _, *ys = kernel(None, *(pdf[c].to_numpy() for c in cols))
        keep = (pdf["n"] // length == pdf["chunk"]).to_numpy()
        return pd.DataFrame({"signal_id": pdf["signal_id"].to_numpy()[keep], "n": pdf["n"].to_numpy()[keep]} | {k: y[keep] for k, y in zip(out, ys, strict=True)})

    return own.groupBy("signal_id", "chunk").applyInPandas(one, schema)


def one_pole(a: float) -> Kernel:
    def kernel(state, x):
        y, out = state or 0.0, np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            y += a * (v - y)
            out[i] = y
        return y, out

    return kernel


def one_pole_ramped() -> Kernel:
    """y += a (x - y) with an a for each sample (second input)."""

    def kernel(state, x, a):
        y, out = state or 0.0, np.empty(len(x))
        for i, (v, c) in enumerate(zip(x.tolist(), a.tolist(), strict=True)):
            y += c * (v - y)
            out[i] = y
        return y, out

    return kernel


def state_variable_ramped(mode: str = "lowpass") -> Kernel:
    """The topology-preserving filter with a cutoff and a quality for each sample (second and third input)."""

    def kernel(state, x, fc, q):
        s1, s2 = state or (0.0, 0.0)
        out = np.empty(len(x))
        g, k = np.tan(np.pi * fc), 1 / q
        d = 1 / (1 + g * (g + k))
        for i, (v, gi, ki, di) in enumerate(zip(x.tolist(), g.tolist(), k.tolist(), d.tolist(), strict=True)):
            hp = (v - (gi + ki) * s1 - s2) * di
            bp = gi * hp + s1
            lp = gi * bp + s2
            s1, s2 = gi * hp + bp, gi * bp + lp
            out[i] = {"lowpass": lp, "bandpass": bp, "highpass": hp}[mode]
        return (s1, s2), out

    return kernel


def biquad(b0: float, b1: float, b2: float, a1: float, a2: float) -> Kernel:
    """Transposed direct form 2."""

    def kernel(state, x):
        z1, z2 = state or (0.0, 0.0)
        out = np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            y = b0 * v + z1
            z1, z2 = b1 * v + z2 - a1 * y, b2 * v - a2 * y
            out[i] = y
        return (z1, z2), out

    return kernel


def biquad_fixed(b0: int, b1: int, b2: int, a1: int, a2: int, bits: int = 16) -> Kernel:
    """Direct form 1 on integer codes: coefficients with bits - 3 fraction bits, one rounding shift, saturation."""
    frac, lo, hi = bits - 3, -(1 << (bits - 1)), (1 << (bits - 1)) - 1

    def kernel(state, x):
        x1, x2, y1, y2 = state or (0, 0, 0, 0)
        out = np.empty(len(x), np.int64)
        for i, v in enumerate(x.tolist()):
            v = int(v)
            y = max(lo, min(hi, (b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2 + (1 << (frac - 1))) >> frac))
            x1, x2, y1, y2 = v, x1, y, y1
            out[i] = y
        return (x1, x2, y1, y2), out

    return kernel


def state_variable(fc: float, q: float, mode: str = "lowpass") -> Kernel:
    """Topology-preserving state variable filter."""
    g, k = float(np.tan(np.pi * fc)), 1 / q

    def kernel(state, x):
        s1, s2 = state or (0.0, 0.0)
        out = np.empty(len(x))
        d = 1 / (1 + g * (g + k))
        for i, v in enumerate(x.tolist()):
            hp = (v - (g + k) * s1 - s2) * d
            bp = g * hp + s1
            lp = g * bp + s2
            s1, s2 = g * hp + bp, g * bp + lp
            out[i] = {"lowpass": lp, "bandpass": bp, "highpass": hp}[mode]
        return (s1, s2), out

    return kernel


def ladder(cutoff: float, resonance: float) -> Kernel:
    def kernel(state, x):
        s, out = list(state or (0.0,) * 4), np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            u = v - resonance * s[3]
            for k in range(4):
                s[k] += cutoff * (u - s[k])
                u = s[k]
            out[i] = u
        return tuple(s), out

    return kernel


def comb(d: int, feedback: float) -> Kernel:
    def kernel(state, x):
        held = np.concatenate([np.zeros(d) if state is None else state, np.zeros(len(x))])
        for i, v in enumerate(x.tolist()):
            held[d + i] = v + feedback * held[i]
        return held[len(held) - d :], held[d:]

    return kernel


def karplus_strong(d: int, damp: float = 0.996) -> Kernel:
    def kernel(state, x):
        held = np.concatenate([np.zeros(d + 1) if state is None else state, np.zeros(len(x))])
        for i, v in enumerate(x.tolist()):
            held[d + 1 + i] = v + 0.5 * damp * (held[i + 1] + held[i])
        return held[len(held) - d - 1 :], held[d + 1 :]

    return kernel


def allpass(d: int, g: float) -> Kernel:
    def kernel(state, x):
        ring = np.concatenate([np.zeros(d) if state is None else state, np.zeros(len(x))])
        out = np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            out[i] = -g * v + ring[i]
            ring[d + i] = v + g * out[i]
        return ring[len(ring) - d :], out

    return kernel


def flanger(top: int, base: float, depth: float, rate: float, feedback: float, mix: float) -> Kernel:
    """Chorus with the wet signal fed back into the line."""

    def kernel(state, x):
        ring, n0 = state or (np.zeros(top), 0)
        line = np.concatenate([ring, np.zeros(len(x))])
        out = np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            p = (n0 + i) * rate
            d = min(max(base + depth * np.sin(2 * np.pi * (p - np.floor(p))), 1.0), top - 2.0)
            w = int(d)
            at = top + i - w
            wet = line[at] * (1 - d + w) + line[at - 1] * (d - w)
            line[top + i] = v + feedback * wet
            out[i] = (1 - mix) * v + mix * wet
        return (line[len(line) - top :], n0 + len(x)), out

    return kernel


def envelope(attack: float, release: float) -> Kernel:
    def kernel(state, x):
        e, out = state or 0.0, np.empty(len(x))
        for i, v in enumerate(np.abs(x).tolist()):
            e += (attack if v > e else release) * (v - e)
            out[i] = e
        return e, out

    return kernel


def dynamics(kind: str, attack: float, release: float, threshold: float, ratio: float = 4.0, makeup: float = 1.0) -> Kernel:
    """compressor, limiter or expander: a gain from the followed envelope, times the input. Second output: the gain."""

    def kernel(state, x):
        state, e = envelope(attack, release)(state, x)
        r = np.maximum(e, 1e-12) / threshold
        if kind == "compressor":
            g = np.where(r > 1, r ** (1 / ratio - 1), 1.0) * makeup
        elif kind == "limiter":
            g = np.minimum(1.0, 1 / r)
        else:
            g = np.where(r < 1, r ** (ratio - 1), 1.0)
        return state, x * g, g

    return kernel


def nlms(taps: int, mu: float, eps: float = 1e-6, leak: float = 0.0) -> Kernel:
    """Adaptive cancellation of a reference (second input) from the first; leak > 0 is the leaky form."""

    def kernel(state, d, x):
        w, h = state or (np.zeros(taps), np.zeros(taps))
        w, h, out = w.copy(), h.copy(), np.empty(len(d))
        for i in range(len(d)):
            h[1:] = h[:-1]
            h[0] = x[i]
            e = d[i] - w @ h
            w = (1 - leak) * w + mu * e * h / (h @ h + eps)
            out[i] = e
        return (w, h), out

    return kernel


def noise_shaper(bits: int = 16) -> Kernel:
    """First-order error feedback around a rounding quantiser; yields codes."""
    top = float(1 << (bits - 1))

    def kernel(state, x):
        err, out = state or 0.0, np.empty(len(x), np.int64)
        for i, u in enumerate(x.tolist()):
            v = u - err
            c = v * top
            c = min(top - 1, max(-top, np.sign(c) * np.floor(abs(c) + 0.5)))
            err = c / top - v
            out[i] = int(c)
        return err, out

    return kernel


#: The rate controller's gains and the bounds of its ratio of outputs to inputs.
RATE_GAINS, RATE_BOUNDS = (2.0e-4, 2.0e-6), (31 / 32, 33 / 32)


def asynchronous(df: DataFrame, push: int, want: int, cap: int) -> DataFrame:
    """(signal_id, n, y, ratio, starved): each call puts push samples into a queue of cap (a full one takes no more) and reads want.
    The ratio of outputs to inputs is held for a call and follows the queue's fill by a proportional and an integral term, the
    latter bounded to half of the ratio's interval; reads interpolate linearly, an empty queue holds its last sample."""
    ship(df.sparkSession)
    (kp, ki), (lo, hi) = RATE_GAINS, RATE_BOUNDS
    most = (hi - lo) / 2 / ki

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("n")["x"].to_numpy()
        queue, total, frac, a, b, primed = deque(), 0.0, 0.0, 0.0, 0.0, False
        out, ratios, starved = [], [], []
        for at in range(0, len(x), push):
            part = x[at : at + push]
            queue.extend(part[: cap - len(queue)].tolist())
            err = len(queue) - cap / 2
            total = min(most, max(-most, total + err))
            r = min(hi, max(lo, 1 - kp * err - ki * total))
            if not primed:
                a = queue.popleft() if queue else 0.0
                b, primed = queue.popleft() if queue else a, True
            for _ in range(want):
                miss = 0
                while frac >= 1:
                    a, frac = b, frac - 1
                    if queue:
                        b = queue.popleft()
                    else:
                        miss += 1
                out.append(a + frac * (b - a)), ratios.append(r), starved.append(miss)
                frac += 1 / r
        return pd.DataFrame({"signal_id": pdf["signal_id"].iloc[0], "n": np.arange(len(out)), "y": out, "ratio": ratios, "starved": starved})

    return df.select("signal_id", "n", "x").groupBy("signal_id").applyInPandas(one, "signal_id string, n long, y double, ratio double, starved long")


def stretched(x: np.ndarray, frame: int, stretch: float) -> np.ndarray:
    """x some stretch times as long at the same pitch: Hann grains, half overlapping on output, read where they best continue the grain
    before. A grain is sought within one hop of its nominal place, by the normalised correlation of its first half with
    what follows the last grain's first half; of equals the earliest wins. Ends with the first grain that reaches the end of x."""
    if not 0.5 <= stretch <= 2:
        raise ValueError("stretch must lie in 1/2 .. 2")
    hop, win = frame // 2, 0.5 * (1 - np.cos(2 * np.pi * np.arange(frame) / frame))
    lead = 2 * frame
    pad = np.concatenate([np.zeros(lead), x, np.zeros(lead + 2 * frame)])
    segments = np.lib.stride_tricks.sliding_window_view(pad, hop)
    energy = np.append(0, np.cumsum(pad * pad))
    out, tail, pos, nominal, first = [], np.zeros(hop), 0, 0.0, True
    while True:
        if not first:
            centre = int(np.floor(nominal + 0.5))
            c = np.arange(max(centre - hop, -lead), centre + hop + 1) + lead
            want = pad[pos + hop + lead : pos + 2 * hop + lead]
            power = (energy[c + hop] - energy[c]) * (want @ want)
            score = np.where(power > 1e-40, segments[c] @ want / np.sqrt(np.maximum(power, 1e-40)), 0.0)
            # scores that differ by rounding alone are equals
            pos = max(0, int(c[np.flatnonzero(score >= score.max() - 1e-12)[0]]) - lead)
        nominal, first = nominal + hop / stretch, False
        grain = win * pad[pos + lead : pos + lead + frame]
        out.append(tail + grain[:hop])
        tail = grain[hop:]
        if pos + frame >= len(x):
            return np.concatenate(out)


def _own_length(df: DataFrame, fn) -> DataFrame:
    ship(df.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = fn(pdf.sort_values("n")["x"].to_numpy())
        return pd.DataFrame({"signal_id": pdf["signal_id"].iloc[0], "n": np.arange(len(y)), "y": y})

    return df.select("signal_id", "n", "x").groupBy("signal_id").applyInPandas(one, "signal_id string, n long, y double")


def time_stretch(df: DataFrame, frame: int, stretch: float) -> DataFrame:
    return _own_length(df, lambda x: stretched(x, frame, stretch))


def pitch_shift(df: DataFrame, frame: int, pitch: float) -> DataFrame:
    """As long as before, pitch times as high: stretched, and read that much faster by linear interpolation; silence past its end."""

    def shift(x: np.ndarray) -> np.ndarray:
        s = np.append(stretched(x, frame, pitch), 0.0)
        return np.interp(np.arange(len(x)) * pitch, np.arange(len(s)), s, right=0.0)

    return _own_length(df, shift)


def geometric(df: DataFrame, keys: tuple[str, ...], index: str, value: str, r: float, out: str = "y") -> DataFrame:
    """out[i] = sum over j <= i of r^(i-j) value[j] for |r| <= 1, without Python and without a task per signal: chunks are summed from
    a zero start, and each adds what its start state decays to. A chunk is so long that r^-length stays in range. The
    ends of the chunks are the same problem with r^length, solved the same way; once r^length is under half an ulp, the
    chunk before is all that counts."""
    if r == 0:
        return df.withColumn(out, F.col(value))
    if abs(r) > 1:
        raise ValueError("a sum that grows has no chunked form")
    length = max(2, min(4096, int(400 / -math.log(abs(r))))) if abs(r) < 1 else 4096
    at = df.withColumn("_c", F.expr(f"`{index}` div {length}")).withColumn("_i", F.col(index) % length)
    w = Window.partitionBy(*keys, "_c").orderBy(index)
    up, down = F.pow(F.lit(r), F.col("_i")), F.pow(F.lit(r), -F.col("_i"))
    own = at.withColumn("_z", F.sum(F.col(value) * down).over(w) * up)
    ends = own.groupBy(*keys, "_c").agg(F.max_by("_z", "_i").alias("_z"))
    q = r**length
    if abs(q) < 1e-17:
        done = ends.withColumnRenamed("_z", "_s")
    elif abs(q) == 1:
        turn = F.pow(F.lit(q), F.col("_c"))
        done = ends.withColumn("_s", F.sum(F.col("_z") * turn).over(Window.partitionBy(*keys).orderBy("_c")) * turn)
    else:
        above = geometric(ends.select(*keys, F.col("_c").alias("_k2"), F.col("_z").alias("_v2")), keys, "_k2", "_v2", q, "_e2")
        done = above.select(*keys, F.col("_k2").alias("_c"), F.col("_e2").alias("_s"))
    start = done.select(*keys, (F.col("_c") + 1).alias("_c"), "_s")
    both = own.join(start, [*keys, "_c"], "left").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    return both.withColumn(out, F.col("_z") + F.col("_s") * up * r).drop("_c", "_i", "_z", "_s")


def affine_scan(df: DataFrame, a: float) -> DataFrame:
    """One-pole y += a (x - y)."""
    return geometric(df.withColumn("_v", F.col("x") * a), ("signal_id",), "n", "_v", 1.0 - a).drop("_v")


def lanes(df: DataFrame, d: int, feedback: float, allpass_gain: float | None = None) -> DataFrame:
    """Comb (or allpass): samples d apart are independent lanes, each a geometric sum over its past."""
    own = df.withColumn("_lane", F.col("n") % d).withColumn("_k", F.expr(f"n div {d}"))
    if allpass_gain is None:
        return geometric(own, ("signal_id", "_lane"), "_k", "x", feedback).drop("_lane", "_k")
    before = F.lag("x", 1, 0.0).over(Window.partitionBy("signal_id", "_lane").orderBy("_k"))
    own = own.withColumn("_v", before - F.col("x") * allpass_gain)
    return geometric(own, ("signal_id", "_lane"), "_k", "_v", allpass_gain).drop("_lane", "_k", "_v")
