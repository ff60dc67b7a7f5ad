"""Composite plans: the analyzers, wired and checked by the flow, layouts of spectral peaks, and the sonification examples."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.ship import ship
from rillflow.operators import features as ft
from rillflow.operators import recurrent as rc
from rillflow.operators import rewindow as rw
from rillflow.plans.flow import Flow, Port

KEYS = ("signal_id", "hop")


def _spectral(power: DataFrame) -> DataFrame:
    """Every feature that reads one spectrum, from one table: no join between them."""
    df = ft.flux(power)
    return df.select(*KEYS, "p", ft.rms().alias("rms"), ft.centroid().alias("centroid"), ft.rolloff().cast("double").alias("rolloff"), "flux")


def _channel(f: Flow, name: str, source: Callable[[], DataFrame], frame: int, hop: int) -> str:
    """source -> stft -> power; the power node's name."""
    f.add(f"source{name}", source)
    f.add(f"stft{name}", lambda x: rw.stft(x, frame, hop), {"x": Port()}, Port("spectrum"), rate=(1, hop))
    f.add(f"power{name}", rw.power, {"spec": Port("spectrum")}, Port("power"))
    f.connect(f"source{name}", f"stft{name}"), f.connect(f"stft{name}", f"power{name}", "spec")
    return f"power{name}"


def _described(f: Flow, power: str, source: str, frame: int, hop: int) -> None:
    f.add("spectral", _spectral, {"power": Port("power")}, Port("feature"))
    f.add("dominant", lambda power: ft.dominant_hysteresis(power.select(*KEYS, "p")), {"power": Port("power")}, Port("feature"))
    f.add("framer", lambda x: rw.frames(x, frame, hop), {"x": Port()}, Port("frame"), rate=(1, hop))
    f.add("envelope", ft.ballistic, {"df": Port("frame")}, Port("feature"))
    f.connect(power, "spectral", "power"), f.connect(power, "dominant", "power"), f.connect(source, "framer"), f.connect("framer", "envelope", "df")


def mono(source: Callable[[], DataFrame], frame: int, hop: int) -> DataFrame:
    """(signal_id, hop, spectrum, dominant, amplitude, rms, centroid, rolloff, flux)."""
    f = Flow()
    _described(f, _channel(f, "", source, frame, hop), "source", frame, hop)

    def collect(spectral: DataFrame, dominant: DataFrame, amplitude: DataFrame) -> DataFrame:
        both = spectral.join(dominant, list(KEYS)).join(amplitude, list(KEYS))
        return both.select(*KEYS, F.col("p").alias("spectrum"), F.col("bin").cast("double").alias("dominant"), F.col("envelope").alias("amplitude"), "rms", "centroid", "rolloff", "flux")

    f.add("collect", collect, {k: Port("feature") for k in ("spectral", "dominant", "amplitude")}, Port("matrix"), zip=True)
    f.connect("spectral", "collect", "spectral"), f.connect("dominant", "collect", "dominant"), f.connect("envelope", "collect", "amplitude")
    return f.compile("collect")


def stereo(left: Callable[[], DataFrame], right: Callable[[], DataFrame], frame: int, hop: int) -> DataFrame:
    """(signal_id, hop, spectrum_l, spectrum_r, ...): the features are those of the left channel; only hops that both have."""
    f = Flow()
    _described(f, _channel(f, "_l", left, frame, hop), "source_l", frame, hop)
    _channel(f, "_r", right, frame, hop)

    def collect(spectral: DataFrame, dominant: DataFrame, amplitude: DataFrame, right: DataFrame) -> DataFrame:
        both = spectral.join(dominant, list(KEYS)).join(amplitude, list(KEYS)).join(right.select(*KEYS, F.col("p").alias("spectrum_r")), list(KEYS))
        return both.select(*KEYS, F.col("p").alias("spectrum_l"), "spectrum_r", F.col("bin").cast("double").alias("dominant"), F.col("envelope").alias("amplitude"), "rms", "centroid", "rolloff", "flux")

    f.add("collect", collect, {k: Port("feature") for k in ("spectral", "dominant", "amplitude")} | {"right": Port("power")}, Port("matrix"), zip=True)
    f.connect("spectral", "collect", "spectral"), f.connect("dominant", "collect", "dominant"), f.connect("envelope", "collect", "amplitude"), f.connect("power_r", "collect", "right")
    return f.compile("collect")


def spectrogram(source: Callable[[], DataFrame], frame: int, hop: int, coefficients: int = 20) -> DataFrame:
    """(signal_id, hop, spectrum, mfcc)."""
    f = Flow()
    power = _channel(f, "", source, frame, hop)
    f.add("collect", lambda power: ft.mfcc(power, frame // 2 + 1, coefficients).select(*KEYS, F.col("p").alias("spectrum"), "mfcc"), {"power": Port("power")}, Port("matrix"))
    f.connect(power, "collect", "power")
    return f.compile("collect")


def long(matrix: DataFrame) -> DataFrame:
    """A feature matrix by (signal_id, hop, col, v): scalars and arrays end to end."""
    parts = [F.col(c) if t.startswith("array") else F.array(F.col(c)) for c, t in matrix.dtypes if c not in KEYS]
    flat = matrix.select(*KEYS, F.posexplode(F.concat(*parts)).alias("col", "v"))
    return flat.select(*KEYS, F.col("col").cast("long").alias("col"), (F.round("v", 6) + 0.0).alias("v"))


def panned(left: Column, right: Column) -> Column:
    """Where a peak lies between two channels."""
    a, b = F.sqrt(left), F.sqrt(right)
    return (a - b) / (a + b + 1e-9)


def _jitter(n: int) -> Column:
    """A fixed scatter in [-1/2, 1/2) of the index i: two rounds of a 32-bit mix whose products are those of doubles."""
    wrap = lambda c: F.pmod(c, F.lit(4294967296.0)).cast("long")
    x = F.pmod(F.col("i") * 2654435761 + n * 40503, F.lit(1 << 32))
    for shift, factor in ((15, 2246822519.0), (13, 3266489917.0)):
        x = wrap(x.bitwiseXOR(F.shiftright(x, shift)).cast("double") * factor)
    return x.bitwiseXOR(F.shiftright(x, 16)) / 4294967296.0 - 0.5


def placed(peaks: DataFrame, parts: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Peaks (signal_id, hop, i, t, cen, lf, amp, flux, az, hz, rol, pan and the columns named in parts) by every layout:
    (signal_id, hop, mode, x, y, z). Octaves are measured over all peaks."""
    octave = F.log2(F.greatest("hz", F.lit(1.0)))
    span = peaks.agg(F.min(octave).alias("lo"), F.greatest(F.max(octave) - F.min(octave), F.lit(1.0)).alias("span"))
    p = peaks.crossJoin(F.broadcast(span)).withColumn("lg", octave).withColumn("turn", 2 * math.pi * (octave - F.floor(octave)))  # one row
    cen, lf, amp, flux, az, t = (F.col(k) for k in ("cen", "lf", "amp", "flux", "az", "t"))
    cos, sin = F.cos("turn"), F.sin("turn")
    r = 1 + 4.6 * amp + 2.2 * flux
    polar = (cen - 0.5) * 2
    side = F.sqrt(F.greatest(F.lit(0.0), 1 - polar * polar))
    reach = 3.0 + 9.0 * (0.55 * amp + 0.45 * flux)
    coil = 3 + 3 * amp
    tube = 2 + 1.6 * amp
    ring, major = 7.5 + tube * cos, (F.col("lg") - F.col("lo")) / F.col("span") * 2 * math.pi
    a, b, c = (F.col(k) for k in parts["pca"])
    modes = {
        "feature-space": ((cen - 0.5) * 13, (lf - 0.5) * 13, (amp - 0.5) * 13),
        "cylinder": (r * F.cos(az), (lf - 0.5) * 8 + 0.5 * F.sin(az * 0.5), r * F.sin(az)),
        "constellation": (reach * side * cos + 0.9 * _jitter(1), reach * polar + (F.col("rol") - 0.5) * 2.6 + 0.9 * _jitter(2), reach * side * sin + 0.9 * _jitter(3)),
        "timeline": ((cen - 0.5) * 16, (lf - 0.5) * 8, -t * 2),
        "helix": (coil * cos, (F.col("lg") - F.col("lo") - F.col("span") / 2) * 2.2, coil * sin),
        "torus": (ring * F.cos(major), tube * sin, ring * F.sin(major)),
        "stereo-field": (F.col("pan") * 11, (lf - 0.5) * 8, -t * 2),
        "harmonic": ((lf - 0.5) * 10, amp * 6, -t * 2),
        "pca": (a + (lf - 0.5) * 0.6, b + (amp - 0.5) * 0.3, c + (flux - 0.5) * 0.3),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("mode"), *[v.cast("double").alias(n) for n, v in zip("xyz", at)]) for k, at in modes.items()])
    return p.select(*KEYS, F.explode(rows).alias("m")).select(*KEYS, "m.*")


def image_columns(rows: DataFrame) -> DataFrame:
    """Rows of an image (signal_id, row, grey 0..255) as (signal_id, at, v): brightness squared, column by column, bottom row first."""
    height = rows.groupBy("signal_id").agg((F.max("row") + 1).alias("height"))
    flat = rows.select("signal_id", "row", F.posexplode("grey").alias("col", "g")).join(height, "signal_id")
    return flat.select("signal_id", (F.col("col") * F.col("height") + F.col("height") - 1 - F.col("row")).alias("at"), F.pow(F.col("g") / 255.0, F.lit(2.0)).alias("v"))


def image_spectrum(columns: DataFrame, size: int, first: int, frame: int, hop: int, phases: list[float] | None = None, gain: float = 50.0) -> DataFrame:
    """Columns of magnitudes (signal_id, hop, p) as spectra: magnitude i on bin first + i, whose phase turns by its own frequency each
    hop from where phases (zero by default) let it start; a half of it stays, a quarter is taken from either neighbour."""
    bins = frame // 2 + 1
    start = F.array(*[F.lit(float(v)) for v in (phases or [0.0] * size)])
    angle = lambda i: F.get(start, i) + 2 * math.pi * F.pmod((i + first) * (F.col("hop") + 1) * hop, F.lit(frame)) / frame

    def part(f):
        own = F.transform("p", lambda v, i: gain * v * f(angle(i)))
        at = lambda k: F.coalesce(F.when((k >= first) & (k < first + size), F.get(F.col("_own"), (k - first).cast("int"))), F.lit(0.0))
        return own, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: 0.5 * at(k) - 0.25 * at(k - 1) - 0.25 * at(k + 1))

    re_own, taper = part(F.cos)
    im_own, _ = part(F.sin)
    re = columns.withColumn("_own", re_own).withColumn("re", taper)
    return re.withColumn("_own", im_own).withColumn("im", taper).select("signal_id", "hop", "re", "im")


#: Steps of the two scales, in semitones.
MAJOR, MINOR = (0, 2, 4, 7, 9, 12, 14, 16, 19, 21, 24), (0, 3, 5, 7, 10, 12, 15, 17, 19, 22, 24)


def market(ticks: DataFrame, size: int, rate: float = 48000.0) -> DataFrame:
    """Ticks (signal_id, tick, price, volume, volatility, is_up) to stereo (signal_id, n, l, r), size samples each. The price picks the
    bass note of the scale that the direction names, the volatility opens a resonant filter; heavy trade strikes a decaying
    voice and ducks the bass. A struck voice's place between the channels follows the golden ratio by tick. Each channel has its
    flanger; both end in a hyperbolic tangent. One time line is one signal, so it is rendered in one task."""
    ship(ticks.sparkSession)
    hz = lambda note: 440.0 * 2.0 ** ((note - 69.0) / 12.0)
    i = np.arange(size)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tick")
        voices, phase, turn, duck, low = [[0.0, 0.0, 0.0, 0.5, 0.5] for _ in range(8)], 0.0, 0.0, 1.0, None
        flangers = [(rc.flanger(512, 100.0, 30.0, 0.5 / rate, 0.2, 0.5), None), (rc.flanger(512, 140.0, 40.0, 0.4 / rate, 0.2, 0.5), None)]
        out = [[], []]
        for t in pdf.itertuples():
            scale = MAJOR if t.is_up else MINOR
            note = 36.0 + scale[int(min(1.0, max(0.0, t.price)) * (len(scale) - 1))]
            if t.volume > 0.6:
                duck = 0.05
                struck = min(range(8), key=lambda k: voices[k][1])
                place = (t.tick * 0.6180339887498949) % 1.0 * math.pi / 2
                pluck = note - 12.0 + scale[int(min(1.0, t.volatility) * (len(scale) - 1)) % len(scale)]
                voices[struck] = [voices[struck][0], t.volume, hz(pluck), math.cos(place), math.sin(place)]
            dt = hz(note) / rate
            p = (phase + dt * i) % 1.0
            phase = (phase + dt * size) % 1.0
            up, down = p / dt, (p - 1) / dt
            saw = 2 * p - 1 - np.where(p < dt, 2 * up - up * up - 1, np.where(p > 1 - dt, down * down + 2 * down + 1, 0.0))
            low, bass = rc.ladder(0.05 + 0.4 * t.volatility, 0.85 * t.volatility)(low, saw)
            left, right = np.zeros(size), np.zeros(size)
            for v in voices:
                env = v[1] * 0.9992**i
                env = np.where(env < 0.001, 0.0, env)
                q = 2 * math.pi * ((v[0] + v[2] / rate * i) % 1.0)
                y = (np.sin(q + np.sin(0.5 * q) * env * 0.15) + np.sin(1.01 * q) * env * 0.5) * env * 0.12
                left, right = left + y * v[3], right + y * v[4]
                v[0], v[1] = (v[0] + v[2] / rate * size) % 1.0, v[1] * 0.9992**size
            amount = 0.7 * (1 - (1 - duck) * 0.9999 ** (i + 1))
            duck = 1 - (1 - duck) * 0.9999**size
            around = 2 * math.pi * ((turn + 0.2 / rate * i) % 1.0)
            turn = (turn + 0.2 / rate * size) % 1.0
            for k, y in enumerate((left + bass * amount * np.cos(around), right + bass * amount * np.sin(around))):
                kernel, state = flangers[k]
                state, y = kernel(state, y)
                flangers[k] = (kernel, state)
                out[k].append(np.tanh(y))
        left, right = (np.concatenate(o) if o else np.empty(0) for o in out)
        return pd.DataFrame({"signal_id": pdf["signal_id"].iloc[0], "n": np.arange(len(left)), "l": left, "r": right})

    return ticks.groupBy("signal_id").applyInPandas(one, "signal_id string, n long, l double, r double")
