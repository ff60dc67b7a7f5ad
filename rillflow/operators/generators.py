"""Generators on a time line (signal_id, n), envelopes and event-driven voices."""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, groupby
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions.elementwise import phase, polyblep, wave, wrap_phase
from rillflow.functions.ship import ship

#: A 64-bit linear congruential generator.
LCG_A, LCG_C = 6364136223846793005, 1442695040888963407


def sine(line: DataFrame, freq: float, rate: float = 48000.0) -> DataFrame:
    return line.withColumn("y", wave(phase(F.col("n"), freq / rate), "sine"))


def saw(line: DataFrame, freq: float, rate: float = 48000.0) -> DataFrame:
    p = phase(F.col("n"), freq / rate)
    return line.withColumn("y", 2 * p - 1 - polyblep(p, freq / rate))


def square(line: DataFrame, freq: float, rate: float = 48000.0) -> DataFrame:
    p, dt = phase(F.col("n"), freq / rate), freq / rate
    return line.withColumn("y", wave(p, "square") + polyblep(p, dt) - polyblep(wrap_phase(p + 0.5), dt))


def lfo(blocks: DataFrame, increment: float, size: int, amplitude: float, offset: float, form: str = "sine") -> DataFrame:
    """One value per block, at its start."""
    return blocks.withColumn("y", offset + amplitude * wave(phase(F.col("block") * size, increment), form))


def constant(line: DataFrame, level: float) -> DataFrame:
    return line.withColumn("y", F.lit(float(level)))


def wavetable(line: DataFrame, values: list[float], freq: float, rate: float = 48000.0) -> DataFrame:
    at = phase(F.col("n"), freq / rate) * len(values)
    t = F.array(*[F.lit(float(v)) for v in values])
    i = F.floor(at).cast("int")
    a, b = F.get(t, F.pmod(i, F.lit(len(values)))), F.get(t, F.pmod(i + 1, F.lit(len(values))))
    return line.withColumn("y", a + (at - i) * (b - a))


def noise(line: DataFrame, seed: int) -> DataFrame:
    """Top 32 bits of the n-th state of the generator, by jumping ahead: any partition makes its own samples."""
    ship(line.sparkSession)

    def run(it):
        for b in it:
            n = b["n"].to_numpy().astype(np.uint64) + np.uint64(1)
            state, a, c = np.full(len(n), seed, np.uint64), np.full(len(n), LCG_A, np.uint64), np.full(len(n), LCG_C, np.uint64)
            with np.errstate(over="ignore"):
                while n.any():
                    odd = (n & np.uint64(1)).astype(bool)
                    state = np.where(odd, state * a + c, state)
                    c, a = c * (a + np.uint64(1)), a * a
                    n >>= np.uint64(1)
            yield b.assign(y=(state >> np.uint64(32)).astype(float) / 2**31 - 1.0)

    return line.select("signal_id", "n").mapInPandas(run, "signal_id string, n long, y double")


def adsr_levels(gates: list[bool], attack: float, decay: float, sustain: float, release: float, size: int) -> np.ndarray:
    """The level at the start of each block. It moves by linear segments, sample by sample; a held gate starts the attack from
    where the level is, a dropped one the release."""
    level, stage, out = 0.0, "idle", []
    for g in gates:
        if g:
            stage = "attack" if stage in ("idle", "release") else stage
        elif stage != "idle":
            stage = "release"
        out.append(level)
        for _ in range(size):
            level, stage = envelope_step(level, stage, attack, decay, sustain, release)
    return np.array(out)


def envelope_step(level: float, stage: str, attack: float, decay: float, sustain: float, release: float) -> tuple[float, str]:
    """One sample on: (level, stage)."""
    if stage == "attack":
        return (1.0, "decay") if level + attack >= 1.0 else (level + attack, stage)
    if stage == "decay":
        return (sustain, "sustain") if level - decay <= sustain else (level - decay, stage)
    if stage == "sustain":
        return sustain, stage
    if stage == "release":
        return (0.0, "idle") if level - release <= 0.0 else (level - release, stage)
    return level, stage


def envelope_run(n: int, level: float, stage: str, attack: float, decay: float, sustain: float, release: float) -> tuple[np.ndarray, float, str]:
    """The levels before each of n steps of envelope_step, and where they end: the same sums, a stage at a time."""
    levels, i = np.empty(n), 0
    ends = {"attack": (attack, 1.0, 1.0, "decay"), "decay": (-decay, -sustain, sustain, "sustain"), "release": (-release, 0.0, 0.0, "idle")}
    while i < n:
        if stage not in ends:
            levels[i] = level
            level = sustain if stage == "sustain" else level
            levels[i + 1 :] = level
            break
        step, bound, to, after = ends[stage]
        line = np.full(n - i + 1, step)
        line[0] = level
        line = np.add.accumulate(line)
        over = line[1:] >= bound if step is attack else -line[1:] >= bound
        k = int(over.argmax()) if over.any() else -1
        if k < 0:
            levels[i:], level = line[:-1], float(line[-1])
            break
        levels[i : i + k + 1] = line[: k + 1]
        level, stage, i = to, after, i + k + 1
    return levels, level, stage


@lru_cache
def one_pole_taps(pole: float) -> np.ndarray | None:
    """The impulse response of a one-pole lowpass as far as a double tells it, if that is short."""
    rest = abs(1.0 - pole)
    size = 1 if rest < 1e-20 else math.ceil(math.log(1e-20) / math.log(rest)) if rest < 0.5 else 0
    return pole * (1.0 - pole) ** np.arange(size) if size else None


def lowpassed(s: np.ndarray, pole: float, last: float) -> np.ndarray:
    taps = one_pole_taps(pole)
    if taps is None:
        return np.array(list(accumulate(s.tolist(), lambda y, v: y + pole * (v - y), initial=last))[1:])
    return np.convolve(s, taps)[: len(s)] + last * (1.0 - pole) ** np.arange(1, len(s) + 1)


def adsr(gates: DataFrame, size: int, attack: float = 1 / 32, decay: float = 1 / 64, sustain: float = 0.5, release: float = 1 / 128) -> DataFrame:
    """(signal_id, block, gate) to (signal_id, block, y): a control value per block."""
    ship(gates.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        y = adsr_levels(pdf["gate"].astype(bool).tolist(), attack, decay, sustain, release, size)
        return pd.DataFrame({"signal_id": pdf["signal_id"], "block": pdf["block"], "y": y})

    return gates.groupBy("signal_id").applyInPandas(one, "signal_id string, block long, y double")


class Voice(Protocol):
    """What a pool of voices asks of one: triggers, a render that adds to out, and whether it still sounds. set_pressure(value),
    set_expression(axis, value) and level() are optional."""

    def note_on(self, pitch: float, velocity: float) -> None: ...
    def note_off(self) -> None: ...
    def render_add(self, out: np.ndarray) -> None: ...
    def is_active(self) -> bool: ...


def require_voice(kind: type) -> type:
    if missing := [m for m in ("note_on", "note_off", "render_add", "is_active") if not callable(getattr(kind, m, None))]:
        raise TypeError(f"{kind.__name__} is no voice: it has no {', '.join(missing)}")
    return kind


class SawVoice:
    """A smoothed saw through a one-pole lowpass, times velocity and a linear envelope. A trigger keeps phase, filter and level."""

    def __init__(self, rate: float = 48000.0, attack: float = 0.01, decay: float = 0.001, sustain: float = 0.7, release: float = 0.0005, cutoff: float = 18_000.0):
        self.rate, self.segments = rate, (attack, decay, sustain, release)
        self.pole = 1.0 - math.exp(-2.0 * math.pi * cutoff / rate)
        self.phase, self.dt, self.lp, self.amount, self.velocity, self.stage = 0.0, 440.0 / rate, 0.0, 0.0, 0.0, "idle"

    def note_on(self, pitch: float, velocity: float) -> None:
        self.dt, self.velocity, self.stage = pitch / self.rate, velocity, "attack"

    def note_off(self) -> None:
        if self.stage != "idle":
            self.stage = "release"

    def is_active(self) -> bool:
        return self.stage != "idle"

    def level(self) -> float:
        return self.amount

    def render_add(self, out: np.ndarray) -> None:
        n, dt = len(out), self.dt
        p = self.phase + dt * np.arange(n + 1)
        p -= np.floor(p)
        self.phase, p = float(p[-1]), p[:-1]
        up, down = p / dt, (p - 1.0) / dt
        s = 2.0 * p - 1.0 - np.where(p < dt, up + up - up * up - 1.0, np.where(p > 1.0 - dt, down * down + down + down + 1.0, 0.0))
        low = lowpassed(s, self.pole, self.lp)
        levels, self.amount, self.stage = envelope_run(n, self.amount, self.stage, *self.segments)
        self.lp = float(low[-1])
        out += self.velocity * levels * low


class VoicePool:
    """A fixed number of voices. A note takes the first silent slot, made anew; if there is none it retriggers the oldest (or the
    quietest) in place. A release, pressure or expression goes to the youngest sounding voice of its note alone."""

    def __init__(self, make, size: int, steal: str = "oldest"):
        self.make, self.steal = make, steal
        self.voices, self.notes, self.ages, self.age = [make() for _ in range(size)], [None] * size, [0] * size, 0

    def owner(self, note) -> int | None:
        own = [k for k, v in enumerate(self.voices) if v.is_active() and self.notes[k] == note]
        return max(own, key=lambda k: self.ages[k], default=None)

    def apply(self, e) -> None:
        if e.kind == "on":
            k = next((k for k, v in enumerate(self.voices) if not v.is_active()), None)
            if k is not None:
                self.voices[k] = self.make()
            else:
                levels = [v.level() if hasattr(v, "level") else 0.0 for v in self.voices]
                k = min(range(len(self.voices)), key=(lambda j: levels[j]) if self.steal == "quietest" and hasattr(self.voices[0], "level") else (lambda j: self.ages[j]))
            self.age += 1
            self.voices[k].note_on(e.pitch, e.velocity)
            self.notes[k], self.ages[k] = e.note, self.age
            return
        k = self.owner(e.note)
        if k is None:
            return
        if e.kind == "off":
            self.voices[k].note_off()
        elif e.kind == "pressure" and hasattr(self.voices[k], "set_pressure"):
            self.voices[k].set_pressure(e.velocity)
        elif e.kind == "expression" and hasattr(self.voices[k], "set_expression"):
            self.voices[k].set_expression(e.axis, e.velocity)

    def render(self, events: list, length: int) -> np.ndarray:
        """voices x length; an event past the end applies there."""
        out, at = np.zeros((len(self.voices), length)), 0
        for e in events:
            to = min(max(int(e.at), at), length)
            self._segment(out, at, to)
            self.apply(e)
            at = to
        self._segment(out, at, length)
        return out

    def _segment(self, out: np.ndarray, a: int, b: int) -> None:
        for k, v in enumerate(self.voices):
            if b > a and v.is_active():
                v.render_add(out[k, a:b])


#: Samples in one row of a rendered signal, and in one batch.
BLOCK = 1 << 14


def _rendered(events: DataFrame, length: int, polyphony: int, steal: str, make, split: bool) -> DataFrame:
    """(signal_id, n, y): the sum of the voices, or with split an array of them. A task takes its signals one after the other in order
    of their events, so it holds one signal's samples and a batch of events; samples leave in blocks."""
    ship(events.sparkSession)
    require_voice(type(make()))
    spark, names = events.sparkSession, ["signal_id", *[c for c in events.columns if c != "signal_id"]]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)

    def packed(rows: list[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
        y = pa.array(np.concatenate([part.reshape(-1) for _, _, part in rows]))
        if split:
            y = pa.ListArray.from_arrays(pa.array(np.arange(0, len(y) + 1, polyphony, dtype=np.int32)), y)
        ends = np.cumsum([0, *[len(part) for _, _, part in rows]], dtype=np.int32)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), y)], names=["signal_id", "at", "y"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        event = namedtuple("Event", names, rename=True)
        came = (event(*r) for b in it for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        rows, held = [], 0
        for name, own in groupby(came, lambda e: e[0]):
            y = VoicePool(make, polyphony, steal).render(own, length)
            y = y.T if split else y.sum(axis=0)
            for at in range(0, length, BLOCK):
                rows.append((name, at, y[at : at + BLOCK]))
                held += len(rows[-1][2])
                if held >= BLOCK:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)

    kinds = dict(events.dtypes)
    given = [F.coalesce(c, F.lit(float("nan"))).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in names]
    inside = events.select(*given).repartition(tasks, "signal_id").sortWithinPartitions("signal_id", F.asc_nulls_last("at"), F.asc_nulls_last("seq"))
    out = inside.mapInArrow(run, f"signal_id string, at long, y {'array<array<double>>' if split else 'array<double>'}")
    return out.select("signal_id", "at", F.posexplode("y").alias("_p", "y")).select("signal_id", (F.col("at") + F.col("_p")).alias("n"), "y")


def voices(events: DataFrame, length: int, polyphony: int = 4, steal: str = "oldest", make=SawVoice) -> DataFrame:
    """Notes (signal_id, seq, at, kind, note, pitch, velocity) to samples: the sum of a pool's voices."""
    return _rendered(events, length, polyphony, steal, make, False)


def voice_bus(events: DataFrame, length: int, polyphony: int = 4, steal: str = "oldest", make=SawVoice) -> DataFrame:
    """The same, y an array of the voices, for what is done to single voices before they are summed without an exchange."""
    return _rendered(events, length, polyphony, steal, make, True)


def voice_map(events: DataFrame, length: int, polyphony: int = 4, steal: str = "oldest", make=SawVoice) -> DataFrame:
    """The same, each voice a row of its own (signal_id, voice, n, y)."""
    return voice_bus(events, length, polyphony, steal, make).select("signal_id", F.posexplode("y").alias("voice", "y"), "n").select("signal_id", "voice", "n", "y")
