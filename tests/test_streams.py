"""Streams against batch over several batch sizes, loops and user-defined operators against plain loops."""

import math
from collections import deque
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.operators import extend, generators, history, loops, recurrent, rewindow
from rillflow.plans import analyzers
from rillflow.plans.catalog import QUERIES
from rillflow.plans.extended import Follower
from rillflow.plans.flow import Cycle, Flow, Port
from rillflow.sources import pcm, players
from rillflow.sources.signals import numbered, user_signals
from rillflow.streaming import stateful, windows


def signal(spark, values, name="a"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "signal_id string, n long, x double")


def column(df, col="y"):
    return [r[col] for r in df.orderBy("n").collect()]


def fed(spark, df, parts, path):
    """df as a stream of files in order of n, one file a micro-batch."""
    import os
    import time

    top = df.agg(F.max("n")).first()[0] + 1
    for k in range(parts):
        lo, hi = k * top // parts, (k + 1) * top // parts
        df.where((F.col("n") >= lo) & (F.col("n") < hi)).coalesce(1).write.parquet(f"{path}/tmp{k}")
        os.makedirs(f"{path}/in", exist_ok=True)
        name = next(f for f in os.listdir(f"{path}/tmp{k}") if f.endswith(".parquet"))
        os.rename(f"{path}/tmp{k}/{name}", f"{path}/in/{k}.parquet")
        os.utime(f"{path}/in/{k}.parquet", (time.time() - 1000 + k, time.time() - 1000 + k))
    return windows.read_stream(spark, f"{path}/in", 1)


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_any_split_of_a_stream_equals_batch(spark, tmp_path, parts):
    df = signal(spark, np.random.default_rng(parts).normal(size=333)).unionByName(signal(spark, np.random.default_rng(9).normal(size=200), "b"))
    s = fed(spark, df, parts, str(tmp_path))
    got = windows.collected(stateful.run_stream(s, extend.kernel(Follower())), name="t").orderBy("signal_id", "n").collect()
    assert got == recurrent.run(df, recurrent.envelope(0.3, 0.05)).orderBy("signal_id", "n").collect()
    frames = windows.collected(windows.stream_frames(s, 32, 12), name="t").orderBy("signal_id", "hop").collect()
    assert [(r.signal_id, r.hop, r.s) for r in frames] == [(r.signal_id, r.hop, r.s) for r in rewindow.frames(df, 32, 12).orderBy("signal_id", "hop").collect()]


@pytest.mark.parametrize("parts", [1, 3])
def test_late_events_apply_where_the_transport_stands(spark, tmp_path, parts):
    at = [3, 40, 17, 90, 5, 91, 33, 200, 199, 15]
    rows = spark.createDataFrame([("a", k, k, v) for k, v in enumerate(at)], "signal_id string, n long, seq long, at long")
    got = {r.seq: (r.block, r.offset) for r in windows.collected(windows.late_events(fed(spark, rows, parts, str(tmp_path)), 16), name="t").collect()}
    stand, want = 0, {}
    for k, v in enumerate(at):
        want[k] = divmod(max(v, stand * 16), 16)
        stand = max(stand, v // 16)
    assert got == want


@pytest.mark.parametrize(("frame", "hop"), [(32, 12), (24, 24), (20, 1)])
def test_frames_of_a_stream_leave_no_signal_to_python(spark, tmp_path, frame, hop):
    r = np.random.default_rng(frame)
    df = signal(spark, r.normal(size=150)).unionByName(signal(spark, r.normal(size=41), None)).repartition(3)
    got = windows.collected(windows.stream_frames(fed(spark, df, 4, str(tmp_path)), frame, hop), name="t").orderBy("signal_id", "hop").collect()
    want = rewindow.cut(df, frame, hop).orderBy("signal_id", "hop").collect()
    assert [(g.signal_id, g.hop, g.s) for g in got] == [(g.signal_id, g.hop, g.s) for g in want] and len(want) == 150 // hop + 41 // hop
    given, kept = windows.stream_frames(df, frame, hop).step(df, spark.createDataFrame([], "signal_id string, n long, x double"))
    plans = [f._jdf.queryExecution().toString() for f in (given, kept)]
    assert not any("Pandas" in p or "Python" in p for p in plans)


@pytest.mark.parametrize("parts", [1, 3])
def test_late_events_over_ranges_and_batches_leave_no_signal_to_python(spark, tmp_path, parts):
    r = np.random.default_rng(7)
    rows = [(name, k, int(k * 9_000 if name else k), int(v)) for name in ("a", "b", None) for k, v in enumerate(np.cumsum(r.integers(0, 30, 120)) - r.integers(0, 300, 120))]
    s = fed(spark, spark.createDataFrame(rows, "signal_id string, n long, seq long, at long").repartition(5), parts, str(tmp_path))
    got = {(e.signal_id, e.seq): (e.block, e.offset) for e in windows.collected(windows.late_events(s, 16), name="t").collect()}
    stand, want = {}, {}
    for name, _, seq, v in rows:
        want[name, seq] = divmod(max(v, stand.get(name, 0) * 16), 16)
        stand[name] = max(stand.get(name, 0), v // 16)
    assert got == want
    df = spark.createDataFrame(rows, "signal_id string, n long, seq long, at long")
    given, kept = windows.late_events(df, 16).step(df, spark.createDataFrame([], "signal_id string, stand long"))
    plans = [f._jdf.queryExecution().toString() for f in (given, kept)]
    assert not any("Pandas" in p or "Python" in p for p in plans)


@pytest.mark.parametrize("parts", [1, 4])
def test_live_parameters_and_telemetry(spark, tmp_path, parts):
    x = np.arange(1.0, 65.0)
    params = spark.createDataFrame([("a", 10, 0.25), ("a", 32, 0.0)], "signal_id string, at long, value double")
    got = column(windows.collected(windows.live_gain(fed(spark, signal(spark, x), parts, str(tmp_path)), params, 16), name="t"))
    level, want = [1.0, 1.0, 0.25, 0.0, 0.0], []
    for n, v in enumerate(x):
        b = n // 16
        want.append(v * (level[b] + (n % 16 + 1) * (level[b + 1] - level[b]) / 16))
    assert np.allclose(got, want)
    q = stateful.run_stream(windows.read_stream(spark, f"{tmp_path}/in", 1), recurrent.one_pole(0.1)).writeStream.format("memory").queryName(f"t{parts}").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    said = windows.telemetry(q)
    assert sum(p["rows"] for p in said) == 64 and all(p["ms"] > 0 for p in said if p["rows"])


def test_feedback_through_the_flow(spark):
    x = np.random.default_rng(1).normal(size=60)
    f = Flow()
    f.add("s", lambda: signal(spark, x))
    f.add("sum", lambda **_: None, {"x": Port(), "back": Port()}, step=loops.plain(lambda a, b: a + 0.5 * b))
    f.add("late", lambda **_: None, {"x": Port()}, step=loops.delayed(4))
    f.add("out", lambda x: x.withColumn("y", F.col("x") * 2), {"x": Port()})
    f.connect("s", "sum"), f.connect("sum", "late"), f.connect_feedback("late", "sum", "back"), f.connect("sum", "out")
    want = list(x)
    for n in range(5, 60):
        want[n] += 0.5 * want[n - 5]
    assert np.allclose(column(f.compile("out")), 2 * np.array(want))
    g = Flow()
    g.add("s", lambda: signal(spark, x))
    g.add("sum", lambda **_: None, {"x": Port(), "back": Port()})
    g.connect("s", "sum"), g.connect_feedback("sum", "sum", "back")
    with pytest.raises(Cycle):
        g.compile("sum")


def test_bodies():
    body = loops.Body("x")
    body.add("a", loops.plain(lambda x, b: x + b), ["x"], ["a"])
    with pytest.raises(loops.DelayFreeLoop):
        body.kernel("a")
    with pytest.raises(KeyError):
        body.add("b", loops.plain(lambda v: v), ["c"])
    h = np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]]) * 0.5 * 0.85
    x = np.zeros(400)
    x[0] = 1
    kernel = loops.network(4, 53, h.tolist()).kernel(*(f"y{k}" for k in range(4)))
    state, *whole = kernel(None, x)
    lines, want = [deque([0.0] * 53) for _ in range(4)], np.zeros((4, 400))
    last = np.zeros(4)
    for n in range(400):
        v = h @ last + np.array([x[n], 0, 0, 0])
        for k in range(4):
            lines[k].append(v[k])
            want[k, n] = lines[k].popleft()
        last = want[:, n]
    assert np.allclose(whole, want)
    energy = [np.square(np.array(whole)[:, a : a + 100]).sum() for a in (0, 100, 200, 300)]
    assert energy[1] > energy[2] > energy[3] > 0
    state, *first = kernel(None, x[:111])
    _, *second = kernel(state, x[111:])
    assert np.allclose(np.concatenate([first, second], axis=1), whole)


def stretch_loop(x, frame, stretch):
    """Grain by grain with plain sums."""
    hop = frame // 2
    at = lambda i: float(x[i]) if 0 <= i < len(x) else 0.0
    win = [0.5 * (1 - math.cos(2 * math.pi * k / frame)) for k in range(frame)]
    out, tail, pos, nominal, first = [], [0.0] * hop, 0, 0.0, True
    while True:
        if not first:
            centre, best, top = math.floor(nominal + 0.5), 0, -2.0
            for delta in range(-hop, hop + 1):
                a = [at(centre + delta + k) for k in range(hop)]
                b = [at(pos + hop + k) for k in range(hop)]
                e = math.sqrt(sum(v * v for v in a) * sum(v * v for v in b))
                score = sum(p * q for p, q in zip(a, b)) / e if e > 1e-20 else 0.0
                if score > top + 1e-12:
                    top, best = score, delta
            pos = max(0, centre + best)
        first, nominal = False, nominal + hop / stretch
        out += [tail[k] + win[k] * at(pos + k) for k in range(hop)]
        tail = [win[hop + k] * at(pos + hop + k) for k in range(hop)]
        if pos + frame >= len(x):
            return out


@pytest.mark.parametrize("stretch", [0.5, 0.8, 1.0, 1.25, 2.0])
def test_time_stretch_and_pitch_shift(spark, stretch):
    n = np.arange(700)
    x = np.sin(n * 0.21) + 0.3 * np.random.default_rng(2).normal(size=700)
    want = stretch_loop(x, 32, stretch)
    assert np.allclose(column(recurrent.time_stretch(signal(spark, x), 32, stretch)), want)
    if stretch == 1.0:
        assert np.allclose(want[16:], x[16 : len(want)])
    if stretch > 1:
        assert len(want) > 1.1 * len(x)
    read = [*want, 0.0]
    y = []
    for j in range(700):
        i = math.floor(j * stretch)
        a, b = (read[k] if k < len(read) else 0.0 for k in (i, i + 1))
        y.append(a + (j * stretch - i) * (b - a))
    assert np.allclose(column(recurrent.pitch_shift(signal(spark, x), 32, stretch)), y)


def test_stretch_keeps_the_pitch():
    x = np.sin(2 * np.pi * 0.05 * np.arange(4000))
    y = recurrent.stretched(x, 128, 1.5)[256:-256]
    peak = np.abs(np.fft.rfft(y * np.hanning(len(y)))).argmax() / len(y)
    assert abs(peak - 0.05) < 0.001 and abs(len(y) + 512 - 6000) < 400


@pytest.mark.parametrize(("push", "want"), [(16, 16), (17, 16), (15, 16)])
def test_asynchronous_resampler(spark, push, want):
    x = np.sin(np.arange(6000) * 0.05)
    got = recurrent.asynchronous(signal(spark, x), push, want, 64).orderBy("n").collect()
    ring, total, frac, a, b, primed, y, r = deque(), 0.0, 0.0, 0.0, 0.0, False, [], []
    for at in range(0, len(x), push):
        for v in x[at : at + push]:
            if len(ring) < 64:
                ring.append(v)
        err = len(ring) - 32.0
        total = max(-0.03125 / 2e-6, min(0.03125 / 2e-6, total + err))
        ratio = max(31 / 32, min(33 / 32, 1 - 2e-4 * err - 2e-6 * total))
        if not primed:
            a, b, primed = ring.popleft(), ring.popleft(), True
        made = 0
        while made < want:
            if frac >= 1:
                a = b
                b = ring.popleft() if ring else b
                frac -= 1
                continue
            y.append(a + frac * (b - a)), r.append(ratio)
            made, frac = made + 1, frac + 1 / ratio
    assert np.allclose([g.y for g in got], y) and np.allclose([g.ratio for g in got], r)
    assert sum(g.starved for g in got) == 0 or push < want


class Tone:
    """The saw voice, one sample at a time."""

    def __init__(self):
        self.p = self.lp = self.level = self.v = 0.0
        self.dt, self.stage = 440 / 48000, "idle"

    def sample(self):
        p, dt = self.p, self.dt
        b = 2 * p / dt - (p / dt) ** 2 - 1 if p < dt else ((p - 1) / dt) ** 2 + 2 * (p - 1) / dt + 1 if p > 1 - dt else 0.0
        self.lp += (1 - math.exp(-2 * math.pi * 18000 / 48000)) * (2 * p - 1 - b - self.lp)
        y = self.v * self.level * self.lp
        self.p = (p + dt) % 1.0
        if self.stage == "attack":
            self.level += 0.01
            if self.level >= 1:
                self.level, self.stage = 1.0, "decay"
        elif self.stage == "decay":
            self.level -= 0.001
            if self.level <= 0.7:
                self.level, self.stage = 0.7, "sustain"
        elif self.stage == "release":
            self.level -= 0.0005
            if self.level <= 0:
                self.level, self.stage = 0.0, "idle"
        return y


def test_voices_against_a_loop(spark):
    events = [(0, "on", 1, 500.0), (5, "on", 2, 700.0), (40, "on", 1, 300.0), (60, "on", 3, 900.0), (400, "off", 1, 0.0), (500, "off", 1, 0.0), (900, "on", 4, 450.0), (2500, "off", 3, 0.0), (2500, "on", 5, 610.0)]
    slots, notes, ages, age, want = [Tone() for _ in range(3)], [None] * 3, [0] * 3, 0, []
    for n in range(4000):
        for at, kind, note, pitch in events:
            if at != n:
                continue
            if kind == "on":
                free = [k for k in range(3) if slots[k].stage == "idle"]
                k = free[0] if free else min(range(3), key=lambda j: ages[j])
                if free:
                    slots[k] = Tone()
                age += 1
                slots[k].dt, slots[k].v, slots[k].stage, notes[k], ages[k] = pitch / 48000, 0.8, "attack", note, age
            else:
                own = [k for k in range(3) if slots[k].stage != "idle" and notes[k] == note]
                if own:
                    slots[max(own, key=lambda j: ages[j])].stage = "release"
        want.append(sum(v.sample() for v in slots if v.stage != "idle"))
    df = spark.createDataFrame([("a", i, at, kind, note, pitch, 0.8) for i, (at, kind, note, pitch) in enumerate(events)], "signal_id string, seq long, at long, kind string, note int, pitch double, velocity double")
    assert np.allclose(column(generators.voices(df, 4000, 3)), want, atol=1e-9)
    apart = generators.voice_map(df, 4000, 3).groupBy("n").agg(F.sum("y").alias("y"))
    assert np.allclose(column(apart), want, atol=1e-9)
    with pytest.raises(TypeError):
        generators.require_voice(Follower)


def test_voices_run_by_stage_equal_steps_and_need_no_exchange_to_be_summed(spark, tmp_path):
    r = np.random.default_rng(8)
    for _ in range(60):
        segments = (r.choice([0.01, 0.3, 2.0]), r.choice([0.001, 0.4]), r.choice([0.7, 0.0, 1.0]), r.choice([0.0005, 0.05]))
        level, stage, n = float(r.random()), str(r.choice(["attack", "decay", "sustain", "release", "idle"])), int(r.choice([1, 7, 900]))
        got, *end = generators.envelope_run(n, level, stage, *segments)
        for v in got:
            assert v == level
            level, stage = generators.envelope_step(level, stage, *segments)
        assert end == [level, stage]
    x = r.normal(size=500)
    for pole in (1.0, 0.9, 0.51, 0.3, 0.001, 1.2):
        y = 0.4
        for v, got in zip(x, generators.lowpassed(x, pole, 0.4), strict=True):
            y += pole * (v - y)
            assert abs(got - y) < 1e-12
    rows = [(100 * u + k, u, kind, 1.0) for u in (3, 8, 1499) for k, kind in enumerate(("view", "view", "click", "buy", "view", "click", "click"))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    apart, whole = (QUERIES[q](spark, str(tmp_path)) for q in ("voice_map", "poly_voice"))
    assert apart._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(apart.collect()) == sorted(whole.collect()) and whole.count() == 6000
    df = spark.createDataFrame([(s, k, 40_000 * k, "on", k, 440.0, None if k == 2 else 0.5) for s in ("a", None) for k in range(3)], "signal_id string, seq long, at long, kind string, note int, pitch double, velocity double")
    got = generators.voice_map(df, 100_000, 3).groupBy("signal_id", "voice").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.sum(F.isnan("y").cast("int")).alias("nan")).collect()
    assert sorted((r.signal_id or "", r.voice, r.c, r.n, r.nan) for r in got) == [(s, v, 100_000, 99_999, 20_000 if v == 2 else 0) for s in ("", "a") for v in range(3)]


def test_pool_rules():
    e = lambda kind, note, at=0, pitch=440.0: SimpleNamespace(kind=kind, note=note, at=at, pitch=pitch, velocity=0.5)
    pool = generators.VoicePool(generators.SawVoice, 2, "quietest")
    pool.render([e("on", 1), e("on", 2, 30)], 50)
    phase, quiet = pool.voices[1].phase, pool.voices[1].level()
    pool.apply(e("on", 3))
    assert pool.notes == [1, 3] and pool.voices[1].phase == phase and pool.voices[1].level() == quiet
    pool.apply(e("off", 9))
    pool.apply(e("on", 3))
    pool.apply(e("off", 3))
    assert sorted(v.stage for v in pool.voices) == ["attack", "release"]


def test_user_contracts(spark):
    with pytest.raises(TypeError):
        extend.run_rate(signal(spark, [1]), Follower())
    with pytest.raises(TypeError):
        extend.kernel(object())


def test_sources(spark):
    df = signal(spark, [1, 2, 3])
    assert column(players.buffer(df, F.lit(5), True)) == [1, 2, 3, 1, 2]
    assert column(players.buffer(df, F.lit(5), False)) == [1, 2, 3, 0, 0]
    assert column(players.buffer(df, F.lit(5), False), "exhausted") == [False] * 3 + [True] * 2
    held = players.prefetched(df.where("n != 1"), F.lit(4))
    assert column(held) == [1, 1, 3, 3] and column(held, "underruns") == [0, 1, 1, 2]
    assert column(players.played(df, F.lit(1.5), F.lit(4), False)) == [1, 2.5, 0, 0]
    assert column(players.played(df, F.lit(2.0), F.lit(4), True)) == [1, 3, 2, 1]
    assert column(players.tap(signal(spark, range(1, 7)), 3, 2, 3)) == [1, 2, 3, 4]
    assert column(players.tap(signal(spark, [1, 2]), 1, 2, 3)) == [1, 0, 2, 0]


def test_demand_is_made_where_the_samples_are(spark):
    short = spark.createDataFrame([(str(k), n) for k in range(300) for n in (0, 1, 4, 4)] + [("far", 9), ("before", -2), ("before", 1)], "signal_id string, n long")
    for length, size in ((F.col("len") * 4, lambda v: v * 4), (F.lit(3), lambda v: 3), (F.lit(0), lambda v: 0), (F.col("len") + 5, lambda v: v + 5)):
        got = sorted((r.signal_id, r.len, r.n) for r in players.demanded(short, length).collect())
        assert got == sorted((s, v, n) for s, v in [(str(k), 5) for k in range(300)] + [("far", 10), ("before", 2)] for n in range(size(v)))
    small = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    for conf in small:
        spark.conf.set(conf, "64k")
    try:  # the table of lengths is in one partition of this size, the samples in all four
        long = spark.range(400_000).select((F.col("id") % 40).cast("string").alias("signal_id"), F.expr("id div 40").alias("n"))
        made = players.demanded(long, F.col("len")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for conf in small:
            spark.conf.unset(conf)
    assert len(made) == 4 and sum(r["count"] for r in made) == 400_000


def test_demand_is_not_merged_by_what_it_reads(spark):
    """What is read is small enough for one task by the planner's sizes, what is made isn't counted by them."""
    df = spark.range(40_000).select((F.col("id") % 40).cast("string").alias("signal_id"), F.expr("id div 40").alias("n"))
    made = [r["count"] for r in players.demanded(df, F.col("len") * 50).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 2_000_000 and len(made) == 4


def test_numbering_over_ranges(spark):
    rows = [(k, i * 40_000 + k) for k in range(3) for i in range(9)]
    df = spark.createDataFrame(rows + [(None, 7)], "k int, o long").repartition(5)
    got = {(r.k, r.o): r.n for r in numbered(df, "k", "o", "n").collect()}
    assert got == {(k, i * 40_000 + k): i for k in range(3) for i in range(9)} | {(None, 7): 0}


def test_bytes_of_texts(spark):
    df = spark.createDataFrame([(1, "AB"), (1, ""), (None, None), (2, "é" * 100_000)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n, r.mean, r.low) for r in pcm.byte_levels(df).collect()), key=str)
    assert got == sorted([(1, 2, (65.5 - 128) / 128, (65 - 128) / 128), (1, 0, None, None), (None, 0, None, None), (2, 200_000, (0xC3 + 0xA9 - 256) / 256, (0xA9 - 128) / 128)], key=str)


def test_long_texts_come_in_pieces(spark, monkeypatch):
    sizes = [0, 1, pcm.PIECE, pcm.PIECE + 1, 3 * pcm.PIECE, 0, 7 * pcm.PIECE - 1, 1, 6 * pcm.PIECE]
    rows = [(k // 2 if k % 4 else None, "".join(chr(32 + (i * (k + 3)) % 90) for i in range(n))) for k, n in enumerate(sizes)] + [(3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def want(key, text):
        x = (np.frombuffer((text or "").encode(), np.uint8).astype(float) - 128) / 128
        return (key, len(x), x.mean() if len(x) else None, x.min() if len(x) else None)

    for size in ("1", "2", "3", "10000"):  # rows of a batch: texts end within, at and after the end of one
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = sorted(((r.doc_id, r.n, r.mean, r.low) for r in pcm.byte_levels(df).collect()), key=str)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == sorted((want(*r) for r in rows), key=str)
    assert pcm.byte_levels(df.where("false")).collect() == []

    monkeypatch.setattr(type(df), "mapInArrow", lambda given, *_: given)  # what Python gets
    given = pcm.byte_levels(df)
    raw = [len(v) for r in given.collect() for v in r if isinstance(v, (bytes, bytearray))]
    assert sum(raw) == sum(sizes) and max(raw) <= pcm.PIECE


@pytest.mark.parametrize("r", [0.0, 1.0, -1.0, 0.9999, 0.5])
def test_sums_at_the_edges(spark, r):
    x = np.random.default_rng(6).normal(size=9000)
    want, y = [], 0.0
    for v in x:
        y = v + r * y
        want.append(y)
    got = column(recurrent.geometric(signal(spark, x), ("signal_id",), "n", "x", r))
    assert np.allclose(got, want, atol=1e-7)


def test_lpcm_pipeline(spark, tmp_path):
    x = np.sin(np.arange(600) * 0.05).astype("<f4")
    x[7] = np.nan
    (tmp_path / "a.f32").write_bytes(x.tobytes())
    out, sidecar = pcm.analysis_lpcm(spark, str(tmp_path / "a.f32"), 24_000, 48_000, "f32le")
    y = column(out, "x")
    assert len(y) == 300 and np.abs(np.array(y[40:-40]) - np.sin(np.arange(40, 260) * 0.1)).max() < 0.02
    assert sidecar.first().frames == 300 and sidecar.first().duration_sec == 300 / 24_000
    same = history.resample_to(signal(spark, x[8:20]), 8000, 8000)
    assert np.allclose(column(same), x[8:20])


def test_raw_matrix(spark, tmp_path):
    df = spark.createDataFrame([("a", h, float(h), [1.0, 2.0]) for h in range(5)], "signal_id string, hop long, v double, p array<double>")
    assert pcm.matrix_width(df.schema, {"p": 2}) == 3
    pcm.write_raw_matrix(df.repartition(3), f"{tmp_path}/m.f32", {"sample_rate": 8})
    assert np.fromfile(f"{tmp_path}/m.f32", "<f4").reshape(-1, 3).tolist() == [[h, 1, 2] for h in range(5)]
    with pytest.raises(TypeError):
        pcm.matrix_width(df.withColumn("t", F.lit("x")).schema, {"p": 2})


def test_market_is_bounded_and_ducks(spark):
    ticks = spark.createDataFrame([("m", t, (t % 7) / 7, 0.9 if t % 5 == 0 else 0.2, 0.4, t % 2) for t in range(20)], "signal_id string, tick long, price double, volume double, volatility double, is_up int")
    got = analyzers.market(ticks, 64).orderBy("n").collect()
    assert len(got) == 20 * 64 and all(abs(r.l) <= 1 and abs(r.r) <= 1 for r in got) and any(abs(r.l) > 1e-4 for r in got)


def test_dither_is_the_same_in_any_partitioning(spark, sf):
    from rillflow.functions import elementwise as el

    df = user_signals(spark, sf).select("signal_id", "n", el.tpdf(5, "signal_id", "n").alias("d"))
    a, b = (sorted(q.collect()) for q in (df, df.repartition(7)))
    d = np.array([r.d for r in a])
    assert a == b and np.abs(d).max() < 1 and abs(d.mean()) < 0.05 and abs(d.var() - 1 / 6) < 0.03
