"""Queries over the remaining operators: sources, channels, fixed point, parameter edges, feedback, user-defined operators, streams,
analyzers and the sonification examples; each with the SQL it is held against."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions import elementwise as el
from rillflow.functions import tables as tb
from rillflow.operators import blocks as bl
from rillflow.operators import extend as ex
from rillflow.operators import features as ft
from rillflow.operators import history as hi
from rillflow.operators import loops as lo
from rillflow.operators import recurrent as rc
from rillflow.operators import rewindow as rw
from rillflow.operators import spatial as sp
from rillflow.plans import analyzers as an
from rillflow.plans.catalog import _COMB, _ENV, _LAG2, BLOCKS, CODE, FR, FRAMED, HOP, ORACLES, POW, QUERIES, SPEC, N, channels, code, held_sql, keyed, powers, query, r6, recursive, rs, spec
from rillflow.sources import pcm
from rillflow.sources import players as pl
from rillflow.sources.signals import FRAMES, USER, embedding_frames, table, type_signals, user_signals
from rillflow.streaming import stateful, windows

LENS = "l AS (SELECT signal_id, max(n) + 1 AS len FROM sig GROUP BY 1)"


# Sources.
@query(f"WITH {USER}, {LENS} SELECT o.signal_id, o.n, {rs('coalesce(x, 0)')}, o.n >= len AS exhausted FROM (SELECT signal_id, len, unnest(range(len + 5)) AS n FROM l) o LEFT JOIN sig ON sig.signal_id = o.signal_id AND sig.n = o.n")
def drained_source(s, d):
    return pl.buffer(user_signals(s, d), F.col("len") + 5, False).select("signal_id", "n", r6(F.col("y")), "exhausted")


@query(f"WITH {USER}, {LENS}, g AS (SELECT o.signal_id, o.n, x FROM (SELECT signal_id, unnest(range(len)) AS n FROM l) o LEFT JOIN (SELECT * FROM sig WHERE n % 5 < 3) q ON q.signal_id = o.signal_id AND q.n = o.n) SELECT signal_id, n, {rs('coalesce(last_value(x IGNORE NULLS) OVER w, 0)')}, CAST(count(*) OVER w - count(x) OVER w AS BIGINT) AS underruns FROM g WINDOW w AS (PARTITION BY signal_id ORDER BY n)")
def prefetch_source(s, d):
    df = user_signals(s, d)
    size = df.groupBy("signal_id").agg((F.max("n") + 1).alias("own"))
    came = df.where("n % 5 < 3")
    got = pl.prefetched(came, F.col("len") + 2).join(size, "signal_id").where("n < own")
    return got.select("signal_id", "n", r6(F.col("y")), "underruns")


_CURSOR = "sum(CASE n // 16 % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 1.75 END) OVER (PARTITION BY signal_id ORDER BY n) - CASE n // 16 % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 1.75 END"
_PITCH = "CASE n div 16 % 3 WHEN 0 THEN 1.0D WHEN 1 THEN 0.5D ELSE 1.75D END"


@query(f"WITH {USER}, {LENS}, o AS (SELECT signal_id, len, n, c - floor(c / len) * len AS c FROM (SELECT *, {_CURSOR} AS c FROM (SELECT signal_id, len, unnest(range(len * 2)) AS n FROM l))) SELECT o.signal_id, o.n, {rs('a.x + (c - floor(c)) * (b.x - a.x)')} FROM o JOIN sig a ON a.signal_id = o.signal_id AND a.n = floor(c) JOIN sig b ON b.signal_id = o.signal_id AND b.n = (floor(c) + 1) % len")
def sample_player_schedule(s, d):
    """A looped buffer whose pitch a schedule sets by blocks of 16."""
    return keyed(pl.played(user_signals(s, d), F.expr(_PITCH), F.col("len") * 2, True), r6(F.col("y")))


_RATIO = "CASE n // 16 % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 0.5 END"


@query(f"WITH {USER}, {LENS}, o AS (SELECT * FROM (SELECT *, sum(1 / {_RATIO}) OVER (PARTITION BY signal_id ORDER BY n) - 1 / {_RATIO} AS c FROM (SELECT signal_id, len, unnest(range(len * 4)) AS n FROM l)) WHERE c < len) SELECT o.signal_id, o.n, {rs('coalesce(a.x, 0) + (c - floor(c)) * (b.x - coalesce(a.x, 0))')} FROM o LEFT JOIN sig a ON a.signal_id = o.signal_id AND a.n = floor(c) - 1 JOIN sig b ON b.signal_id = o.signal_id AND b.n = floor(c)")
def varispeed_schedule(s, d):
    ratio = F.expr("CASE n div 16 % 3 WHEN 0 THEN 1.0D WHEN 1 THEN 2.0D ELSE 0.5D END")
    return keyed(pl.varied(user_signals(s, d), ratio), r6(F.col("y")))


@query(f"WITH {USER}, l AS (SELECT DISTINCT signal_id FROM sig) SELECT o.signal_id, o.n - 2 AS n, {rs('coalesce(x, 0)', 'x')} FROM (SELECT signal_id, unnest(range(12)) AS n FROM l) o LEFT JOIN sig ON sig.signal_id = o.signal_id AND sig.n = o.n + 3 WHERE o.n >= 2 AND o.n < 9")
def offline_window(s, d):
    """Twelve samples from the third on, as a sink of seven holds them that passes over two."""
    return keyed(pl.captured(pl.injected(user_signals(s, d), 3, 12), 2, 7), r6(F.col("x"), "x"))


@query(
    f"WITH RECURSIVE {USER}, t AS (SELECT signal_id, n // 16 AS tick, count(*) AS got FROM sig GROUP BY 1, 2), "
    "r AS (SELECT signal_id, tick, 0::BIGINT AS before, least(12, got) AS keep, greatest(0, least(12, got) - 9) AS rest FROM t WHERE tick = 0 UNION ALL SELECT t.signal_id, t.tick, r.rest, least(12 - r.rest, t.got), greatest(0, r.rest + least(12 - r.rest, t.got) - 9) FROM r JOIN t ON t.signal_id = r.signal_id AND t.tick = r.tick + 1), "
    "k AS (SELECT sig.signal_id, row_number() OVER (PARTITION BY sig.signal_id ORDER BY sig.n) - 1 AS q, x FROM sig JOIN r ON r.signal_id = sig.signal_id AND r.tick = sig.n // 16 WHERE sig.n % 16 < r.keep), "
    "o AS (SELECT signal_id, tick, i, coalesce(sum(keep) OVER (PARTITION BY signal_id ORDER BY tick, i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS dummy, before + keep AS have FROM r, (SELECT unnest(range(9)) AS i)), "
    f"p AS (SELECT signal_id, tick, i, i < have AS ok, sum(CASE WHEN i < have THEN 1 ELSE 0 END) OVER (PARTITION BY signal_id ORDER BY tick, i) - 1 AS q FROM o) SELECT p.signal_id, p.tick * 9 + p.i AS n, {rs('CASE WHEN ok THEN k.x ELSE 0 END')} FROM p LEFT JOIN k ON k.signal_id = p.signal_id AND k.q = p.q"
)
def tap_ring(s, d):
    """A ring of 12 between a plan that puts 16 in and one that takes 9."""
    return keyed(pl.tap(user_signals(s, d), 16, 9, 12), r6(F.col("y")))


@query("SELECT event_type AS node, event_id AS seq, event_id * 13 % 977 AS at, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id * 13 % 977, event_id) - 1 AS BIGINT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) WHERE k <= 1024")
def midi_event_source(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("node"), F.col("event_id").alias("seq"), (F.col("event_id") * 13 % 977).alias("at"))
    return pl.buffered_events(e, 1024).withColumn("position", F.col("position").cast("long"))


@query("SELECT event_id, event_type AS signal_id, least(greatest(event_id * 13 % 977 - 480, 0), 256) AS \"offset\" FROM events")
def offset_clamp(s, d):
    """Offsets in a block of 256 that starts at 480: early events at its start, late ones at its end."""
    at = F.col("event_id") * 13 % 977
    return table(s, d, "events").select("event_id", F.col("event_type").alias("signal_id"), F.least(F.greatest(at - 480, F.lit(0)), F.lit(256)).alias("offset"))


# Channels.
@query(f"WITH {USER} SELECT signal_id, n, {rs('lag(x, 3, 0.0) OVER w', 'l')}, {rs('lag(-x, 3, 0.0) OVER w', 'r')} FROM sig WINDOW w AS (PARTITION BY signal_id ORDER BY n)")
def planar_delay(s, d):
    both = user_signals(s, d).withColumn("l", F.col("x")).withColumn("r", -F.col("x"))
    return keyed(hi.planar_delay(both, 3, ["l", "r"]), r6(F.col("l"), "l"), r6(F.col("r"), "r"))


@query(f"WITH {USER} SELECT signal_id, n, {rs('lag(x, 1, 0.0) OVER w', 'l')}, {rs('lag(-x, 1, 0.0) OVER w', 'r')} FROM sig WINDOW w AS (PARTITION BY signal_id ORDER BY n)")
def planar_unit_delay(s, d):
    both = user_signals(s, d).withColumn("l", F.col("x")).withColumn("r", -F.col("x"))
    return keyed(hi.planar_delay(both, 1, ["l", "r"]), r6(F.col("l"), "l"), r6(F.col("r"), "r"))


@query(f"WITH RECURSIVE {USER}, r AS (SELECT signal_id, n, 0.1 * x AS y FROM sig WHERE n = 0 UNION ALL SELECT s.signal_id, s.n, r.y + 0.1 * (s.x - r.y) FROM r JOIN sig s ON s.signal_id = r.signal_id AND s.n = r.n + 1) SELECT signal_id, n, CAST(c AS INT) AS ch, {rs('CASE WHEN c = 0 THEN y ELSE -2 * y END')} FROM r, (SELECT unnest([0, 1]) AS c)")
def channel_map(s, d):
    """A one-pole over each of two channels."""
    bus = user_signals(s, d).select("signal_id", "n", F.posexplode(F.array(F.col("x"), -2 * F.col("x"))).alias("ch", "x"))
    return keyed(ex.channel_map(bus, lambda one: rc.affine_scan(one, 0.1).select("signal_id", "n", "y")), "ch", r6(F.col("y")))


_SIX = ["x", "z", "0.5 * x", "0.25 * z", "x - z", "x + z"]
_EIGHT = [*_SIX, "0.125 * x", "0.75 * z"]
_LAID = {
    ("mono", "stereo"): ["x", "x"],
    ("stereo", "mono"): ["0.5 * (x + z)"],
    ("stereo", "5.1"): ["x", "z", "0.0", "0.0", "0.0", "0.0"],
    ("stereo", "7.1"): ["x", "z", "0.0", "0.0", "0.0", "0.0", "0.0", "0.0"],
    ("5.1", "stereo"): ["x + sqrt(0.5) * (0.5 * x) + sqrt(0.5) * (x - z)", "z + sqrt(0.5) * (0.5 * x) + sqrt(0.5) * (x + z)"],
    ("5.1", "7.1"): ["x", "z", "0.5 * x", "0.25 * z", "0.0", "0.0", "x - z", "x + z"],
    ("7.1", "5.1"): ["x", "z", "0.5 * x", "0.25 * z", "0.125 * x + sqrt(0.5) * (x - z)", "0.75 * z + sqrt(0.5) * (x + z)"],
}


def _laid(a: str, b: str) -> None:
    width = {"mono": 1, "stereo": 2, "5.1": 6, "7.1": 8}[a]

    def cols(x, z):
        given = [x, z, 0.5 * x, 0.25 * z, x - z, x + z, 0.125 * x, 0.75 * z][:width]
        return {f"c{k}": v for k, v in enumerate(sp.mix_matrix(tb.MIX[a, b], given))}

    channels(f"mix_{a}_{b}".replace(".", ""), cols, {f"c{k}": f"({v})::DOUBLE" for k, v in enumerate(_LAID[a, b])})


for _a, _b in _LAID:
    _laid(_a, _b)


@query(f"WITH {USER} SELECT signal_id, n // 6 AS n, {', '.join(rs(f'max(x) FILTER (WHERE n % 6 = {p})', k) for k, p in zip(('l', 'r', 'c', 'lfe', 'ls', 'rs'), (0, 2, 1, 5, 3, 4)))} FROM sig GROUP BY 1, 2")
def canonical_order(s, d):
    """A device that sends left, centre, right, both sides and the low frequencies last, in canonical order."""
    order = tb.permutation(tb.CANONICAL["5.1"], ["L", "C", "R", "Ls", "Rs", "LFE"])
    names = ["l", "r", "c", "lfe", "ls", "rs"]
    got = sp.deinterleave(user_signals(s, d).withColumnRenamed("n", "pos"), names, order)
    return keyed(got, *[r6(F.col(k), k) for k in names])


# Fixed point.
def _q(bits: int, text: str = "x * 0.5") -> str:
    top = 1 << (bits - 1)
    return f"CAST(greatest({-top}, least({top - 1}, round({text} * {float(top)!r}::DOUBLE))) AS HUGEINT)"


for _bits, _g in ((8, 64), (32, 1076292163)):

    @query(f"WITH {USER} SELECT signal_id, n, CAST(greatest({-(1 << _bits - 1)}, least({(1 << _bits - 1) - 1}, ({_q(_bits)} * {_g} + {1 << _bits - 2}) >> {_bits - 1})) AS BIGINT) AS y FROM sig".replace(f") >> {_bits - 1}", f" - (({_q(_bits)} * {_g} + {1 << _bits - 2}) % {1 << _bits - 1} + {1 << _bits - 1}) % {1 << _bits - 1}) // {1 << _bits - 1}"), f"gain_q{_bits - 1}")
    def _gain(s, d, bits=_bits, g=_g):
        c = el.quantise(F.col("x") * 0.5, bits - 1)
        return keyed(user_signals(s, d), el.gain_fixed(c, g, bits - 1, bits).alias("y"))


def _pair(s, d) -> DataFrame:
    """Two channels of 16-bit codes: a signal and itself two samples late."""
    return user_signals(s, d).withColumn("a", code()).withColumn("b", F.lag("a", 2, 0).over(hi.order()))


_CODES = f"WITH {USER}, c AS (SELECT signal_id, n, {CODE} AS a FROM sig), p AS (SELECT *, lag(a, 2, 0) OVER (PARTITION BY signal_id ORDER BY n) AS b FROM c)"
_SAT = "CAST(greatest(-32768, least(32767, {})) AS BIGINT)"


@query(f"{_CODES} SELECT signal_id, n, {_SAT.format('3 * a + b')} AS y FROM p")
def summing_mixer_q15(s, d):
    a, b = F.col("a"), F.col("b")
    return keyed(_pair(s, d), sp.mix_fixed([a, a, a, b]).alias("y"))


@query(f"{_CODES} SELECT signal_id, n, {_SAT.format('floor((8192 * a + 4096 * b + 8192) / 16384.0)')} AS l, {_SAT.format('floor((-16384 * a + 24576 * b + 8192) / 16384.0)')} AS r FROM p")
def matrix_router_q15(s, d):
    left, right = sp.route_fixed([[0.5, 0.25], [-1.0, 1.5]], [F.col("a"), F.col("b")])
    return keyed(_pair(s, d), left.alias("l"), right.alias("r"))


@query(f"{_CODES} SELECT signal_id, n, {_SAT.format('floor((a * 18205 + 16384) / 32768.0)')} AS l, {_SAT.format('floor((a * 27246 + 16384) / 32768.0)')} AS r FROM p")
def constant_power_pan_q15(s, d):
    left, right = sp.pan_fixed(F.col("a"), 0.25)
    return keyed(_pair(s, d), left.alias("l"), right.alias("r"))


# Parameters that move.
_AT = "greatest(0.0, least(1.0, 0.05 + 0.5 * sqrt(power)))"
_RAMPED = f"{BLOCKS}, t AS (SELECT signal_id, block, {_AT} AS g, lag({_AT}, 1, 1.0) OVER (PARTITION BY signal_id ORDER BY block) AS g0 FROM b), s1 AS (SELECT sig.signal_id, n, x, g0 + (n % {N} + 1) * (g - g0) / {N} AS a FROM sig JOIN t ON t.signal_id = sig.signal_id AND t.block = n // {N})"


@query(f"WITH RECURSIVE {USER}, {_RAMPED}, r AS (SELECT signal_id, n, a * x AS y FROM s1 WHERE n = 0 UNION ALL SELECT s.signal_id, s.n, r.y + s.a * (s.x - r.y) FROM r JOIN s1 s ON s.signal_id = r.signal_id AND s.n = r.n + 1) SELECT signal_id, n, {rs('y')} FROM r")
def parameter_edge(s, d):
    """The level of a signal drives the cutoff of a one-pole over it: a feature, mapped, ramped across each block."""
    df = user_signals(s, d)
    level = bl.block_power(df, N).select("signal_id", "block", el.feature_map(F.sqrt("power"), 0.5, 0.05, 0.0, 1.0).alias("g"))
    return keyed(rc.run(bl.glide(df, {"a": (level, 1.0)}, N), rc.one_pole_ramped(), ("x", "a")), r6(F.col("y")))


_FQ = "(0.05 + 0.1 * (n // 16 % 4))", "(0.6 + 0.3 * (n // 16 % 3))"
_FQ0 = [f"CASE WHEN n < {N} THEN {first} ELSE {f.replace('n // 16', '(n // 16 - 1)')} END" for f, first in zip(_FQ, (0.25, 0.7071067811865476))]
_SVF = f"s1 AS (SELECT signal_id, n, x, tan(pi() * ({_FQ0[0]} + (n % {N} + 1) * ({_FQ[0]} - ({_FQ0[0]})) / {N})) AS g, 1 / ({_FQ0[1]} + (n % {N} + 1) * ({_FQ[1]} - ({_FQ0[1]})) / {N}) AS k FROM sig)"
for _mode, _out in {"lowpass": "v2", "bandpass": "v1", "highpass": "x - k * v1 - v2"}.items():
    _v = "x, k, ({a}) / (1 + g * (g + k)) + g / (1 + g * (g + k)) * (x - ({b})) AS v1, ({b}) + g / (1 + g * (g + k)) * ({a}) + g * g / (1 + g * (g + k)) * (x - ({b})) AS v2, ({a}) AS i1, ({b}) AS i2"
    _svf = f"WITH RECURSIVE {USER}, {_SVF}, r AS (SELECT signal_id, n, {_out} AS y, 2 * v1 - i1 AS i1, 2 * v2 - i2 AS i2 FROM (SELECT signal_id, n, {_v.format(a='0.0', b='0.0')} FROM s1 WHERE n = 0) UNION ALL SELECT signal_id, n, {_out} AS y, 2 * v1 - i1 AS i1, 2 * v2 - i2 AS i2 FROM (SELECT signal_id, n, {_v.format(a='p1', b='p2')} FROM (SELECT s1.*, r.i1 AS p1, r.i2 AS p2 FROM r JOIN s1 ON s1.signal_id = r.signal_id AND s1.n = r.n + 1))) SELECT signal_id, n, {rs('y')} FROM r"

    @query(_svf, f"state_variable_ramped_{_mode}")
    def _svf_ramped(s, d, mode=_mode):
        df = user_signals(s, d)
        steps = df.select("signal_id", F.expr(f"n div {N}").alias("block")).distinct()
        fc, q = steps.withColumn("g", 0.05 + 0.1 * (F.col("block") % 4)), steps.withColumn("g", 0.6 + 0.3 * (F.col("block") % 3))
        both = bl.glide(df, {"fc": (fc, 0.25), "q": (q, 0.7071067811865476)}, N)
        return keyed(rc.run(both, rc.state_variable_ramped(mode), ("x", "fc", "q")), r6(F.col("y")))


_GA = "CASE WHEN {b} BETWEEN 0 AND 2 THEN 1.0 ELSE 0.0 END"
_GB = "CASE WHEN {b} < 1 AND {b} >= 0 THEN 1.0 ELSE 0.0 END"


def _ramp_sql(g: str, first: float) -> str:
    now, before = g.format(b="(n // 16)"), f"CASE WHEN n < 16 THEN {first} ELSE {g.format(b='(n // 16 - 1)')} END"
    return f"(({before}) + (n % 16 + 1) * (({now}) - ({before})) / 16.0)"


@query(f"WITH {_LAG2} SELECT signal_id, n, {rs(f'0.7310585786 * (sig.x * {_ramp_sql(_GA, 0.0)} + z.x * {_ramp_sql(_GB, 0.0)})')} FROM sig JOIN z USING (signal_id, n)")
def solo_and_fades(s, d):
    """Two nodes fade in; from block 1 the first plays alone; from block 3 both have faded out."""
    df = user_signals(s, d).withColumn("z", F.lag("x", 2, 0.0).over(hi.order()))
    blocks = df.select("signal_id", F.expr(f"n div {N}").alias("block")).distinct()
    said = s.createDataFrame([(0, "fade_in", "a"), (0, "fade_in", "b"), (1, "solo", "a"), (3, "fade_out", "a"), (3, "fade_out", "b")], "block long, command string, node string")
    levels = bl.transitions(blocks, said, ["a", "b"])
    both = bl.glide(df, {k: (levels.select("signal_id", "block", F.col(k).alias("g")), 0.0) for k in ("a", "b")}, N)
    return keyed(both, r6(0.7310585786 * (F.col("x") * F.col("a") + F.col("z") * F.col("b"))))


# Feedback and subgraphs.
@query(_COMB)
def feedback_edge(s, d):
    """y[n] = x[n] + 0.6 y[n - 7], as a sum and a delay of six in a loop that a feedback edge closes; built by the flow."""
    from rillflow.plans.flow import Flow, Port

    f = Flow()
    f.add("source", lambda: user_signals(s, d))
    f.add("sum", lambda **_: None, {"x": Port(), "back": Port()}, step=lo.plain(lambda x, back: x + 0.6 * back))
    f.add("delay", lambda **_: None, {"x": Port()}, step=lo.delayed(6))
    f.connect("source", "sum", "x"), f.connect("sum", "delay", "x"), f.connect_feedback("delay", "sum", "back")
    return keyed(f.compile("sum"), r6(F.col("x")))


@query(recursive({"y": "r.y + 0.1 * (s.x * 0.5 - r.y)"}, {"y": "0.1 * (s.x * 0.5)"}, rs("greatest(-0.2, least(0.2, y))")))
def subgraph(s, d):
    """Gain, one-pole and clip fused to one pass, sample by sample between an inlet and an outlet."""
    body = lo.Body("inlet")
    body.add("gain", lo.plain(lambda x: x * 0.5), ["inlet"])
    body.add("pole", lo.Step(lambda: 0.0, lambda y, x: (y + 0.1 * (x - y),) * 2), ["gain"])
    body.add("outlet", lo.plain(lambda x: max(-0.2, min(0.2, x))), ["pole"])
    return keyed(rc.run(user_signals(s, d), body.kernel("outlet")), r6(F.col("y")))


_HD = [[0.5 * 0.8512345 * (-1) ** bin(i & j).count("1") for j in range(4)] for i in range(4)]
_FDN = ", ".join(f"{'s.x + ' if i == 0 else ''}{' + '.join(f'({m!r}) * r.v{j}' for j, m in enumerate(row))} AS v{i}" for i, row in enumerate(_HD))


@query(f"WITH RECURSIVE {USER}, r AS (SELECT signal_id, n, x AS v0, 0.0::DOUBLE AS v1, 0.0::DOUBLE AS v2, 0.0::DOUBLE AS v3 FROM sig WHERE n < 6 UNION ALL SELECT s.signal_id, s.n, {_FDN} FROM r JOIN sig s ON s.signal_id = r.signal_id AND s.n = r.n + 6) SELECT a.signal_id, a.n, {', '.join(rs(f'coalesce(b.v{k}, 0)', f'y{k}') for k in range(4))} FROM sig a LEFT JOIN r b ON b.signal_id = a.signal_id AND b.n = a.n - 5")
def fdn_reverb(s, d):
    """Four lines of five samples whose outputs come back through a damped Hadamard matrix."""
    body = lo.network(4, 5, sp.fdn_matrix(4, 0.8512345))
    names = tuple(f"y{k}" for k in range(4))
    return keyed(rc.run(user_signals(s, d), body.kernel(*names), out=names), *[r6(F.col(k), k) for k in names])


def _lane(name: str, step: int, g: float, source: str = "sig") -> str:
    return f"{name} AS (SELECT signal_id, n, x, x AS y FROM {source} WHERE n < {step} UNION ALL SELECT s.signal_id, s.n, s.x, s.x + {g} * r.y FROM {name} r JOIN {source} s ON s.signal_id = r.signal_id AND s.n = r.n + {step})"


def _pass(name: str, step: int, g: float, source: str) -> str:
    return f"{name} AS (SELECT signal_id, n, x, -{g} * x AS y FROM {source} WHERE n < {step} UNION ALL SELECT s.signal_id, s.n, s.x, -{g} * s.x + r.x + {g} * r.y FROM {name} r JOIN {source} s ON s.signal_id = r.signal_id AND s.n = r.n + {step})"


_COMBS = ((5, 0.7013467), (7, 0.7213467), (9, 0.6913467), (11, 0.7113467))


@query(f"WITH RECURSIVE {USER}, {', '.join(_lane(f'c{k}', p, g) for k, (p, g) in enumerate(_COMBS))}, m AS (SELECT c0.signal_id, c0.n, c0.y + c1.y + c2.y + c3.y AS x FROM c0 JOIN c1 USING (signal_id, n) JOIN c2 USING (signal_id, n) JOIN c3 USING (signal_id, n)), {_pass('p', 3, 0.5013467, 'm')}, q AS (SELECT signal_id, n, y AS x FROM p), {_pass('w', 2, 0.5013467, 'q')} SELECT signal_id, n, {rs('y')} FROM w")
def schroeder_reverb(s, d):
    """Four parallel combs summed, then two allpasses: closed-form scans, no Python."""
    df = user_signals(s, d)
    for k, (length, g) in enumerate(_COMBS):
        df = rc.lanes(df, length, g).withColumnRenamed("y", f"c{k}")
    df = df.withColumn("x", F.col("c0") + F.col("c1") + F.col("c2") + F.col("c3")).select("signal_id", "n", "x")
    for length in (3, 2):
        df = rc.lanes(df, length, 0.0, 0.5013467).select("signal_id", "n", F.col("y").alias("x"))
    return keyed(df, r6(F.col("x")))


@query(f"WITH RECURSIVE {USER}, {_lane('c0', 18, 0.6013467)}, {_lane('c1', 24, 0.5013467)} SELECT signal_id, n, {rs('(exp(2 * v) - 1) / (exp(2 * v) + 1)')} FROM (SELECT c0.signal_id, c0.n, 0.8 * c0.x + 0.2 * (c0.y + c1.y) AS v FROM c0 JOIN c1 USING (signal_id, n))")
def space_reverb(s, d):
    """Two combs beside the dry signal, bent by a hyperbolic tangent."""
    df = user_signals(s, d)
    for k, (length, g) in enumerate(((18, 0.6013467), (24, 0.5013467))):
        df = rc.lanes(df, length, g).withColumnRenamed("y", f"c{k}")
    return keyed(df, r6(F.tanh(0.8 * F.col("x") + 0.2 * (F.col("c0") + F.col("c1")))))


# What users add.
class Halver:
    """Averages of pairs: a rate operator that gives half as many samples."""

    def init_state(self):
        return np.empty(0)

    def pull(self, state, x):
        x = np.concatenate([state, x])
        whole = len(x) // 2 * 2
        return x[whole:], x[:whole].reshape(-1, 2).mean(axis=1)

    def finish(self, state):
        return np.empty(0)


class Switch:
    """A level that events set."""

    def init_state(self):
        return 1.0

    def apply(self, state, event):
        return event.value

    def render(self, state, x):
        return state, x * state


class Follower:
    def init_state(self):
        return 0.0

    def step(self, state, x):
        return rc.envelope(0.3, 0.05)(state, x)


@query(f"WITH {USER} SELECT signal_id, n // 2 AS n, {rs('avg(x)')} FROM sig GROUP BY 1, 2 HAVING count(*) = 2")
def rate_operator(s, d):
    return keyed(ex.run_rate(user_signals(s, d), Halver()), r6(F.col("y")))


@query(f"WITH {USER}, e AS (SELECT signal_id, n * 3 AS at, n AS seq, x * 0.7310585786 AS value FROM sig WHERE n % 7 = 2) SELECT k.signal_id, k.n, {rs('x * coalesce((SELECT e.value FROM e WHERE e.signal_id = k.signal_id AND e.at <= k.n ORDER BY e.at DESC LIMIT 1), 1.0)')} FROM sig k")
def event_consumer(s, d):
    df = user_signals(s, d)
    events = df.where("n % 7 = 2").select("signal_id", (F.col("n") * 3).alias("at"), F.col("n").alias("seq"), (F.col("x") * 0.7310585786).alias("value"))
    return keyed(ex.run_events(df, events, Switch()), r6(F.col("y")))


query(_ENV.format(rs("e")), "stateful_operator")(lambda s, d: keyed(rc.run(user_signals(s, d), ex.kernel(Follower())), r6(F.col("y"))))


# Streams.
def stream(s, d) -> DataFrame:
    return windows.read_stream(s, f"{d.rstrip('/')}/events.parquet")


def timed(s, d) -> DataFrame:
    return stream(s, d).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS rows, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1, 2")
def stream_tumbling(s, d):
    got = windows.collected(windows.event_windows(timed(s, d), "1 hour"), "complete", "tumbling")
    return got.select("start", "event_type", "rows", (F.round("total", 4) + 0.0).alias("total"))


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) - 3600 * k AS start, event_type, count(*) AS rows, round(sum(value), 4) + 0.0 AS total FROM events, (SELECT unnest(range(2)) AS k) GROUP BY 1, 2")
def stream_hopping(s, d):
    got = windows.collected(windows.event_windows(timed(s, d), "2 hours", "1 hour"), "complete", "hopping")
    return got.select("start", "event_type", "rows", (F.round("total", 4) + 0.0).alias("total"))


@query("SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS rows FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k")
def stream_sessions(s, d):
    return windows.collected(windows.sessions(timed(s, d), "6 hours"), "complete", "sessions")


def stream_signals(s, d, key: str) -> DataFrame:
    """Signals as a stream of files: what user_signals or type_signals gives, written once in the shared folder."""
    path = windows.shared_path(s, "signals")
    {"user": user_signals, "type": type_signals}[key](s, d).write.parquet(path)
    return windows.read_stream(s, path)


@query(f"WITH {FRAMED} SELECT signal_id, hop, CAST(j AS BIGINT) AS k, {rs(f'x * 0.5 * (1 - cos(2 * pi() * j / {FR}))', 's')} FROM fj")
def stream_framer(s, d):
    got = windows.collected(windows.stream_frames(stream_signals(s, d, "type"), FR, HOP), name="frames")
    long = got.select("signal_id", "hop", F.posexplode("s").alias("k", "s")).where((F.col("hop") + 1) * HOP - FR + F.col("k") >= 0)
    return long.select("signal_id", "hop", F.col("k").cast("long").alias("k"), r6(F.col("s"), "s"))


@query(_ENV.format(rs("e")))
def stream_envelope(s, d):
    """A stateful operator on a stream."""
    got = windows.collected(stateful.run_stream(stream_signals(s, d, "user"), ex.kernel(Follower())), name="envelope")
    return keyed(got, r6(F.col("y")))


@query("SELECT event_type AS signal_id, event_id AS seq, greatest(pos, low) // 16 AS block, greatest(pos, low) % 16 AS \"offset\" FROM (SELECT *, coalesce(max(pos // 16) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 16 AS low FROM (SELECT *, event_id * 5 + event_id * 13 % 97 AS pos FROM events))")
def stream_late_events(s, d):
    e = stream(s, d).select(F.col("event_type").alias("signal_id"), F.col("event_id").alias("seq"), (F.col("event_id") * 5 + F.col("event_id") * 13 % 97).alias("at"))
    return windows.collected(windows.late_events(e, 16), name="late")


_LIVE = "coalesce((SELECT p.value FROM p WHERE p.signal_id = sig.signal_id AND p.at <= (sig.n // 16 - {}) * 16 ORDER BY p.at DESC LIMIT 1), 1.0)"


@query(f"WITH {USER}, p AS (SELECT signal_id, n * 3 AS at, x * 0.7310585786 AS value FROM sig WHERE n % 7 = 2) SELECT signal_id, n, {rs('x * (g0 + (n % 16 + 1) * (g1 - g0) / 16)')} FROM (SELECT *, CASE WHEN n < 16 THEN 1.0 ELSE {_LIVE.format(1)} END AS g0, {_LIVE.format(0)} AS g1 FROM sig)")
def stream_live_parameters(s, d):
    p = user_signals(s, d).where("n % 7 = 2").select("signal_id", (F.col("n") * 3).alias("at"), (F.col("x") * 0.7310585786).alias("value"))
    return keyed(windows.collected(windows.live_gain(stream_signals(s, d, "user"), p, N), name="live"), r6(F.col("y")))


# Analyzers: feature matrices in long form, one row per hop and column.
_SPL = f"{SPEC}, q AS (SELECT signal_id, hop, list(re * re + im * im ORDER BY k) AS p FROM sp GROUP BY 1, 2)"
_PEAK = f"v AS (SELECT signal_id, hop, least(1.0, max(abs(x * 0.5 * (1 - cos(2 * pi() * j / {FR}))))) AS v FROM fj GROUP BY 1, 2), bal AS (SELECT signal_id, hop, 0.6 * v AS e FROM v WHERE hop = 0 UNION ALL SELECT v.signal_id, v.hop, bal.e + (CASE WHEN v.v > bal.e THEN 0.6 ELSE 0.05 END) * (v.v - bal.e) FROM bal JOIN v ON v.signal_id = bal.signal_id AND v.hop = bal.hop + 1)"
_BINS = FR // 2 + 1
_ONES = f"one AS (SELECT q.signal_id, q.hop, held, bal.e, sqrt(list_sum(q.p) / {_BINS}) AS rms, CASE WHEN list_sum(q.p) > 0 THEN list_sum(list_transform(range({_BINS}), lambda k: k * q.p[k + 1])) / list_sum(q.p) ELSE 0 END AS centroid, CASE WHEN list_sum(q.p) > 0 THEN list_position(list_transform(range(1, {_BINS + 1}), lambda k: list_sum(q.p[1:k]) >= 0.85 * list_sum(q.p)), true) - 1 ELSE 0 END AS rolloff, sqrt(list_sum(list_transform(range(1, {_BINS + 1}), lambda k: pow(greatest(0, q.p[k] - coalesce(b.p[k], 0)), 2)))) AS flux FROM q JOIN r USING (signal_id, hop) JOIN bal USING (signal_id, hop) LEFT JOIN q b ON b.signal_id = q.signal_id AND b.hop = q.hop - 1)"
_ROWS = " UNION ALL ".join(f"SELECT signal_id, hop, {{base}} + {k} AS col, {rs(v, 'v')} FROM one" for k, v in enumerate(("held", "e", "rms", "centroid", "rolloff", "flux")))


@query(f"WITH RECURSIVE {_SPL}, {held_sql('q', _BINS)}, {_PEAK}, {_ONES} SELECT signal_id, hop, k AS col, {rs('p[k + 1]', 'v')} FROM q, (SELECT unnest(range({_BINS})) AS k) UNION ALL {_ROWS.format(base=_BINS)}")
def analyzer_mono(s, d):
    """Spectrum, held dominant bin, envelope, level, centroid, rolloff and flux of each hop; wired and checked by the flow."""
    return an.long(an.mono(lambda: type_signals(s, d), FR, HOP))



@query(f"WITH RECURSIVE {_SPL}, {held_sql('q', _BINS)}, {_PEAK}, {_ONES}, sx AS (SELECT signal_id, n, 0.5 * lag(x, 3, 0.0) OVER (PARTITION BY signal_id ORDER BY n) AS x FROM sig), fx AS (SELECT signal_id, hop, n - ((hop + 1) * {HOP} - {FR}) AS j, x FROM (SELECT signal_id, n, x, unnest(range(n // {HOP}, (n + {FR}) // {HOP})) AS hop FROM sx) JOIN (SELECT signal_id, (max(n) + 1) // {HOP} AS hops FROM sig GROUP BY 1) USING (signal_id) WHERE hop < hops), spx AS (SELECT signal_id, hop, k, pow(sum(x * 0.5 * (1 - cos(2 * pi() * j / {FR})) * cos(2 * pi() * k * j / {FR})), 2) + pow(sum(x * 0.5 * (1 - cos(2 * pi() * j / {FR})) * sin(2 * pi() * k * j / {FR})), 2) AS p FROM fx, (SELECT unnest(range({_BINS})) AS k) GROUP BY 1, 2, 3) SELECT signal_id, hop, k AS col, {rs('p[k + 1]', 'v')} FROM q, (SELECT unnest(range({_BINS})) AS k) UNION ALL SELECT signal_id, hop, {_BINS} + k AS col, {rs('p', 'v')} FROM spx UNION ALL {_ROWS.format(base=2 * _BINS)}")
def analyzer_stereo(s, d):
    """Both channels' spectra, and the features of the left one."""
    right = lambda: type_signals(s, d).select("signal_id", "n", (0.5 * F.lag("x", 3, 0.0).over(hi.order())).alias("x"))
    return an.long(an.stereo(lambda: type_signals(s, d), right, FR, HOP))


_HZ = "(700 * (pow(10, ({0}) * 2595 * log10(1 + 24000 / 700.0) / 27 / 2595) - 1))"
_MELW = f"mel AS (SELECT b, k, greatest(0, least((k * 48000.0 / {{f}} - lo) / (mid - lo), (hi - k * 48000.0 / {{f}}) / (hi - mid))) AS w FROM (SELECT b, {_HZ.format('b')} AS lo, {_HZ.format('b + 1')} AS mid, {_HZ.format('b + 2')} AS hi FROM (SELECT unnest(range(26)) AS b)), (SELECT unnest(range({{n}})) AS k))"
_DCTW = "dc AS (SELECT c, b, CASE WHEN c = 0 THEN sqrt(1 / 26.0) ELSE sqrt(2 / 26.0) END * cos(pi() * c * (b + 0.5) / 26) AS w FROM (SELECT unnest(range(20)) AS c), (SELECT unnest(range(26)) AS b))"


@query(f"WITH {SPEC}, pw AS (SELECT signal_id, hop, k, re * re + im * im AS p FROM sp), {_MELW.format(f=2 * (_BINS - 1), n=_BINS)}, {_DCTW}, e AS (SELECT signal_id, hop, b, ln(greatest(sum(w * p), 1e-10)) AS e FROM pw JOIN mel USING (k) GROUP BY 1, 2, 3) SELECT signal_id, hop, k AS col, {rs('p', 'v')} FROM pw UNION ALL SELECT signal_id, hop, {_BINS} + c AS col, {rs('sum(w * e)', 'v')} FROM e JOIN dc USING (b) GROUP BY 1, 2, 3")
def spectrogram_mfcc(s, d):
    return an.long(an.spectrogram(lambda: type_signals(s, d), FR, HOP))


@query(f"WITH {SPEC} SELECT signal_id, hop, CAST({_BINS} + 2 AS INT) AS width, {rs('sum(re * re + im * im)', 'total')} FROM sp GROUP BY 1, 2")
def feature_matrix(s, d):
    """Rows of a flattened feature matrix: how wide they are, and the sum of their first part."""
    p = ft.flux(rw.power(spec(s, d))).select("signal_id", "hop", "p", ft.rms().alias("rms"), "flux")
    rows = pcm.matrix_columns(p)
    width = pcm.matrix_width(p.schema, {"p": _BINS})
    total = ft.total(F.transform(F.slice("row", 1, width - 2), lambda v: v.cast("double")))
    exact = ft.total(F.col("p"))
    return rows.join(p.select("signal_id", "hop", "p"), ["signal_id", "hop"]).where(F.abs(total - exact) <= 1e-5 * exact + 1e-5).select("signal_id", "hop", F.size("row").alias("width"), r6(exact, "total"))


_CORNER = "CAST(floor(126 * 700 * (pow(10, ({0}) * 2595 * log10(1 + 24000 / 700.0) / 27 / 2595) - 1) / 48000.0) AS INT)"


@query(f"WITH {POW}, c0 AS (SELECT b, {_CORNER.format('b')} AS lo, {_CORNER.format('b + 1')} AS m0, {_CORNER.format('b + 2')} AS h0 FROM (SELECT unnest(range(26)) AS b)), c AS (SELECT b, lo, greatest(m0, lo + 1) AS mid, greatest(h0, greatest(m0, lo + 1) + 1) AS hi FROM c0) SELECT signal_id, hop, CAST(b AS BIGINT) AS k, {rs('sum(p * CASE WHEN k >= lo AND k < mid THEN (k - lo) / (mid - lo) WHEN k >= mid AND k < hi THEN (hi - k) / (hi - mid) ELSE 0 END)', 'e')} FROM pw, c GROUP BY 1, 2, 3")
def mel_floored(s, d):
    """Mel bands with corners on whole bins."""
    got = powers(s, d).select("signal_id", "hop", ft.mat(tb.mel_bank_floored(64, 126, 48000.0), F.col("p")).alias("e"))
    return got.select("signal_id", "hop", F.posexplode("e").alias("k", "e")).select("signal_id", "hop", F.col("k").cast("long").alias("k"), r6(F.col("e"), "e"))


# Sonification.
@query(f"WITH {FRAMES}, g AS (SELECT signal_id, hop, unnest(range(64)) AS k, unnest(list_transform(s, lambda v: least(255.0, floor(abs(v) * 100)))) AS grey FROM fr), t AS (SELECT signal_id, max(hop) AS top FROM fr GROUP BY 1) SELECT signal_id, k * (top + 1) + (top - hop) AS at, {rs('pow(grey / 255.0, 2)', 'v')} FROM g JOIN t USING (signal_id)")
def image_columns(s, d):
    """An image, a row per hop, as squared brightness column by column, each from the bottom up."""
    grey = F.transform("s", lambda v: F.least(F.lit(255.0), F.floor(F.abs(v) * 100).cast("double")))
    return an.image_columns(embedding_frames(s, d).select("signal_id", F.col("hop").alias("row"), grey.alias("grey"))).select("signal_id", "at", r6(F.col("v"), "v"))


_TURN = "2 * pi() * ((k + 3) * (hop + 1) * 64 % 256) / 256.0"


@query(f"WITH {POW}, m AS (SELECT signal_id, hop, k + 3 AS b, 50 * p * cos({_TURN}) AS re, 50 * p * sin({_TURN}) AS im FROM pw), t AS (SELECT signal_id, hop, b + o AS k, w * re AS re, w * im AS im FROM m, (VALUES (-1, -0.25), (0, 0.5), (1, -0.25)) v(o, w)) SELECT signal_id, hop, CAST(k AS BIGINT) AS k, {rs('sum(re)', 're')}, {rs('sum(im)', 'im')} FROM t GROUP BY 1, 2, 3")
def image_spectrum(s, d):
    """Columns of magnitudes as spectra from bin 3 on, whose phases turn with the hop, tapered over three bins."""
    got = an.image_spectrum(powers(s, d), 64, 3, 256, 64)
    long = got.select("signal_id", "hop", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z")).where("k between 2 and 67")
    return long.select("signal_id", "hop", F.col("k").cast("long").alias("k"), r6(F.col("z.re"), "re"), r6(F.col("z.im"), "im"))


@query()
def market_synth(s, d):
    """Ticks rendered to stereo."""
    ticks = QUERIES["market_ticks"](s, d)
    n = F.row_number().over(Window.orderBy("day")) - 1  # a calendar's days
    top = F.max("volume").over(Window.partitionBy())
    wide = F.max("volatility").over(Window.partitionBy())
    named = ticks.select(F.lit("market").alias("signal_id"), n.alias("tick"), "price", (F.col("volume") / top).alias("volume"), (F.col("volatility") / wide).alias("volatility"), "is_up")
    return keyed(an.market(named, 64), r6(F.col("l"), "l"), r6(F.col("r"), "r"))


_OCT = "log2(greatest(hz, 1))"
_PEAKS = f"WITH {SPEC}, q AS (SELECT signal_id, hop, list(re * re + im * im ORDER BY k) AS p FROM sp GROUP BY 1, 2), p0 AS (SELECT signal_id, hop, hop AS i, hop / 60.0 AS t, list_position(p, list_max(p)) - 1 AS bin, CASE WHEN list_sum(p) > 0 THEN list_sum(list_transform(range({_BINS}), lambda k: k * p[k + 1])) / list_sum(p) / 32 ELSE 0 END AS cen, least(1, sqrt(list_sum(p) / {_BINS}) / 10) AS amp FROM q), p1 AS (SELECT *, bin * 750.0 AS hz, log2(1 + bin) / log2(33) AS lf, hop * 2.399963 AS az, amp * amp AS flux, cen * amp AS rol, (sqrt(amp) - sqrt(cen)) / (sqrt(amp) + sqrt(cen) + 1e-9) AS pan FROM p0), ctx AS (SELECT min({_OCT}) AS lo, greatest(max({_OCT}) - min({_OCT}), 1) AS span FROM p1), p2 AS (SELECT p1.*, lo, span, lo + span / 2 AS mid, {_OCT} AS lg, {_OCT} - floor({_OCT}) AS pc FROM p1, ctx)"
_UINT = "xor({0}, ({0}) >> {1})"
_X1, _X2 = "CAST(({0})::DOUBLE * 2246822519.0::DOUBLE % 4294967296.0::DOUBLE AS BIGINT)", "CAST(({0})::DOUBLE * 3266489917.0::DOUBLE % 4294967296.0::DOUBLE AS BIGINT)"
_J = lambda n: f"0.9 * ({_UINT.format(_X2.format(_UINT.format(_X1.format(_UINT.format(f'CAST((i * 2654435761 + {n} * 40503) % 4294967296 AS BIGINT)', 15)), 13)), 16)} / 4294967296.0 - 0.5)"
_R = "(3.0 + 9.0 * (0.55 * amp + 0.45 * flux))"
_S = "sqrt(greatest(0, 1 - pow((cen - 0.5) * 2, 2)))"
_PLACES = {
    "feature-space": ("(cen - 0.5) * 13", "(lf - 0.5) * 13", "(amp - 0.5) * 13"),
    "cylinder": ("(1 + 4.6 * amp + 2.2 * flux) * cos(az)", "(lf - 0.5) * 8 + 0.5 * sin(az * 0.5)", "(1 + 4.6 * amp + 2.2 * flux) * sin(az)"),
    "constellation": (f"{_R} * {_S} * cos(2 * pi() * pc) + {{0}}", f"{_R} * (cen - 0.5) * 2 + (rol - 0.5) * 2.6 + {{1}}", f"{_R} * {_S} * sin(2 * pi() * pc) + {{2}}"),
    "timeline": ("(cen - 0.5) * 16", "(lf - 0.5) * 8", "-t * 2"),
    "helix": ("(3 + 3 * amp) * cos(2 * pi() * pc)", "(lg - mid) * 2.2", "(3 + 3 * amp) * sin(2 * pi() * pc)"),
    "torus": ("(7.5 + (2 + 1.6 * amp) * cos(2 * pi() * pc)) * cos((lg - lo) / span * 2 * pi())", "(2 + 1.6 * amp) * sin(2 * pi() * pc)", "(7.5 + (2 + 1.6 * amp) * cos(2 * pi() * pc)) * sin((lg - lo) / span * 2 * pi())"),
    "stereo-field": ("pan * 11", "(lf - 0.5) * 8", "-t * 2"),
    "harmonic": ("(lf - 0.5) * 10", "amp * 6", "-t * 2"),
    "pca": ("cen + (lf - 0.5) * 0.6", "amp + (amp - 0.5) * 0.3", "lf + (flux - 0.5) * 0.3"),
}
_PLACED = " UNION ALL ".join(f"SELECT signal_id, hop, '{mode}' AS mode, {', '.join(rs(v.format(*[_J(k) for k in (1, 2, 3)]) if mode == 'constellation' else v, c) for v, c in zip(places, 'xyz'))} FROM p2" for mode, places in _PLACES.items())


@query(f"{_PEAKS} {_PLACED}")
def layout_modes(s, d):
    """Each hop's strongest bin placed by all nine layouts."""
    p = rw.power(spec(s, d))
    amp, cen = F.least(F.lit(1.0), ft.rms() / 10), ft.centroid() / 32
    peaks = p.select("signal_id", "hop", F.col("hop").alias("i"), (F.col("hop") / 60.0).alias("t"), cen.alias("cen"), amp.alias("amp"), ft.dominant().alias("bin"))
    peaks = peaks.withColumn("hz", F.col("bin") * 750.0).withColumn("lf", F.log2(1.0 + F.col("bin")) / math.log2(33)).withColumn("az", F.col("hop") * 2.399963)
    peaks = peaks.withColumn("flux", F.col("amp") * F.col("amp")).withColumn("rol", F.col("cen") * F.col("amp")).withColumn("pan", an.panned(F.col("amp"), F.col("cen")))
    placed = an.placed(peaks, {"pca": ("cen", "amp", "lf")})
    return placed.select("signal_id", "hop", "mode", *[r6(F.col(k), k) for k in "xyz"])


# SQL for what the first catalogue has none for.
ORACLES["noise_shaper"] = recursive(
    {"y": "CAST(greatest(-32768, least(32767, round((s.x - r.e) * 32768.0))) AS BIGINT)", "e": "greatest(-32768, least(32767, round((s.x - r.e) * 32768.0))) / 32768.0 - (s.x - r.e)"},
    {"y": "CAST(greatest(-32768, least(32767, round(s.x * 32768.0))) AS BIGINT)", "e": "greatest(-32768, least(32767, round(s.x * 32768.0))) / 32768.0 - s.x"}, "y",
)
_NLMS = "(list_prepend({ref}, {h}[1:7]))"


def _nlms(leak: float) -> str:
    two = f"{USER}, s AS (SELECT signal_id, n, x, lag(x, 2, 0.0) OVER (PARTITION BY signal_id ORDER BY n) AS ref FROM sig)"
    zero = "list_transform(range(8), lambda i: 0.0::DOUBLE)"
    body = f"SELECT signal_id, n, e, h, list_transform(range(1, 9), lambda i: {1 - leak} * w[i] + 0.5 * e * h[i] / (list_dot_product(h, h) + 1e-6)) AS w"
    one = f"{body} FROM (SELECT signal_id, n, h, w, x - list_dot_product(w, h) AS e FROM (SELECT signal_id, n, x, list_prepend(ref, {zero}[1:7]) AS h, {zero} AS w FROM s WHERE n = 0))"
    more = f"{body} FROM (SELECT signal_id, n, h, w, x - list_dot_product(w, h) AS e FROM (SELECT s.signal_id, s.n, s.x, list_prepend(s.ref, r.h[1:7]) AS h, r.w FROM r JOIN s ON s.signal_id = r.signal_id AND s.n = r.n + 1))"
    return f"WITH RECURSIVE {two}, r AS ({one} UNION ALL {more}) SELECT signal_id, n, {rs('e')} FROM r"


ORACLES["aec"], ORACLES["howl_suppressor"] = _nlms(0.0), _nlms(0.01)
_FD = "least(18.0, greatest(1.0, 8.0 + 4.0 * sin(2 * pi() * (n * 0.013 - floor(n * 0.013)))))"
_FW = f"(line[20 - CAST(floor({_FD}) AS INT) + 1] * (1 - ({_FD} - floor({_FD}))) + line[20 - CAST(floor({_FD}) AS INT)] * ({_FD} - floor({_FD})))"
_FB = f"SELECT signal_id, n, 0.5 * x + 0.5 * {_FW} AS y, list_append(line[2:20], x + 0.4 * {_FW}) AS line"
ORACLES["flanger"] = f"WITH RECURSIVE {USER}, r AS ({_FB} FROM (SELECT signal_id, n, x, list_transform(range(20), lambda i: 0.0::DOUBLE) AS line FROM sig WHERE n = 0) UNION ALL {_FB} FROM (SELECT s.signal_id, s.n, s.x, r.line FROM r JOIN sig s ON s.signal_id = r.signal_id AND s.n = r.n + 1)) SELECT signal_id, n, {rs('y')} FROM r"

# Formulas in place of tables.
_FIRS = {"firwin_lowpass": "{0}", "firwin_highpass": "d - {0}", "firwin_bandpass": "{1} - {0}", "firwin_bandstop": "d - ({1} - {0})"}
_LOW = "(h{k} / sum(h{k}) OVER ())"
_SINC = "(CASE WHEN k = 8 THEN {fc} * 2 ELSE sin(2 * pi() * {fc} * (k - 8)) / (pi() * (k - 8)) END * (0.54 - 0.46 * cos(2 * pi() * k / 16)))"
for _name, _mix in _FIRS.items():
    _lo, _hi = {"firwin_lowpass": (0.1, 0.1), "firwin_highpass": (0.2, 0.2)}.get(_name, (0.1, 0.2))
    _taps = f"t AS (SELECT k, {_mix.format('h0 / sum(h0) OVER ()', 'h1 / sum(h1) OVER ()')} AS c FROM (SELECT k, CASE WHEN k = 8 THEN 1.0 ELSE 0.0 END AS d, {_SINC.format(fc=_lo)} AS h0, {_SINC.format(fc=_hi)} AS h1 FROM (SELECT unnest(range(17)) AS k)))"
    ORACLES[_name] = f"WITH {USER}, {_taps} SELECT a.signal_id, a.n, {rs('sum(t.c * b.x)')} FROM sig a JOIN t ON t.k <= a.n JOIN sig b ON b.signal_id = a.signal_id AND b.n = a.n - t.k GROUP BY a.signal_id, a.n"
_BSINC = "(CASE WHEN k = 4 THEN 2 * ({fc}) ELSE sin(2 * pi() * ({fc}) * (k - 4)) / (pi() * (k - 4)) END * (0.54 - 0.46 * cos(2 * pi() * k / 8)))"
_F0 = "0.05 * pow(2, b / 2.0)"
ORACLES["cqt"] = f"WITH {USER}, t AS (SELECT b, k, h1 / sum(h1) OVER (PARTITION BY b) - h0 / sum(h0) OVER (PARTITION BY b) AS c FROM (SELECT b, k, {_BSINC.format(fc=f'{_F0} / pow(2, 0.25)')} AS h0, {_BSINC.format(fc=f'least(0.4999, {_F0} * pow(2, 0.25))')} AS h1 FROM (SELECT unnest(range(3)) AS b), (SELECT unnest(range(9)) AS k))) SELECT a.signal_id, a.n, CAST(t.b AS INT) AS band, {rs('sum(t.c * s.x)')} FROM sig a JOIN t ON t.k <= a.n JOIN sig s ON s.signal_id = a.signal_id AND s.n = a.n - t.k GROUP BY a.signal_id, a.n, t.b"
ORACLES["mfcc"] = f"WITH {POW}, {_MELW.format(f=126, n=64)}, {_DCTW}, e AS (SELECT signal_id, hop, b, ln(greatest(sum(w * p), 1e-10)) AS e FROM pw JOIN mel USING (k) GROUP BY 1, 2, 3) SELECT signal_id, hop, CAST(c AS BIGINT) AS k, {rs('sum(w * e)', 'mfcc')} FROM e JOIN dc USING (b) GROUP BY 1, 2, 3"
_CLASS = "CAST(floor(12 * log2(k * 48000 / 126.0 / 440) + 0.5) AS BIGINT)"
ORACLES["chroma"] = f"WITH {POW}, f AS (SELECT signal_id, hop, ({_CLASS} % 12 + 12) % 12 AS c, sum(p) AS v FROM pw WHERE k * 48000 / 126.0 >= 20 GROUP BY 1, 2, 3), g AS (SELECT a.signal_id, a.hop, c.c, coalesce(f.v, 0) AS v FROM tot a CROSS JOIN (SELECT unnest(range(12)) AS c) c LEFT JOIN f ON f.signal_id = a.signal_id AND f.hop = a.hop AND f.c = c.c) SELECT signal_id, hop, CAST(c AS BIGINT) AS k, {rs('v / max(v) OVER (PARTITION BY signal_id, hop)', 'chroma')} FROM g"
_EDGE = "CAST(round(pow(63, ({0}) / 5.0)) AS INT)"
ORACLES["spectral_contrast"] = f"WITH {POW} SELECT signal_id, hop, CAST(b AS BIGINT) AS k, {rs('ln(max(p) + 1e-10) - ln(min(p) + 1e-10)', 'contrast')} FROM pw JOIN (SELECT b, {_EDGE.format('b')} AS lo, {_EDGE.format('b + 1')} AS hi FROM (SELECT unnest(range(5)) AS b)) ON k >= lo AND k < hi GROUP BY 1, 2, 3"
_SPEAK = "sp AS (SELECT * FROM (VALUES (0, -110.0), (1, -30.0), (2, 0.0), (3, 30.0), (4, 110.0)) v(c, a))"
_PAIRS = "pr AS (SELECT i, j, ga, gb FROM (SELECT i, j, dot, (px * yb - py * bx) / det AS ga, (py * ax - px * ay) / det AS gb FROM (SELECT p.c AS i, q.c AS j, cos(radians(20)) AS px, sin(radians(20)) AS py, cos(radians(p.a)) AS ax, sin(radians(p.a)) AS ay, cos(radians(q.a)) AS bx, sin(radians(q.a)) AS yb, cos(radians(p.a)) * sin(radians(q.a)) - sin(radians(p.a)) * cos(radians(q.a)) AS det, cos(radians(p.a)) * cos(radians(q.a)) + sin(radians(p.a)) * sin(radians(q.a)) AS dot FROM sp p JOIN sp q ON p.c < q.c) WHERE abs(det) >= 1e-9) WHERE ga >= -1e-9 AND gb >= -1e-9 ORDER BY dot DESC, i, j LIMIT 1)"
ORACLES["vbap"] = f"WITH {USER}, {_SPEAK}, {_PAIRS} SELECT signal_id, n, {', '.join(rs(f'x * CASE {k} WHEN i THEN ga WHEN j THEN gb ELSE 0 END / sqrt(ga * ga + gb * gb)', f'c{k}') for k in range(5))} FROM sig, pr"
_YS = ["1", "sin({a}) * cos({e})", "sin({e})", "cos({a}) * cos({e})", "sqrt(3) / 2 * sin(2 * {a}) * pow(cos({e}), 2)", "sqrt(3) / 2 * sin({a}) * sin(2 * {e})", "(3 * pow(sin({e}), 2) - 1) / 2", "sqrt(3) / 2 * cos({a}) * sin(2 * {e})", "sqrt(3) / 2 * cos(2 * {a}) * pow(cos({e}), 2)"]
_at = lambda a, e, n: [y.format(a=a, e=e) for y in _YS[:n]]
ORACLES["ambisonic_encode"] = f"WITH {USER} SELECT signal_id, n, {', '.join(rs(f'x * {y}', f'w{k}') for k, y in enumerate(_at(0.4, 0.2, 9)))} FROM sig"
ORACLES["ambisonic_decode"] = f"WITH {USER} SELECT signal_id, n, {', '.join(rs('x * (' + ' + '.join(f'({p}) * ({q})' for p, q in zip(_at(0.4, 0.2, 4), _at(f'({a})', 0.0, 4))) + ') / 4', f's{k}') for k, a in enumerate((0.785, -0.785, 2.356, -2.356)))} FROM sig"
