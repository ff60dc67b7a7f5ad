"""Queries over the test tables, one or more per operator, and the SQL each is held against."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions import elementwise as el
from rillflow.functions import tables as tb
from rillflow.operators import blocks as bl
from rillflow.operators import features as ft
from rillflow.operators import generators as gen
from rillflow.operators import history as hi
from rillflow.operators import recurrent as rc
from rillflow.operators import rewindow as rw
from rillflow.operators import spatial as sp
from rillflow.sources import pcm
from rillflow.sources.signals import FRAMES, TYPE, USER, embedding_frames, rows, table, type_signals, user_signals

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "featuregram"


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn

    return add


def r6(c, name: str = "y"):
    """Rounded for comparison; adding zero turns -0 to 0."""
    return (F.round(c, 6) + 0.0).alias(name)


def rs(sql: str, name: str = "y") -> str:
    return f"round({sql}, 6) + 0.0 AS {name}"


def keyed(df: DataFrame, *cols, keys=("signal_id", "n")) -> DataFrame:
    return df.select(*keys, *cols)


def elementwise(name: str, col, sql: str) -> None:
    """A projection of the user signals."""
    query(f"WITH {USER} SELECT signal_id, n, {rs(sql)} FROM sig", name)(lambda s, d, c=col: keyed(user_signals(s, d), r6(c(F.col("x")))))


def arr(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


# Elementwise.
elementwise("gain", lambda x: el.gain(x, 0.5011872336272722), "x * 0.5011872336272722::DOUBLE")
elementwise("trim", lambda x: el.trim(x, -3.0), f"x * {10 ** (-3 / 20)!r}::DOUBLE")
elementwise("soft_clip", lambda x: el.soft_clip(x, 2.5), "(least(1, greatest(-1, x * 2.5)) - pow(least(1, greatest(-1, x * 2.5)), 3) / 3) / 2.5")
elementwise("feature_map", lambda x: el.feature_map(x, 2.0, -0.25, 0.0, 1.0), "greatest(0.0, least(1.0, 2.0 * x - 0.25))")
elementwise("wrap_phase", lambda x: el.wrap_phase(x * 7.3), "x * 7.3 - floor(x * 7.3)")
CODE = "CAST(greatest(-32768, least(32767, round(x * 0.5 * 32768))) AS BIGINT)"


def code():
    return el.quantise(F.col("x") * 0.5)


@query(f"WITH {USER} SELECT signal_id, n, CAST(greatest(-32768, least(32767, floor(({CODE} * 16423 + 16384) / 32768.0))) AS BIGINT) AS y FROM sig")
def gain_q15(s, d):
    return keyed(user_signals(s, d), el.gain_fixed(code(), 16423).alias("y"))


@query(f"WITH {USER} SELECT signal_id, n, {CODE} AS y FROM sig")
def quantise(s, d):
    return keyed(user_signals(s, d), code().alias("y"))


for _form, (_signed, _bits) in el.PCM.items():
    _mid = float(1 << (_bits - 1))
    _v = f"round(x * 0.9 * {_mid!r}::DOUBLE)" if _signed else f"round((x * 0.9 + 1.0) * {_mid!r}::DOUBLE)"
    _lo, _hi = (-_mid, _mid - 1) if _signed else (0.0, 2 * _mid - 1)
    _c = f"CAST(greatest({_lo!r}::DOUBLE, least({_hi!r}::DOUBLE, {_v})) AS BIGINT)"
    _x = f"CAST({_c} AS DOUBLE) / {_mid!r}::DOUBLE" if _signed else f"(CAST({_c} AS DOUBLE) - {_mid!r}::DOUBLE) / {_mid!r}::DOUBLE"

    @query(f"WITH {USER} SELECT signal_id, n, {_c} AS code, {rs(_x)} FROM sig", f"pcm_{_form}")
    def _pcm(s, d, form=_form):
        c = el.pcm_encode(F.col("x") * 0.9, form)
        return keyed(user_signals(s, d), c.alias("code"), r6(el.pcm_decode(c, form)))


@query(f"SELECT doc_id, CAST(len(b) AS BIGINT) AS n, {rs('list_avg(b)', 'mean')}, {rs('list_min(b)', 'low')} FROM (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: (('0x' || h)::INT - 128) / 128.0::DOUBLE) AS b FROM documents)")
def pcm_documents(s, d):
    """The bytes of documents as 8-bit samples; a document without text has none, and no mean."""
    got = pcm.byte_levels(table(s, d, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n", r6(F.col("mean"), "mean"), r6(F.col("low"), "low"))


# Bounded history.
@query(f"WITH {USER} SELECT signal_id, n, {rs('lag(x, 7, 0.0) OVER (PARTITION BY signal_id ORDER BY n)')} FROM sig")
def delay(s, d):
    return keyed(hi.delay(user_signals(s, d), 7), r6(F.col("y")))


@query(f"WITH {USER} SELECT signal_id, n, {rs('lag(x, 1, 0.0) OVER (PARTITION BY signal_id ORDER BY n)')} FROM sig")
def unit_delay(s, d):
    return keyed(hi.delay(user_signals(s, d), 1), r6(F.col("y")))


def tap_sql(taps, source: str = USER) -> str:
    return f"WITH {source}, t AS (SELECT unnest({arr(taps)}) AS c, unnest(range({len(taps)})) AS k) SELECT a.signal_id, a.n, {rs('sum(t.c * b.x)')} FROM sig a JOIN t ON t.k <= a.n JOIN sig b ON b.signal_id = a.signal_id AND b.n = a.n - t.k GROUP BY a.signal_id, a.n"


for _name, _taps in {
    "fir": [0.25, 0.5, 0.25, -0.1, 0.05], "firwin_lowpass": tb.lowpass(17, 0.1), "firwin_highpass": tb.highpass(17, 0.2), "firwin_bandpass": tb.bandpass(17, 0.1, 0.2),
    "firwin_bandstop": tb.bandstop(17, 0.1, 0.2), "partitioned_convolution": [0.97**k * math.cos(k) for k in range(72)],
}.items():

    @query(tap_sql(_taps), _name)
    def _fir(s, d, taps=tuple(float(t) for t in _taps)):
        return keyed(hi.fir(user_signals(s, d), taps), r6(F.col("y")))


_QT = [3277, 9830, 13107, -4915]
_QS = " + ".join(f"coalesce(lag({CODE}, {k}, 0) OVER w, 0) * {c}" for k, c in enumerate(_QT))


@query(f"WITH {USER} SELECT signal_id, n, CAST(greatest(-32768, least(32767, floor(({_QS} + 16384) / 32768.0))) AS BIGINT) AS y FROM sig WINDOW w AS (PARTITION BY signal_id ORDER BY n)")
def fir_q15(s, d):
    return keyed(hi.fir_fixed(user_signals(s, d).withColumn("code", code()), _QT), "y")


_BANDS = tb.cqt_bands(3, 9, 0.05, 2)


@query(f"WITH {USER}, t AS (SELECT unnest({arr(v for b in _BANDS for v in b)}) AS c, unnest(range({_BANDS.size})) AS i) SELECT a.signal_id, a.n, CAST(t.i // 9 AS INT) AS band, {rs('sum(t.c * b.x)')} FROM sig a JOIN t ON t.i % 9 <= a.n JOIN sig b ON b.signal_id = a.signal_id AND b.n = a.n - t.i % 9 GROUP BY a.signal_id, a.n, t.i // 9")
def cqt(s, d):
    got = hi.bank(user_signals(s, d), _BANDS.tolist())
    return got.select("signal_id", "n", F.posexplode("p").alias("band", "v")).select("signal_id", "n", "band", r6(F.col("v")))


@query(f"WITH {USER}, p AS (SELECT *, lag(x, 1, 0.0) OVER (PARTITION BY signal_id ORDER BY n) AS prev FROM sig), j AS (SELECT *, unnest(range(CAST(ceil(n * 1.5) AS BIGINT), CAST(ceil((n + 1) * 1.5) AS BIGINT))) AS j FROM p) SELECT signal_id, j AS n, {rs('prev + (j / 1.5 - n) * (x - prev)')} FROM j")
def varispeed(s, d):
    return keyed(hi.varispeed(user_signals(s, d), 1.5), r6(F.col("y")))


_CH = "least(18.0, greatest(1.0, 8.0 + 4.0 * sin(2 * 3.141592653589793 * (n * 0.013 - floor(n * 0.013)))))"


@query(f"WITH {USER}, a AS (SELECT *, {_CH} AS d FROM sig) SELECT a.signal_id, a.n, {rs('0.7 * a.x + 0.3 * (coalesce(b.x, 0) * (1 - (d - floor(d))) + coalesce(c.x, 0) * (d - floor(d)))')} FROM a LEFT JOIN sig b ON b.signal_id = a.signal_id AND b.n = a.n - floor(d) LEFT JOIN sig c ON c.signal_id = a.signal_id AND c.n = a.n - floor(d) - 1")
def chorus(s, d):
    return keyed(hi.chorus(user_signals(s, d), 8.0, 4.0, 0.013, 0.3, 20), r6(F.col("y")))


def proto_sql(up: int, down: int, half: int) -> str:
    """The converter's prototype (t, c) by its formula."""
    m, most = f"(t - {half})", max(up, down)
    sinc = f"CASE WHEN {m} = 0 THEN 1.0 / {most} ELSE sin(pi() * {m} / {most}) / (pi() * {m}) END"
    return f"t AS (SELECT t, c * {up} / sum(c) OVER () AS c FROM (SELECT t, ({sinc}) * 0.5 * (1 - cos(2 * pi() * t / {2 * half})) AS c FROM (SELECT unnest(range({2 * half + 1})) AS t)))"


@query(f"WITH {USER}, {proto_sql(3, 2, 6)}, l AS (SELECT signal_id, max(n) + 1 AS len FROM sig GROUP BY 1) SELECT signal_id, (n * 3 + t) // 2 AS n, {rs('sum(x * c)')} FROM sig JOIN t ON (n * 3 + t) % 2 = 0 JOIN l USING (signal_id) WHERE (n * 3 + t) // 2 * 2 < len * 3 GROUP BY 1, 2")
def resampler(s, d):
    return keyed(hi.resample(user_signals(s, d), 3, 2, tb.resample_proto(3, 2, 6)), r6(F.col("y")))


@query(f"WITH {USER}, {proto_sql(2, 3, 6)}, l AS (SELECT signal_id, max(n) + 1 AS len FROM sig GROUP BY 1) SELECT signal_id, (n * 2 + t) // 3 AS n, {rs('sum(x * c)')} FROM sig JOIN t ON (n * 2 + t) % 3 = 0 JOIN l USING (signal_id) WHERE (n * 2 + t) // 3 * 3 < len * 2 GROUP BY 1, 2")
def resampler_down(s, d):
    return keyed(hi.resample(user_signals(s, d), 2, 3, tb.resample_proto(2, 3, 6)), r6(F.col("y")))


@query(f"WITH {USER}, {proto_sql(3, 2, 12)}, l AS (SELECT signal_id, max(n) + 1 AS len FROM sig GROUP BY 1) SELECT signal_id, (n * 3 + t + 3) // 2 AS n, {rs('sum(x * c)')} FROM sig JOIN t ON (n * 3 + t + 3) % 2 = 0 JOIN l USING (signal_id) WHERE (n * 3 + t + 3) // 2 * 2 < len * 3 GROUP BY 1, 2")
def runtime_resampler(s, d):
    return keyed(hi.streaming_resample(user_signals(s, d), 3, 2, 4), r6(F.col("y")))


_I0 = "list_sum(list_transform(range(40), lambda k: pow({0} / 2, 2 * k) / pow(gamma(k + 1), 2)))"
_KAISER = _I0.format("(5.0 * sqrt(greatest(0.0, 1 - pow((t - 30) / 30.0, 2))))") + " / " + _I0.format("5.0")


@query(f"WITH {USER}, t AS (SELECT t, c * 2 / sum(c) OVER () AS c FROM (SELECT t, (CASE WHEN t = 30 THEN 1.0 ELSE sin(pi() * (t - 30) / 3) / (pi() * (t - 30) / 3) END) * {_KAISER} AS c FROM (SELECT unnest(range(61)) AS t))), l AS (SELECT signal_id, max(n) + 1 AS len FROM sig GROUP BY 1) SELECT signal_id, (n * 2 + t - 30) // 3 AS n, {rs('sum(x * c)')} FROM sig JOIN t ON (n * 2 + t - 30) % 3 = 0 AND n * 2 + t >= 30 JOIN l USING (signal_id) WHERE (n * 2 + t - 30) // 3 * 3 < len * 2 GROUP BY 1, 2")
def resample_to(s, d):
    """From 48 to 32 thousand samples a second, without delay."""
    return keyed(hi.resample_to(user_signals(s, d), 48_000, 32_000), r6(F.col("y")))


@query(f"WITH {USER}, l AS (SELECT signal_id, max(n) + 1 AS len FROM sig GROUP BY 1) SELECT a.signal_id, a.n, {rs('b.x')} FROM (SELECT signal_id, len, unnest(range(len * 2)) AS n FROM l) a JOIN sig b ON b.signal_id = a.signal_id AND b.n = a.n % a.len")
def looped_source(s, d):
    df = user_signals(s, d)
    size = df.groupBy("signal_id").agg((F.max("n") + 1).alias("len"))
    out = size.select("signal_id", "len", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") * 2 - 1)).alias("n"))
    return keyed(hi.gather(df, out, F.col("n") % F.col("len")), r6(F.col("_v")))


@query(f"WITH {USER}, o AS (SELECT signal_id, n, n * 0.75 AS c FROM sig) SELECT o.signal_id, o.n, {rs('coalesce(a.x, 0) + (c - floor(c)) * (coalesce(b.x, 0) - coalesce(a.x, 0))')} FROM o LEFT JOIN sig a ON a.signal_id = o.signal_id AND a.n = floor(c) LEFT JOIN sig b ON b.signal_id = o.signal_id AND b.n = floor(c) + 1")
def sample_player(s, d):
    df = user_signals(s, d)
    at = df.select("signal_id", "n").withColumn("c", F.col("n") * 0.75)
    one = hi.gather(df, at, F.floor("c")).withColumnRenamed("_v", "a")
    return keyed(hi.gather(df, one, F.floor("c") + 1), r6(F.col("a") + (F.col("c") - F.floor("c")) * (F.col("_v") - F.col("a"))))


@query(f"WITH {USER}, g AS (SELECT signal_id, n, CASE WHEN n % 5 < 3 THEN x END AS x FROM sig) SELECT signal_id, n, {rs('coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY signal_id ORDER BY n), 0)')} FROM g")
def hold_last(s, d):
    """A source that holds its last sample where a packet is missing."""
    df = user_signals(s, d).withColumn("x", F.when(F.col("n") % 5 < 3, F.col("x")))
    return keyed(df, r6(F.coalesce(F.last("x", ignorenulls=True).over(hi.order().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))))


# Blocks and controllers.
N = 16
BLOCKS = f"b AS (SELECT signal_id, n // {N} AS block, avg(x * x) AS power FROM sig GROUP BY 1, 2)"
RAMP = f"SELECT sig.signal_id, n, {rs(f'x * (g0 + (n % {N} + 1) * (g - g0) / {N})')} FROM sig JOIN (SELECT *, lag(g, 1, 1.0) OVER (PARTITION BY signal_id ORDER BY block) AS g0 FROM g) q ON q.signal_id = sig.signal_id AND q.block = sig.n // {N}"


@query(f"WITH {USER}, {BLOCKS} SELECT signal_id, block, {rs('power')} FROM b")
def block_power(s, d):
    return keyed(bl.block_power(user_signals(s, d), N), r6(F.col("power")), keys=("signal_id", "block"))


@query(f"WITH {USER}, g AS (SELECT DISTINCT signal_id, n // {N} AS block, 0.5312947 + 0.2171357 * (n // {N} % 3) AS g FROM sig) {RAMP}")
def vca(s, d):
    df = user_signals(s, d)
    g = df.select("signal_id", F.expr(f"n div {N}").alias("block")).distinct().withColumn("g", 0.5312947 + 0.2171357 * (F.col("block") % 3))
    return keyed(bl.ramped(df, g, N), r6(F.col("y")))


_AGC = f"WITH RECURSIVE {USER}, {BLOCKS}, g AS (SELECT signal_id, block, 1.0 + 0.1 * (least(0.25 / greatest(sqrt(power), 1e-9), 8.0) - 1.0) AS g FROM b WHERE block = 0 UNION ALL SELECT b.signal_id, b.block, g.g + 0.1 * (least(0.25 / greatest(sqrt(b.power), 1e-9), 8.0) - g.g) FROM g JOIN b ON b.signal_id = g.signal_id AND b.block = g.block + 1)"


@query(f"{_AGC} SELECT signal_id, block, {rs('g')} FROM g")
def agc_controller(s, d):
    return keyed(bl.agc_gains(user_signals(s, d), N), r6(F.col("g")), keys=("signal_id", "block"))


@query(f"{_AGC} {RAMP}")
def agc(s, d):
    return keyed(bl.agc(user_signals(s, d), N), r6(F.col("y")))


@query(f"WITH {USER}, {BLOCKS} SELECT signal_id, block, CAST(coalesce(last_value(CASE WHEN power > 0.05 THEN 1 WHEN power < 0.03 THEN 0 END IGNORE NULLS) OVER (PARTITION BY signal_id ORDER BY block), 0) AS INT) AS gate FROM b")
def power_gate(s, d):
    return bl.power_gate(user_signals(s, d), N, 0.05, 0.03)


@query(f"WITH {USER}, p AS (SELECT signal_id, n * 3 AS at, x AS value FROM sig WHERE n % 7 = 2), k AS (SELECT DISTINCT signal_id, n // {N} AS block FROM sig) SELECT k.signal_id, k.block, {rs('coalesce((SELECT p.value FROM p WHERE p.signal_id = k.signal_id AND p.at <= k.block * 16 ORDER BY p.at DESC LIMIT 1), 1.0)')} FROM k")
def scheduled_parameters(s, d):
    df = user_signals(s, d)
    p = df.where("n % 7 = 2").select("signal_id", (F.col("n") * 3).alias("at"), F.col("x").alias("value"))
    return keyed(bl.scheduled(df, p, N), r6(F.col("value")), keys=("signal_id", "block"))


@query("SELECT event_id, event_type AS signal_id, greatest(event_id * 13 % 977, 32) // 16 AS block, CAST(greatest(event_id * 13 % 977, 32) % 16 AS BIGINT) AS \"offset\" FROM events")
def event_lane(s, d):
    e = table(s, d, "events").select("event_id", F.col("event_type").alias("signal_id"), (F.col("event_id") * 13 % 977).alias("at"))
    return bl.event_lane(e, 16, blocks_from=2).select("event_id", "signal_id", "block", "offset")


# Recurrences.
def recursive(state: dict[str, str], first: dict[str, str], out: str, source: str = USER, extra: str = "") -> str:
    """A recursive query: first rows from x at n = 0, then each state column by an expression in r (before) and s (now)."""
    cols = ", ".join(state)
    one = ", ".join(f"{first[k]} AS {k}" for k in state)
    then = ", ".join(f"{v} AS {k}" for k, v in state.items())
    return f"WITH RECURSIVE {source}{extra}, r AS (SELECT s.signal_id, s.n, {one} FROM sig s WHERE s.n = 0 UNION ALL SELECT s.signal_id, s.n, {then} FROM r JOIN sig s ON s.signal_id = r.signal_id AND s.n = r.n + 1) SELECT signal_id, n, {out} FROM r"


def recurrence(name: str, kernel, sql: str | None, cols=("x",), out=("y",), prepare=lambda df: df) -> None:
    @query(sql, name)
    def _run(s, d):
        return keyed(rc.run(prepare(user_signals(s, d)), kernel, cols, out), *[r6(F.col(k), k) for k in out])


_ONE = recursive({"y": "r.y + 0.1 * (s.x - r.y)"}, {"y": "0.1 * s.x"}, rs("y"))
recurrence("one_pole", rc.one_pole(0.1), _ONE)
query(_ONE, "one_pole_affine_scan")(lambda s, d: keyed(rc.affine_scan(user_signals(s, d), 0.1), r6(F.col("y"))))
query(_ONE, "one_pole_chunked")(lambda s, d: keyed(rc.run_chunked(user_signals(s, d), rc.one_pole(0.1), 400, 380), r6(F.col("y"))))
_BQ = recursive(
    {"y": "0.2 * s.x + r.z1", "z1": "0.3 * s.x + r.z2 + 0.5 * (0.2 * s.x + r.z1)", "z2": "0.1 * s.x - 0.2 * (0.2 * s.x + r.z1)"},
    {"y": "0.2 * s.x", "z1": "0.3 * s.x + 0.5 * (0.2 * s.x)", "z2": "0.1 * s.x - 0.2 * (0.2 * s.x)"}, rs("y"))
recurrence("biquad", rc.biquad(0.2, 0.3, 0.1, -0.5, 0.2), _BQ)
_BF = "CAST(greatest(-32768, least(32767, floor(({}) / 8192.0))) AS BIGINT)"
_CS = CODE.replace("x", "s.x")
query(
    recursive(
        {"y": _BF.format(f"50 * {_CS} + 100 * r.x1 + 50 * r.x2 + 14000 * r.y - 6500 * r.y1 + 4096"), "x1": _CS, "x2": "r.x1", "y1": "r.y"},
        {"y": _BF.format(f"50 * {_CS} + 4096"), "x1": _CS, "x2": "0::BIGINT", "y1": "0::BIGINT"}, "y"), "biquad_q15"
)(lambda s, d: rc.run(user_signals(s, d).withColumn("code", code()), rc.biquad_fixed(50, 100, 50, -14000, 6500), ("code",), ("y",), "long"))
_G = math.tan(math.pi * 0.1)
_HP = f"((s.x - ({_G!r} + 1.25) * {{0}} - {{1}}) / (1 + {_G!r} * ({_G!r} + 1.25)))"
for _mode in ("lowpass", "bandpass", "highpass"):
    _hp, _hp0 = _HP.format("r.s1", "r.s2"), _HP.format("0", "0")
    _o = {"lowpass": ("{g} * ({g} * {h} + {a}) + {b}"), "bandpass": "{g} * {h} + {a}", "highpass": "{h}"}[_mode]
    _f = lambda t, h, a, b: t.format(g=repr(_G), h=h, a=a, b=b)
    _st = {"y": _o, "s1": "2 * {g} * {h} + {a}", "s2": "2 * {g} * ({g} * {h} + {a}) + {b}"}
    recurrence(f"state_variable_{_mode}", rc.state_variable(0.1, 0.8, _mode), recursive({k: _f(v, _hp, "r.s1", "r.s2") for k, v in _st.items()}, {k: _f(v, _hp0, "0", "0") for k, v in _st.items()}, rs("y")))
_L1 = "r.s1 + 0.3 * (s.x - 0.5 * r.s4 - r.s1)"
_L2 = f"r.s2 + 0.3 * ({_L1} - r.s2)"
_L3 = f"r.s3 + 0.3 * ({_L2} - r.s3)"
_L4 = f"r.s4 + 0.3 * ({_L3} - r.s4)"
recurrence("ladder", rc.ladder(0.3, 0.5), recursive({"s1": _L1, "s2": _L2, "s3": _L3, "s4": _L4}, {f"s{k}": f"{0.3**k!r}::DOUBLE * s.x" for k in range(1, 5)}, rs("s4")))


def lane_sql(step: str, first: str) -> str:
    return f"WITH RECURSIVE {USER}, r AS (SELECT signal_id, n, x, {first} AS y FROM sig WHERE n < 7 UNION ALL SELECT s.signal_id, s.n, s.x, {step} AS y FROM r JOIN sig s ON s.signal_id = r.signal_id AND s.n = r.n + 7) SELECT signal_id, n, {rs('y')} FROM r"


_COMB, _ALL = lane_sql("s.x + 0.6 * r.y", "x"), lane_sql("-0.47 * s.x + r.x + 0.47 * r.y", "-0.47 * x")
recurrence("comb", rc.comb(7, 0.6), _COMB)
recurrence("allpass", rc.allpass(7, 0.47), _ALL)
query(_COMB, "comb_lanes")(lambda s, d: keyed(rc.lanes(user_signals(s, d), 7, 0.6), r6(F.col("y"))))
query(_ALL, "allpass_lanes")(lambda s, d: keyed(rc.lanes(user_signals(s, d), 7, 0.0, 0.47), r6(F.col("y"))))
recurrence("karplus_strong", rc.karplus_strong(3), recursive({"y": "s.x + 0.498 * (r.y2 + r.y3)", "y1": "r.y", "y2": "r.y1", "y3": "r.y2"}, {"y": "s.x", "y1": "0.0::DOUBLE", "y2": "0.0::DOUBLE", "y3": "0.0::DOUBLE"}, rs("y")))
recurrence("flanger", rc.flanger(20, 8.0, 4.0, 0.013, 0.4, 0.5), None)
_ENV = recursive({"x": "s.x", "e": "r.e + (CASE WHEN abs(s.x) > r.e THEN 0.3 ELSE 0.05 END) * (abs(s.x) - r.e)"}, {"x": "s.x", "e": "0.3 * abs(s.x)"}, "{}")
recurrence("envelope", rc.envelope(0.3, 0.05), _ENV.format(rs("e")))
for _kind, _gain in {"compressor": "CASE WHEN greatest(e, 1e-12) / 0.2 > 1 THEN pow(greatest(e, 1e-12) / 0.2, -0.75) ELSE 1 END", "limiter": "least(1, 1 / (greatest(e, 1e-12) / 0.2))", "expander": "CASE WHEN greatest(e, 1e-12) / 0.2 < 1 THEN pow(greatest(e, 1e-12) / 0.2, 3) ELSE 1 END"}.items():
    recurrence(_kind, rc.dynamics(_kind, 0.3, 0.05, 0.2), _ENV.format(f"{rs(f'x * ({_gain})')}, {rs(_gain, 'g')}"), out=("y", "g"))


@query(f"SELECT signal_id, n // 16 AS block, round(max_by({'CASE WHEN greatest(e, 1e-12) / 0.2 > 1 THEN pow(greatest(e, 1e-12) / 0.2, -0.75) ELSE 1 END'}, n), 6) + 0.0 AS y FROM ({_ENV.format('x, e')}) GROUP BY 1, 2")
def compressor_controller(s, d):
    got = rc.run(user_signals(s, d), rc.dynamics("compressor", 0.3, 0.05, 0.2), out=("y", "g"))
    return bl.block_end(got, N, "g").select("signal_id", "block", r6(F.col("g")))


_two = lambda df: df.withColumn("ref", F.lag("x", 2, 0.0).over(hi.order()))
recurrence("aec", rc.nlms(8, 0.5), None, ("x", "ref"), prepare=_two)
recurrence("howl_suppressor", rc.nlms(8, 0.5, leak=0.01), None, ("x", "ref"), prepare=_two)
query(None, "time_stretch")(lambda s, d: keyed(rc.time_stretch(user_signals(s, d), 16, 1.25), r6(F.col("y"))))
query(None, "pitch_shift")(lambda s, d: keyed(rc.pitch_shift(user_signals(s, d), 16, 1.25), r6(F.col("y"))))
query(None, "noise_shaper")(lambda s, d: rc.run(user_signals(s, d), rc.noise_shaper(), out=("y",), kind="long"))


# Re-windowing and spectra.
FR, HOP = 64, 16
_W = f"0.5 * (1 - cos(2 * pi() * j / {FR}))"
FRAMED = f"{TYPE}, fj AS (SELECT signal_id, hop, n - ((hop + 1) * {HOP} - {FR}) AS j, x FROM (SELECT signal_id, n, x, unnest(range(n // {HOP}, (n + {FR}) // {HOP})) AS hop FROM sig) JOIN (SELECT signal_id, (max(n) + 1) // {HOP} AS hops FROM sig GROUP BY 1) USING (signal_id) WHERE hop < hops)"
SPEC = f"{FRAMED}, sp AS (SELECT signal_id, hop, k, sum(x * {_W} * cos(2 * pi() * k * j / {FR})) AS re, -sum(x * {_W} * sin(2 * pi() * k * j / {FR})) AS im FROM fj, (SELECT unnest(range({FR // 2 + 1})) AS k) GROUP BY 1, 2, 3)"


def spec(s, d):
    return rw.stft(type_signals(s, d), FR, HOP)


def long_form(df: DataFrame, *cols: str) -> DataFrame:
    return df.select("signal_id", "hop", F.posexplode(F.arrays_zip(*cols)).alias("k", "z")).select("signal_id", "hop", F.col("k").cast("long").alias("k"), *[r6(F.col(f"z.{c}"), c) for c in cols])


@query(f"WITH {FRAMED} SELECT signal_id, hop, CAST(j AS BIGINT) AS k, {rs(f'x * {_W}', 's')} FROM fj")
def framer(s, d):
    got = long_form(rw.frames(type_signals(s, d), FR, HOP), "s")
    return got.where((F.col("hop") + 1) * HOP - FR + F.col("k") >= 0)


@query(f"WITH {SPEC} SELECT signal_id, hop, k, {rs('re', 're')}, {rs('im', 'im')} FROM sp")
def stft(s, d):
    return long_form(spec(s, d), "re", "im")


@query(f"WITH {SPEC} SELECT signal_id, hop, k, {rs('re', 're')}, {rs('im', 'im')} FROM sp")
def stft_relational(s, d):
    return long_form(rw.relational_dft(rw.frames(type_signals(s, d), FR, HOP), FR), "re", "im")


@query(f"WITH {SPEC} SELECT signal_id, hop, k, {rs('re * re + im * im', 'p')} FROM sp")
def power_spectrum(s, d):
    return long_form(rw.power(spec(s, d)), "p")


@query(f"WITH {SPEC} SELECT signal_id, hop, k, {rs('CASE WHEN re * re + im * im >= 1 THEN re ELSE 0 END', 're')}, {rs('CASE WHEN re * re + im * im >= 1 THEN im ELSE 0 END', 'im')} FROM sp")
def spectral_gate(s, d):
    return long_form(rw.spectral_gate(spec(s, d), 1.0), "re", "im")


@query(f"WITH {SPEC} SELECT signal_id, hop, k, {rs('re / (1 + k)', 're')}, {rs('im / (1 + k)', 'im')} FROM sp")
def spectral_eq(s, d):
    return long_form(rw.spectral_eq(spec(s, d), [1 / (1 + k) for k in range(FR // 2 + 1)]), "re", "im")


@query(f"WITH {FRAMED} SELECT signal_id, (hop * {HOP} + j) AS n, {rs(f'sum(x * {_W})')} FROM fj JOIN (SELECT signal_id, max(hop) + 1 AS top FROM fj GROUP BY 1) USING (signal_id) WHERE hop * {HOP} + j < top * {HOP} GROUP BY 1, 2")
def istft(s, d):
    """Overlap-added frames; places that only padding reaches are left out, as the SQL has no padded rows."""
    got = rw.istft(spec(s, d), FR, HOP)
    return keyed(got.where(F.col("n") >= FR - HOP), r6(F.col("y")))


ORACLES["istft"] += f" HAVING (hop * {HOP} + j) >= {FR - HOP}"
_H = f"h AS (SELECT signal_id, n // 2 AS m, (max(x) FILTER (WHERE n % 2 = 0) + max(x) FILTER (WHERE n % 2 = 1)) * {2**-0.5!r} AS lo, (max(x) FILTER (WHERE n % 2 = 0) - max(x) FILTER (WHERE n % 2 = 1)) * {2**-0.5!r} AS hi FROM sig GROUP BY 1, 2 HAVING count(*) = 2)"


@query(f"WITH {USER}, {_H} SELECT signal_id, m, {rs('lo', 'lo')}, {rs('hi', 'hi')} FROM h")
def wavelet_analysis(s, d):
    return rw.haar(user_signals(s, d)).select("signal_id", "m", r6(F.col("lo"), "lo"), r6(F.col("hi"), "hi"))


@query(f"WITH {USER}, l AS (SELECT signal_id, (max(n) + 1) // 2 * 2 AS len FROM sig GROUP BY 1) SELECT signal_id, n, {rs('x')} FROM sig JOIN l USING (signal_id) WHERE n < len")
def wavelet_synthesis(s, d):
    return keyed(rw.haar_inverse(rw.haar(user_signals(s, d))), r6(F.col("y")))


_HN = lambda t, src: f"{t} AS (SELECT signal_id, m // 2 AS m, (max(lo) FILTER (WHERE m % 2 = 0) + max(lo) FILTER (WHERE m % 2 = 1)) * {2**-0.5!r} AS lo, (max(lo) FILTER (WHERE m % 2 = 0) - max(lo) FILTER (WHERE m % 2 = 1)) * {2**-0.5!r} AS hi FROM {src} GROUP BY 1, 2 HAVING count(*) = 2)".replace("signal_id, m // 2 AS m", "signal_id, m // 2 AS mm").replace("GROUP BY 1, 2", "GROUP BY signal_id, m // 2")


@query(f"WITH {USER}, {_H}, {_HN('h2', 'h')} SELECT signal_id, 1 AS level, m, {rs('hi', 'c')} FROM h UNION ALL SELECT signal_id, 2, mm, {rs('hi', 'c')} FROM h2 UNION ALL SELECT signal_id, 3, mm, {rs('lo', 'c')} FROM h2")
def dwt_octave_tree(s, d):
    return rw.dwt(user_signals(s, d), 2).select("signal_id", "level", "m", r6(F.col("c"), "c"))


# Features, on the squared embedding frames.
POW = f"{FRAMES}, pw AS (SELECT signal_id, hop, unnest(range(64)) AS k, unnest(list_transform(s, lambda v: v * v)) AS p FROM fr), tot AS (SELECT signal_id, hop, sum(p) AS t, sum(k * p) / sum(p) AS c FROM pw GROUP BY 1, 2)"


def powers(s, d):
    return embedding_frames(s, d).select("signal_id", "hop", F.transform("s", lambda v: v * v).alias("p"))


def feature(name: str, col, sql: str) -> None:
    query(f"WITH {POW} SELECT signal_id, hop, {rs(sql)} FROM pw JOIN tot USING (signal_id, hop) GROUP BY signal_id, hop", name)(lambda s, d, c=col: keyed(powers(s, d), r6(c()), keys=("signal_id", "hop")))


feature("rms", ft.rms, "sqrt(avg(p))")
feature("spectral_centroid", ft.centroid, "sum(k * p) / sum(p)")
feature("hfc", ft.hfc, "sum(k * p)")
feature("spectral_flatness", ft.flatness, "greatest(0, least(1, exp(avg(ln(greatest(p, 1e-20)))) / avg(p)))")
feature("spectral_entropy", ft.entropy, "-sum(CASE WHEN p > 0 THEN p / t * ln(p / t) ELSE 0 END) / ln(64)")
feature("spectral_crest", ft.crest, "max(p) / avg(p)")


@query(f"WITH {POW} SELECT signal_id, hop, CAST(arg_min(k, (-p, k)) AS INT) AS bin FROM pw GROUP BY 1, 2")
def dominant_band(s, d):
    return keyed(powers(s, d), ft.dominant().alias("bin"), keys=("signal_id", "hop"))


@query(f"WITH {POW}, q AS (SELECT signal_id, hop, sqrt(sum((k - c) * (k - c) * p) / max(t)) AS sd, sum(pow(k - c, 3) * p) / max(t) AS m3, sum(pow(k - c, 4) * p) / max(t) AS m4 FROM pw JOIN tot USING (signal_id, hop) GROUP BY 1, 2) SELECT signal_id, hop, {rs('sd', 'spread')}, {rs('m3 / pow(sd, 3)', 'skewness')}, {rs('m4 / pow(sd, 4)', 'kurtosis')} FROM q")
def spectral_spread(s, d):
    return keyed(ft.spread(powers(s, d)), *[r6(F.col(k), k) for k in ("spread", "skewness", "kurtosis")], keys=("signal_id", "hop"))


@query(f"WITH {POW}, c AS (SELECT signal_id, hop, k, t, sum(p) OVER (PARTITION BY signal_id, hop ORDER BY k) AS run FROM pw JOIN tot USING (signal_id, hop)) SELECT signal_id, hop, CAST(min(k) AS INT) AS bin FROM c WHERE run >= 0.85 * t GROUP BY 1, 2")
def spectral_rolloff(s, d):
    return keyed(powers(s, d), ft.rolloff().alias("bin"), keys=("signal_id", "hop"))


@query(f"WITH {POW} SELECT a.signal_id, a.hop, {rs('sqrt(sum(pow(greatest(0, a.p - coalesce(b.p, 0)), 2)))')} FROM pw a LEFT JOIN pw b ON b.signal_id = a.signal_id AND b.hop = a.hop - 1 AND b.k = a.k GROUP BY 1, 2")
def spectral_flux(s, d):
    return keyed(ft.flux(powers(s, d)), r6(F.col("flux")), keys=("signal_id", "hop"))


_MEL, _DCT = tb.mel_bank(64), tb.dct(20)


@query(f"WITH {POW}, mel AS (SELECT unnest(range({_MEL.size})) AS i, unnest({arr(_MEL.ravel())}) AS w), e AS (SELECT signal_id, hop, i // 64 AS b, ln(greatest(sum(w * p), 1e-10)) AS e FROM pw JOIN mel ON i % 64 = k GROUP BY 1, 2, 3), dc AS (SELECT unnest(range({_DCT.size})) AS i, unnest({arr(_DCT.ravel())}) AS w) SELECT signal_id, hop, i // 26 AS k, {rs('sum(w * e)', 'mfcc')} FROM e JOIN dc ON i % 26 = b GROUP BY 1, 2, 3")
def mfcc(s, d):
    return long_form(ft.mfcc(powers(s, d), 64), "mfcc")


_PC = "[" + ", ".join(map(str, ft.pitch_class(64))) + "]"


@query(f"WITH {POW}, f AS (SELECT signal_id, hop, {_PC}[k + 1] AS c, sum(p) AS v FROM pw WHERE {_PC}[k + 1] >= 0 GROUP BY 1, 2, 3), g AS (SELECT a.signal_id, a.hop, c.c, coalesce(f.v, 0) AS v FROM tot a CROSS JOIN (SELECT unnest(range(12)) AS c) c LEFT JOIN f ON f.signal_id = a.signal_id AND f.hop = a.hop AND f.c = c.c) SELECT signal_id, hop, CAST(c AS BIGINT) AS k, {rs('v / max(v) OVER (PARTITION BY signal_id, hop)', 'chroma')} FROM g")
def chroma(s, d):
    return long_form(ft.chroma(powers(s, d), 64), "chroma")


_E = ft.contrast_edges(64, 5)
_EV = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(_E, _E[1:])))


@query(f"WITH {POW} SELECT signal_id, hop, CAST(b AS BIGINT) AS k, {rs('ln(max(p) + 1e-10) - ln(min(p) + 1e-10)', 'contrast')} FROM pw JOIN (VALUES {_EV}) v(b, lo, hi) ON k >= lo AND k < hi GROUP BY 1, 2, 3")
def spectral_contrast(s, d):
    return long_form(ft.contrast(powers(s, d), 64, 5), "contrast")


def held_sql(frames: str, bins: int) -> str:
    """r(signal_id, hop, s, held) over frames(signal_id, hop, p): the smoothed power and the bin that is held."""
    c = "list_position({0}, list_max({0})) - 1"
    take = f"CASE WHEN list_max({{0}}) > 1.5 * {{0}}[{{1}} + 1] THEN {c} ELSE {{1}} END"
    mix = "list_transform(range({n}), lambda k: 0.7 * r.s[k + 1] + 0.3 * f.p[k + 1])".format(n=bins)
    first = "list_transform(f.p, lambda v: 0.3 * v)"
    return f"r AS (SELECT f.signal_id, f.hop, {first} AS s, CAST({take.format(first, 0)} AS INT) AS held FROM {frames} f WHERE f.hop = 0 UNION ALL SELECT f.signal_id, f.hop, {mix} AS s, CAST({take.format(mix, 'r.held')} AS INT) AS held FROM r JOIN {frames} f ON f.signal_id = r.signal_id AND f.hop = r.hop + 1)"


@query(f"WITH RECURSIVE {FRAMES}, q AS (SELECT signal_id, hop, list_transform(s, lambda v: v * v) AS p FROM fr), {held_sql('q', 64)} SELECT signal_id, hop, held AS bin FROM r")
def dominant_band_hysteresis(s, d):
    return ft.dominant_hysteresis(powers(s, d))


@query(f"WITH {FRAMES} SELECT signal_id, hop, {rs('list_sum(list_transform(range(1, 64), lambda i: CASE WHEN (s[i] < 0) <> (s[i + 1] < 0) THEN 1.0 ELSE 0.0 END)) / 63')} FROM fr")
def zcr(s, d):
    return keyed(embedding_frames(s, d), r6(ft.zcr()), keys=("signal_id", "hop"))


@query(f"WITH {FRAMES} SELECT signal_id, hop, {rs('list_sum(list_transform(range(2, 64), lambda i: s[i] * s[i] - s[i - 1] * s[i + 1])) / 62')} FROM fr")
def teo_mean(s, d):
    return keyed(embedding_frames(s, d), r6(ft.teo()), keys=("signal_id", "hop"))


@query(f"WITH RECURSIVE {FRAMES}, v AS (SELECT signal_id, hop, least(1.0, list_max(list_transform(s, lambda q: abs(q)))) AS v FROM fr), r AS (SELECT signal_id, hop, 0.6 * v AS e FROM v WHERE hop = 0 UNION ALL SELECT v.signal_id, v.hop, r.e + (CASE WHEN v.v > r.e THEN 0.6 ELSE 0.05 END) * (v.v - r.e) FROM r JOIN v ON v.signal_id = r.signal_id AND v.hop = r.hop + 1) SELECT signal_id, hop, {rs('e')} FROM r")
def ballistic_envelope(s, d):
    return keyed(ft.ballistic(embedding_frames(s, d)), r6(F.col("envelope")), keys=("signal_id", "hop"))


# Generators.
LINE = "SELECT 'gen' AS signal_id, n, {} FROM (SELECT unnest(range(4096)) AS n)"
_P = "(n * ({i!r}::DOUBLE) - floor(n * ({i!r}::DOUBLE)))".format(i=440 / 48000.0)
_BLEP = lambda p: f"(CASE WHEN {p} < {440 / 48000.0!r} THEN 2 * {p} / {440 / 48000.0!r} - pow({p} / {440 / 48000.0!r}, 2) - 1 WHEN {p} > 1 - {440 / 48000.0!r} THEN pow(({p} - 1) / {440 / 48000.0!r}, 2) + 2 * ({p} - 1) / {440 / 48000.0!r} + 1 ELSE 0 END)"
_P2 = f"({_P} + 0.5 - floor({_P} + 0.5))"
for _name, _fn, _sql in (
    ("sine", lambda x: gen.sine(x, 440.0), f"sin(2 * pi() * {_P})"),
    ("polyblep_saw", lambda x: gen.saw(x, 440.0), f"2 * {_P} - 1 - {_BLEP(_P)}"),
    ("polyblep_square", lambda x: gen.square(x, 440.0), f"(CASE WHEN {_P} < 0.5 THEN 1 ELSE -1 END) + {_BLEP(_P)} - {_BLEP(_P2)}"),
    ("constant", lambda x: gen.constant(x, 0.25), "0.25::DOUBLE"),
    ("wavetable", lambda x: gen.wavetable(x, [0.0, 1.0, 0.5, -1.0], 440.0), f"[0.0, 1.0, 0.5, -1.0][CAST(floor({_P} * 4) AS INT) % 4 + 1] + ({_P} * 4 - floor({_P} * 4)) * ([0.0, 1.0, 0.5, -1.0][(CAST(floor({_P} * 4) AS INT) + 1) % 4 + 1] - [0.0, 1.0, 0.5, -1.0][CAST(floor({_P} * 4) AS INT) % 4 + 1])"),
):
    query(LINE.format(rs(_sql)), _name)(lambda s, d, f=_fn: keyed(f(rows(s, 4096)), r6(F.col("y"))))
_LP = "(n * 16 * 0.013 - floor(n * 16 * 0.013))"
for _form, _sql in {"sine": f"sin(2 * pi() * {_LP})", "triangle": f"1 - 4 * abs({_LP} - 0.5)", "saw": f"2 * {_LP} - 1", "square": f"CASE WHEN {_LP} < 0.5 THEN 1 ELSE -1 END"}.items():
    query(f"SELECT n AS block, {rs(f'0.5 + 0.4 * ({_sql})')} FROM (SELECT unnest(range(256)) AS n)", f"lfo_{_form}")(lambda s, d, f=_form: gen.lfo(s.range(256).select(F.col("id").alias("block")), 0.013, 16, 0.4, 0.5, f).select("block", r6(F.col("y"))))
query(f"WITH RECURSIVE r AS (SELECT 0::BIGINT AS n, (12345::HUGEINT * {gen.LCG_A}::HUGEINT + {gen.LCG_C}) % 18446744073709551616::HUGEINT AS st UNION ALL SELECT n + 1, CAST((CAST(st // 4294967296 AS HUGEINT) * {gen.LCG_A}::HUGEINT % 4294967296 * 4294967296 + st % 4294967296 * {gen.LCG_A}::HUGEINT + {gen.LCG_C}) % 18446744073709551616::HUGEINT AS HUGEINT) FROM r WHERE n < 511) SELECT 'gen' AS signal_id, n, {rs('CAST(st // 4294967296 AS DOUBLE) / 2147483648.0 - 1')} FROM r", "noise")(lambda s, d: keyed(gen.noise(rows(s, 512), 12345), r6(F.col("y"))))


# a state machine by sample: stage 0 idle, 1 attack, 2 decay, 3 sustain, 4 release; edges at block starts
_STG = "CASE WHEN s.i = 0 THEN CASE WHEN s.gate = 1 THEN CASE WHEN r.st IN (0, 4) THEN 1 ELSE r.st END ELSE CASE WHEN r.st <> 0 THEN 4 ELSE 0 END END ELSE r.st END"
_STEP = "CASE {st} WHEN 1 THEN least(1.0, {l} + 1 / 32.0) WHEN 2 THEN greatest(0.5, {l} - 1 / 64.0) WHEN 3 THEN 0.5 WHEN 4 THEN greatest(0.0, {l} - 1 / 128.0) ELSE {l} END"
_NEXT = "CASE {st} WHEN 1 THEN CASE WHEN {l} + 1 / 32.0 >= 1 THEN 2 ELSE 1 END WHEN 2 THEN CASE WHEN {l} - 1 / 64.0 <= 0.5 THEN 3 ELSE 2 END WHEN 4 THEN CASE WHEN {l} - 1 / 128.0 <= 0 THEN 0 ELSE 4 END ELSE {st} END"


@query(f"WITH RECURSIVE {USER}, b AS (SELECT signal_id, n // 8 AS block, avg(x * x) AS power FROM sig GROUP BY 1, 2), g AS (SELECT signal_id, block, coalesce(last_value(CASE WHEN power > 0.05 THEN 1 WHEN power < 0.03 THEN 0 END IGNORE NULLS) OVER (PARTITION BY signal_id ORDER BY block), 0) AS gate FROM b), s AS (SELECT signal_id, block, gate, i, block * 8 + i AS t FROM g, (SELECT unnest(range(8)) AS i)), r AS (SELECT signal_id, t, i, block, CASE WHEN gate = 1 THEN 1 ELSE 0 END AS st0, 0.0::DOUBLE AS l0, CAST({_NEXT.format(st='gate', l='0.0')} AS INT) AS st, CAST({_STEP.format(st='gate', l='0.0')} AS DOUBLE) AS l FROM s WHERE t = 0 UNION ALL SELECT signal_id, t, i, block, st0, l0, CAST({_NEXT.format(st='st0', l='l0')} AS INT) AS st, CAST({_STEP.format(st='st0', l='l0')} AS DOUBLE) AS l FROM (SELECT s.signal_id, s.t, s.i, s.block, {_STG} AS st0, r.l AS l0 FROM r JOIN s ON s.signal_id = r.signal_id AND s.t = r.t + 1)) SELECT signal_id, block, {rs('l0')} FROM r WHERE i = 0")
def adsr(s, d):
    gates = bl.power_gate(user_signals(s, d), 8, 0.05, 0.03)
    return keyed(gen.adsr(gates, 8), r6(F.col("y")), keys=("signal_id", "block"))


def notes(s, d) -> DataFrame:
    """Views start a note, clicks end one."""
    e = table(s, d, "events").where("event_type in ('view', 'click')")
    return e.select(F.col("user_id").cast("string").alias("signal_id"), F.col("event_id").alias("seq"), (F.col("event_id") * 37 % 1500).alias("at"), F.when(F.col("event_type") == "view", "on").otherwise("off").alias("kind"), (F.col("event_id") % 5).alias("note"), (110.0 * (1 + F.col("event_id") % 7)).alias("pitch"), F.lit(0.8).alias("velocity"))


@query()
def poly_voice(s, d):
    return keyed(gen.voices(notes(s, d), 2000), r6(F.col("y")))


@query()
def voice_map(s, d):
    """Voices rendered apart, then summed."""
    apart = gen.voice_bus(notes(s, d), 2000, 4)
    return keyed(apart, r6(sum((F.col("y")[k] for k in range(1, 4)), F.col("y")[0])))


# Channels and mixing.
def channels(name: str, cols, sqls: dict[str, str]) -> None:
    body = ", ".join(rs(v, k) for k, v in sqls.items())
    query(f"WITH {USER}, st AS (SELECT signal_id, n, x, lag(x, 3, 0.0) OVER (PARTITION BY signal_id ORDER BY n) AS z FROM sig) SELECT signal_id, n, {body} FROM st", name)(lambda s, d, c=cols: keyed(user_signals(s, d).withColumn("z", F.lag("x", 3, 0.0).over(hi.order())), *[r6(v, k) for k, v in c(F.col("x"), F.col("z")).items()]))


_t = 1.25 * math.pi / 4
channels("constant_power_pan", lambda x, z: dict(zip(("l", "r"), sp.pan(x, 0.25))), {"l": f"x * {math.cos(_t)!r}", "r": f"x * {math.sin(_t)!r}"})
channels("balance", lambda x, z: dict(zip(("l", "r"), sp.balance(x, z, 0.3))), {"l": "x * 0.7", "r": "z"})
channels("width", lambda x, z: dict(zip(("l", "r"), sp.width(x, z, 1.5))), {"l": "(x + z) / 2 + 1.5 * (x - z) / 2", "r": "(x + z) / 2 - 1.5 * (x - z) / 2"})
channels("downmix", lambda x, z: {"y": sp.mix_matrix(tb.MIX["stereo", "mono"], [x, z])[0]}, {"y": "0.5 * x + 0.5 * z"})
channels("upmix", lambda x, z: {f"c{k}": v for k, v in enumerate(sp.mix_matrix(tb.MIX["stereo", "5.1"], [x, z]))}, {"c0": "x", "c1": "z", **{f"c{k}": "0.0::DOUBLE" for k in range(2, 6)}})
channels("mix_matrix", lambda x, z: dict(zip(("a", "b"), sp.mix_matrix([[0.5, 0.25], [-0.5, 1.0]], [x, z]))), {"a": "0.5 * x + 0.25 * z", "b": "z - 0.5 * x"})
_g = sp.vbap(20.0, [-110, -30, 0, 30, 110])
channels("vbap", lambda x, z: {f"c{k}": x * v for k, v in enumerate(_g)}, {f"c{k}": f"x * {v!r}::DOUBLE" for k, v in enumerate(_g)})
_sh = tb.sh(0.4, 0.2, 2)
channels("ambisonic_encode", lambda x, z: {f"w{k}": v for k, v in enumerate(sp.encode(x, 0.4, 0.2, 2))}, {f"w{k}": f"x * {v!r}::DOUBLE" for k, v in enumerate(_sh)})
_dirs = [(0.785, 0.0), (-0.785, 0.0), (2.356, 0.0), (-2.356, 0.0)]
_dec = [sum(a * b for a, b in zip(tb.sh(0.4, 0.2, 1), tb.sh(*q, 1))) / 4 for q in _dirs]
channels("ambisonic_decode", lambda x, z: {f"s{k}": v for k, v in enumerate(sp.decode(sp.encode(x, 0.4, 0.2, 1), _dirs, 1))}, {f"s{k}": f"x * {v!r}::DOUBLE" for k, v in enumerate(_dec)})


def _split(s, d):
    df = user_signals(s, d)
    return df, df.select("signal_id", "n", F.lag("x", 2, 0.0).over(hi.order()).alias("x"))


_LAG2 = f"{USER}, z AS (SELECT signal_id, n, lag(x, 2, 0.0) OVER (PARTITION BY signal_id ORDER BY n) AS x FROM sig)"


@query(f"WITH {_LAG2} SELECT signal_id, n, {rs('sig.x + z.x')} FROM sig JOIN z USING (signal_id, n)")
def summing_mixer(s, d):
    return keyed(sp.summing_mixer(*_split(s, d)), r6(F.col("y")))


@query(f"WITH {_LAG2} SELECT signal_id, n, {rs('0.7 * sig.x + 0.3 * z.x')} FROM sig JOIN z USING (signal_id, n)")
def dry_wet(s, d):
    return keyed(sp.dry_wet(*_split(s, d), 0.3), r6(F.col("y")))


@query(f"WITH {USER} SELECT signal_id, n, {rs('x', 'a')}, {rs('x', 'b')} FROM sig")
def splitter(s, d):
    return keyed(user_signals(s, d), r6(F.col("x"), "a"), r6(F.col("x"), "b"))


_M = [[0.5, 0.25], [-1.0, 0.75], [0.0, 1.0]]


@query(f"WITH {_LAG2}, o AS (SELECT * FROM (VALUES (0, 0.5, 0.25), (1, -1.0, 0.75), (2, 0.0, 1.0)) v(o, a, b)) SELECT signal_id, n, CAST(o AS INT) AS out, {rs('a * sig.x + b * z.x')} FROM sig JOIN z USING (signal_id, n), o")
def matrix_router(s, d):
    a, b = _split(s, d)
    bus = a.withColumn("ch", F.lit(0)).unionByName(b.withColumn("ch", F.lit(1)))
    return keyed(sp.matrix_router(bus, _M), r6(F.col("y")), keys=("signal_id", "n", "out"))


_FD = sp.fdn_matrix(2)


@query(f"WITH {_LAG2} SELECT signal_id, n, {rs(f'sig.x + {_FD[0][0]!r} * sig.x + {_FD[0][1]!r} * z.x', 'a')}, {rs(f'z.x + {_FD[1][0]!r} * sig.x + {_FD[1][1]!r} * z.x', 'b')} FROM sig JOIN z USING (signal_id, n)")
def fdn_matrix(s, d):
    a, b = _split(s, d)
    both = sp.concat({"x": a, "z": b}, ("signal_id", "n"))
    x, z = F.col("x"), F.col("z")
    p, q = sp.mix_matrix(_FD, [x, z])
    return keyed(both, r6(x + p, "a"), r6(z + q, "b"))


@query(f"WITH {USER} SELECT signal_id, n * 2 + c AS pos, {rs('CASE WHEN c = 0 THEN x ELSE -x END', 'x')} FROM sig, (SELECT unnest(range(2)) AS c)")
def interleave(s, d):
    got = sp.interleave(user_signals(s, d).withColumn("l", F.col("x")).withColumn("r", -F.col("x")), ["l", "r"])
    return got.select("signal_id", "pos", r6(F.col("x"), "x"))


@query(f"WITH {USER} SELECT signal_id, n // 2 AS n, {rs('max(x) FILTER (WHERE n % 2 = 1)', 'l')}, {rs('max(x) FILTER (WHERE n % 2 = 0)', 'r')} FROM sig GROUP BY 1, 2")
def deinterleave(s, d):
    order = tb.permutation(["L", "R"], ["R", "L"])
    got = sp.deinterleave(user_signals(s, d).withColumnRenamed("n", "pos"), ["l", "r"], order)
    return keyed(got, r6(F.col("l"), "l"), r6(F.col("r"), "r"))


@query(f"WITH {POW} SELECT signal_id, hop, {rs('sqrt(avg(p))', 'rms')}, {rs('sum(k * p) / sum(p)', 'centroid')} FROM pw GROUP BY 1, 2")
def concat(s, d):
    p = powers(s, d)
    got = sp.concat({"rms": p.select("signal_id", "hop", ft.rms().alias("v")), "centroid": p.select("signal_id", "hop", ft.centroid().alias("v"))})
    return got.select("signal_id", "hop", r6(F.col("rms"), "rms"), r6(F.col("centroid"), "centroid"))


# Composites.
@query(f"WITH {POW}, m AS (SELECT signal_id, k, avg(p) AS v FROM pw GROUP BY 1, 2), c AS (SELECT signal_id, k, sum(v) OVER (PARTITION BY signal_id ORDER BY k) / sum(v) OVER (PARTITION BY signal_id) AS c FROM m) SELECT signal_id, CAST(min(k) FILTER (WHERE c >= 0.02) AS INT) AS lo, CAST(min(k) FILTER (WHERE c >= 0.98) AS INT) AS hi FROM c GROUP BY 1")
def scan_band(s, d):
    return sp.scan_band(powers(s, d))


@query(f"WITH {_LAG2} SELECT signal_id, {rs('sum(pow(sig.x - z.x, 2)) / sum(pow(sig.x + z.x, 2) + pow(sig.x - z.x, 2))', 'side')}, {rs('corr(sig.x, z.x)', 'corr')}, {rs('sqrt(sum(sig.x * sig.x) / sum(z.x * z.x))', 'ratio')} FROM sig JOIN z USING (signal_id, n) GROUP BY 1")
def stereo_probe(s, d):
    both = sp.concat(dict(zip("xz", _split(s, d))), ("signal_id", "n"))
    x, z = F.col("x"), F.col("z")
    mid, side = F.pow(x + z, F.lit(2.0)), F.pow(x - z, F.lit(2.0))
    return both.groupBy("signal_id").agg(r6(F.sum(side) / F.sum(mid + side), "side"), r6(F.corr("x", "z"), "corr"), r6(F.sqrt(F.sum(x * x) / F.sum(z * z)), "ratio"))


@query("WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_extendedprice) AS price, min(l_extendedprice) AS low, max(l_extendedprice) AS high, sum(l_quantity) AS volume FROM lineitem GROUP BY 1) SELECT day, round((price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()), 6) + 0.0 AS price, round(ln(1 + volume), 6) + 0.0 AS volume, round(high - low, 4) + 0.0 AS volatility, CAST(price >= lag(price, 1, price) OVER (ORDER BY day) AS INT) AS is_up FROM d")
def market_ticks(s, d):
    """Daily ticks of the line items: scaled price, log volume, range, direction. Days are few (a calendar's), so the last windows
    run over one small partition."""
    day = table(s, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.avg("l_extendedprice").alias("p"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.sum("l_quantity").alias("v"))
    ends = F.broadcast(day.agg(F.min("p").alias("p0"), F.max("p").alias("p1")))  # one row
    before = F.lag("p", 1).over(Window.orderBy("day"))
    return day.join(ends).select("day", r6((F.col("p") - F.col("p0")) / (F.col("p1") - F.col("p0")), "price"), r6(F.log1p("v"), "volume"), (F.round(F.col("high") - F.col("low"), 4) + 0.0).alias("volatility"), (F.col("p") >= F.coalesce(before, F.col("p"))).cast("int").alias("is_up"))


@query(f"WITH {USER}, p AS (SELECT signal_id, n * 2 AS at, CASE WHEN n % 3 = 0 THEN 0.0 ELSE 1.0 END AS value FROM sig WHERE n % 5 = 1), k AS (SELECT signal_id, n, x, n // {N} AS block FROM sig) SELECT k.signal_id, k.n, {rs('x * coalesce((SELECT p.value FROM p WHERE p.signal_id = k.signal_id AND p.at <= k.block * 16 ORDER BY p.at DESC LIMIT 1), 1.0)')} FROM k")
def mute_unmute(s, d):
    """A slot that a control table sets to 0 or 1, read at block starts."""
    df = user_signals(s, d)
    p = df.where("n % 5 = 1").select("signal_id", (F.col("n") * 2).alias("at"), F.when(F.col("n") % 3 == 0, 0.0).otherwise(1.0).alias("value"))
    at = df.withColumn("block", F.expr(f"n div {N}")).join(bl.scheduled(df, p, N), ["signal_id", "block"])
    return keyed(at, r6(F.col("x") * F.col("value")))


@query(f"WITH {FRAMES}, v AS (SELECT signal_id, hop, unnest(range(64)) AS k, unnest(s) AS v FROM fr) SELECT a.k AS i, b.k AS j, {rs('avg(a.v * b.v) - avg(a.v) * avg(b.v)', 'cov')} FROM v a JOIN v b ON a.signal_id = b.signal_id AND a.hop = b.hop AND a.k <= b.k WHERE a.k < 8 AND b.k < 8 GROUP BY 1, 2")
def feature_covariance(s, d):
    """Covariances of features, the one distributed step of a principal component analysis: each frame adds its products."""
    x = F.slice("s", 1, 8)
    both = embedding_frames(s, d).select(F.posexplode(x).alias("i", "a"), x.alias("x")).select("i", "a", F.posexplode("x").alias("j", "b")).where("i <= j")
    cov = F.avg(F.col("a") * F.col("b")) - F.avg("a") * F.avg("b")
    return both.groupBy(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(r6(cov, "cov"))


@query()
def feature_pca(s, d):
    """The three leading components of the frames, scaled between their 2nd and 98th percentile."""
    import numpy as np

    size = 64
    frames = embedding_frames(s, d).select("signal_id", "hop", F.col("s").alias("x"))
    row = frames.agg(*[F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(size)], *[F.stddev_pop(F.col("x")[k]).alias(f"s{k}") for k in range(size)]).first()
    both = frames.select(F.posexplode("x").alias("i", "a"), "x").select("i", "a", F.posexplode("x").alias("j", "b")).where("i < j")
    m = np.eye(size)
    for r in both.groupBy("i", "j").agg(F.corr("a", "b").alias("c")).collect():  # one row for each two columns
        m[r.i, r.j] = m[r.j, r.i] = r.c
    vectors = np.linalg.eigh(m)[1][:, ::-1][:, :3]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(3)])
    z = [(F.col("x")[k] - row[f"m{k}"]) / row[f"s{k}"] for k in range(size)]
    parts = frames.select("signal_id", "hop", *[c.alias(f"pc{k}") for k, c in enumerate(sp.mix_matrix(vectors.T.tolist(), z))])
    ends = parts.agg(*[F.percentile(f"pc{k}", F.lit(q)).alias(f"q{k}_{q}") for k in range(3) for q in (0.02, 0.98)]).first()
    scaled = lambda k: el.clamp((F.col(f"pc{k}") - ends[f"q{k}_0.02"]) / (ends[f"q{k}_0.98"] - ends[f"q{k}_0.02"]), 0.0, 1.0)
    return parts.select("signal_id", "hop", *[r6(scaled(k), f"pc{k}") for k in range(3)])


@query()
def dither_tpdf(s, d):
    """16-bit codes with triangular dither of one step."""
    return keyed(user_signals(s, d), el.pcm_encode(F.col("x") * 0.9, "s16", el.tpdf(5, "signal_id", "n")).alias("y"))


@query()
def deep_space(s, d):
    """Magnitudes on bins, phases that advance with the hop, and overlap-add: the frames' shape as sound."""
    frames = powers(s, d).select("signal_id", "hop", F.slice("p", 1, 33).alias("p"))
    turn = lambda k: 2 * math.pi * k * F.col("hop") / 4
    made = frames.select("signal_id", "hop", F.transform("p", lambda v, k: v * F.cos(turn(k))).alias("re"), F.transform("p", lambda v, k: v * F.sin(turn(k))).alias("im"))
    return keyed(rw.istft(made, FR, HOP), r6(F.col("y")))


@query()
def asynchronous_resampler(s, d):
    """A reader whose rate follows the fill of its queue (a proportional-integral controller), over a recorded schedule."""
    got = rc.asynchronous(user_signals(s, d), 17, 16, 64)
    return keyed(got, r6(F.col("y")), r6(F.col("ratio"), "ratio"), "starved")


_F = f"WITH {SPEC}, q AS (SELECT signal_id, hop, k, re * re + im * im AS p FROM sp), f AS (SELECT signal_id, hop, sqrt(avg(p)) AS rms, sum(k * p) / sum(p) AS centroid, CAST(arg_min(k, (-p, k)) AS INT) AS dominant, sum(p) AS t FROM q GROUP BY 1, 2), x AS (SELECT a.signal_id, a.hop, sqrt(sum(pow(greatest(0, a.p - coalesce(b.p, 0)), 2))) AS flux FROM q a LEFT JOIN q b ON b.signal_id = a.signal_id AND b.hop = a.hop - 1 AND b.k = a.k GROUP BY 1, 2), c AS (SELECT signal_id, hop, CAST(min(k) AS INT) AS rolloff FROM (SELECT signal_id, hop, k, sum(p) OVER (PARTITION BY signal_id, hop ORDER BY k) AS run, t FROM q JOIN f USING (signal_id, hop)) WHERE run >= 0.85 * t GROUP BY 1, 2)"


@query(f"{_F} SELECT signal_id, hop, {rs('rms', 'rms')}, {rs('centroid', 'centroid')}, rolloff, {rs('flux', 'flux')}, dominant FROM f JOIN x USING (signal_id, hop) JOIN c USING (signal_id, hop)")
def featuregram(s, d):
    """Hopping spectra of the event-type signals and five features of each: all from one frame table, so no join."""
    p = ft.flux(rw.power(spec(s, d)))
    return keyed(p, r6(ft.rms(), "rms"), r6(ft.centroid(), "centroid"), ft.rolloff().alias("rolloff"), r6(F.col("flux"), "flux"), ft.dominant().alias("dominant"), keys=("signal_id", "hop"))
