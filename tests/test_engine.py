"""Builder errors, latency, streaming against batch, metamorphic properties, codecs and kernels against independent forms."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.functions import tables as tb
from rillflow.operators import generators as gen
from rillflow.operators import history, recurrent, rewindow
from rillflow.operators import spatial as sp
from rillflow.plans import flow as fl
from rillflow.registry import QUERIES
from rillflow.sources import pcm
from rillflow.sources.signals import rows, user_signals


def signal(spark, values, name="a"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "signal_id string, n long, x double")


def column(df, col="y"):
    return [r[col] for r in df.orderBy("n").collect()]


def test_builder_errors(spark):
    src = lambda: signal(spark, [1, 2])
    f = fl.Flow()
    f.add("s", src)
    f.add("d", lambda x: x, {"x": fl.Port()})
    f.add("p", lambda x: x, {"x": fl.Port("spectrum")})
    with pytest.raises(fl.Unrooted):
        f.validate()
    with pytest.raises(fl.TypeMismatch):
        f.connect("s", "p")
    with pytest.raises(fl.UnknownPort):
        f.connect("s", "d", "z")
    f.connect("s", "d")
    with pytest.raises(fl.PortTaken):
        f.connect("s", "d")
    g = fl.Flow()
    g.add("a", lambda x: x, {"x": fl.Port()})
    g.add("b", lambda x: x, {"x": fl.Port()})
    g.connect("a", "b"), g.connect("b", "a")
    with pytest.raises(fl.Cycle):
        g.validate()
    h = fl.Flow()
    h.add("s", src)
    h.add("half", lambda x: x, {"x": fl.Port()}, rate=(1, 2))
    h.add("z", lambda a, b: a, {"a": fl.Port(), "b": fl.Port()}, zip=True)
    h.connect("s", "half"), h.connect("s", "z", "a"), h.connect("half", "z", "b")
    with pytest.raises(fl.MixedRates):
        h.validate()
    k = fl.Flow()
    k.add("s", src, output=fl.Port(layout="7.1"))
    k.add("d", lambda x: x, {"x": fl.Port(layout="mono")})
    with pytest.raises(fl.LayoutMismatch):
        k.connect("s", "d")


def test_latency_is_aligned_and_layouts_coerced(spark):
    f = fl.Flow()
    f.add("s", lambda: signal(spark, [1, 2, 3, 4]))
    f.add("late", lambda x: history.delay(x, 2, out="x"), {"x": fl.Port()}, latency=2)
    f.add("mix", lambda a, b: sp.summing_mixer(a, b), {"a": fl.Port(), "b": fl.Port()}, zip=True)
    f.connect("s", "late"), f.connect("s", "mix", "a"), f.connect("late", "mix", "b")
    assert column(f.compile("mix")) == [0, 0, 2, 4]
    g = fl.Flow()
    g.add("s", lambda: signal(spark, [1, 3]))
    g.add("st", lambda x: x.withColumn("y", F.col("ch0") + F.col("ch1")), {"x": fl.Port(layout="stereo")}, output=fl.Port(layout="stereo"))
    g.connect("s", "st")
    assert column(g.compile("st")) == [2, 6]


def test_partitions_do_not_matter(spark, sf):
    df = user_signals(spark, sf)
    a = recurrent.run(df, recurrent.one_pole(0.2)).orderBy("signal_id", "n").collect()
    b = recurrent.run(df.orderBy(F.rand(3)).repartition(7), recurrent.one_pole(0.2)).orderBy("signal_id", "n").collect()
    assert a == b


def test_stft_round_trip_and_dft(spark):
    x = np.sin(np.arange(256) * 0.3)
    df = signal(spark, x)
    spec = rewindow.stft(df, 32, 16)
    y = np.array(column(rewindow.istft(spec, 32, 16)))
    assert np.allclose(y[32:], x[16 : 16 + len(y) - 32], atol=1e-9)  # half-overlapping Hann windows add to one
    rel = rewindow.relational_dft(rewindow.frames(df, 32, 16), 32).orderBy("hop").collect()
    for a, b in zip(spec.orderBy("hop").collect(), rel, strict=True):
        assert np.allclose(a.re, b.re) and np.allclose(a.im, b.im)


def test_frame_not_multiple_of_hop(spark):
    got = rewindow.frames(signal(spark, range(100)), 64, 23, window=False).orderBy("hop").collect()
    assert [r.hop for r in got] == [0, 1, 2, 3]
    assert got[3].s == [float(v) for v in range(28, 92)]
    with pytest.raises(ValueError):
        rewindow.frames(signal(spark, [1]), 60, 16)


def test_pcm_formats_and_wav(spark, tmp_path):
    assert pcm.normalised(struct.pack("<hh", -32768, 16384), "s16le").tolist() == [-1.0, 0.5]
    assert pcm.normalised(b"\x40\x00\x00", "s24be").tolist() == [0.5]
    assert pcm.normalised(b"\x80\xff", "u8").tolist() == [0.0, 127 / 128]
    body = struct.pack("<hhhh", 0, 16384, -16384, 8192)
    raw = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", len(body)) + body
    (tmp_path / "a.wav").write_bytes(raw)
    mono = pcm.to_mono(pcm.read_pcm(spark, str(tmp_path)))
    assert column(mono, "x") == [0.25, -0.125]


def test_feature_matrix(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 1.0, [2.0, 3.0]), ("a", 1, 4.0, [5.0, 6.0])], "signal_id string, hop long, v double, p array<double>")
    pcm.write_matrix(df, f"{tmp_path}/m")
    got = [r.row for r in spark.read.parquet(f"{tmp_path}/m").orderBy("hop").collect()]
    assert got == [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]
    assert np.frombuffer(pcm.matrix_bytes(got), np.float32).tolist() == [1, 2, 3, 4, 5, 6]


def test_designs():
    assert math.isclose(tb.lowpass(31, 0.1).sum(), 1)
    assert abs(tb.highpass(31, 0.1).sum()) < 1e-9
    with pytest.raises(ValueError):
        tb.highpass(30, 0.1)
    with pytest.raises(ValueError):
        tb.permutation(["L", "R"], ["L", "L"])
    d = tb.dct(26)
    assert np.allclose(d @ d.T, np.eye(26))
    g = sp.vbap(0.0, [-30, 30])
    assert np.allclose(g, [2**-0.5] * 2)


def test_noise_is_the_generator(spark):
    state, want = 7, []
    for _ in range(50):
        state = (state * gen.LCG_A + gen.LCG_C) % 2**64
        want.append((state >> 32) / 2**31 - 1)
    assert column(gen.noise(rows(spark, 50).repartition(3), 7)) == want


def test_nlms_cancels_an_echo():
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    d = 0.6 * np.concatenate([[0, 0], x[:-2]])
    _, e = recurrent.nlms(8, 0.5)(None, d, x)
    assert np.abs(e[-500:]).max() < 1e-6


def test_chunked_needs_its_lead(spark):
    x = np.random.default_rng(1).normal(size=3000)
    df = signal(spark, x)
    whole, parts = recurrent.run(df, recurrent.one_pole(0.1)), recurrent.run_chunked(df, recurrent.one_pole(0.1), 500, 400)
    assert np.array_equal(column(whole), column(parts))


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["signal_id", "hop", "rms", "centroid", "rolloff", "flux", "dominant"]


@pytest.mark.parametrize("a", [0.1, 0.001, 0.9])
def test_affine_scan_over_chunks(spark, a):
    df = signal(spark, np.random.default_rng(2).normal(size=9000))
    assert np.allclose(column(recurrent.affine_scan(df, a)), column(recurrent.run(df, recurrent.one_pole(a))), atol=1e-9)


def test_lanes_over_chunks(spark):
    df = signal(spark, np.random.default_rng(3).normal(size=6000))
    assert np.allclose(column(recurrent.lanes(df, 3, 0.7)), column(recurrent.run(df, recurrent.comb(3, 0.7))), atol=1e-9)
    assert np.allclose(column(recurrent.lanes(df, 3, 0.0, 0.6)), column(recurrent.run(df, recurrent.allpass(3, 0.6))), atol=1e-9)


def test_noise_shaper_keeps_the_error_small():
    x = np.sin(np.arange(2000) * 0.01) * 0.5
    _, codes = recurrent.noise_shaper(8)(None, x)
    e = codes / 128 - x
    assert np.abs(e).max() < 1.5 / 128 and abs(e.mean()) < 1e-4
    saturated = recurrent.biquad_fixed(32767, 0, 0, 0, 0)(None, np.array([32767, -32768]))[1]
    assert saturated.tolist() == [32767, -32768]


def test_split_render_equals_whole():
    x = np.random.default_rng(4).normal(size=300)
    for kernel in (recurrent.one_pole(0.2), recurrent.biquad(0.2, 0.3, 0.1, -0.5, 0.2), recurrent.state_variable(0.1, 0.8), recurrent.ladder(0.3, 0.5), recurrent.comb(7, 0.6), recurrent.allpass(7, 0.5), recurrent.karplus_strong(5), recurrent.envelope(0.3, 0.05), recurrent.noise_shaper(), recurrent.flanger(20, 8.0, 4.0, 0.013, 0.4, 0.5)):
        _, whole = kernel(None, x)
        state, parts = None, []
        for at in range(0, 300, 37):
            state, y = kernel(state, x[at : at + 37])
            parts.append(y)
        assert np.allclose(np.concatenate(parts), whole, atol=1e-12)


def test_poly_voice_renders_every_user(spark, tmp_path):
    rows = [(100 * u + k, u, kind, 1.0) for u in (3, 8, 1499) for k, kind in enumerate(("view", "view", "click", "buy", "view", "click", "click"))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["poly_voice"](spark, str(tmp_path)).toPandas()
    assert set(got.signal_id) == {"3", "8", "1499"} and len(got) == 3 * 2000
    assert (got.y.abs().groupby(got.signal_id).max() > 0.1).all()


def test_feature_pca_takes_all_dimensions(spark, tmp_path):
    r = np.random.default_rng(5)
    x = r.normal(size=(150, 64))
    for lead, weight in ((8, 2.0), (30, 1.5), (50, 1.2)):  # what goes together lies past the first eight
        x[:, lead : lead + 14] += weight * r.normal(size=(150, 1))
    x = x.astype(np.float32).astype(float)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    z = (x - x.mean(0)) / x.std(0)
    v = np.linalg.eigh(np.corrcoef(x.T))[1][:, ::-1][:, :3]
    pc = z @ (v * np.sign(v[np.abs(v).argmax(0), range(3)]))
    lo, hi = np.percentile(pc, [2, 98], axis=0)
    got = QUERIES["feature_pca"](spark, str(tmp_path)).toPandas().sort_values("hop")
    assert np.abs(got[["pc0", "pc1", "pc2"]].to_numpy() - np.clip((pc - lo) / (hi - lo), 0, 1)).max() < 1e-5
