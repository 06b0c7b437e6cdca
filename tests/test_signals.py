"""Signal kernels on chunks against one NumPy array; coherence, motion, artifacts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import coherence, motion, signals

FS = 500.0


@pytest.fixture(scope="module")
def wave():
    rng = np.random.default_rng(0)
    t = np.arange(4096) / FS
    return np.sin(2 * np.pi * 50 * t) + 0.5 * np.sin(2 * np.pi * 4 * t) + 0.1 * rng.normal(size=4096)


@pytest.fixture(scope="module")
def traces(spark, wave):
    return spark.createDataFrame([("c", k, 512 * k, wave[512 * k : 512 * (k + 1)].tolist()) for k in range(8)], "channel string, chunk long, start long, samples array<double>")


def line(df, value="value", at="sample"):
    return np.array([r[value] for r in df.orderBy(at).collect()])


def test_round_trip(spark, traces, wave):
    long = signals.long_traces(traces, ["channel"])
    assert np.allclose(line(long), wave)
    assert np.allclose(line(signals.long_traces(signals.chunk_traces(long, ["channel"], "sample", "value", 300), ["channel"])), wave)


def test_butterworth_gains():
    sos = signals.butterworth(20.0, 80.0, FS)
    gain = lambda f: abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for z in [np.exp(-2j * np.pi * f / FS)] for b0, b1, b2, _, a1, a2 in sos]))
    assert gain(20) == pytest.approx(2**-0.5, abs=1e-6) == gain(80)
    assert gain(40) == pytest.approx(1, abs=0.01) and gain(2) < 1e-3 and gain(200) < 1e-2
    for low, high in ((None, 50.0), (50.0, None)):
        sos = signals.butterworth(low, high, FS)
        assert gain(50) == pytest.approx(2**-0.5, abs=1e-6)


def test_bandpass_on_chunks_is_that_of_the_whole(traces, wave, monkeypatch):
    monkeypatch.setattr(signals, "BLOCK", 300)
    got = line(signals.long_traces(signals.bandpass(traces, ["channel"], 20.0, 80.0, FS, halo=512), ["channel"]))
    want = signals.zero_phase(signals.butterworth(20.0, 80.0, FS), wave[None], 27)[0]
    assert np.abs(got - want)[100:-100].max() < 1e-6
    assert np.abs(got[200:-200] - np.sin(2 * np.pi * 50 * np.arange(200, 3896) / FS)).max() < 0.25


@pytest.mark.parametrize("length", [64, 512])
def test_slow_filters_reach_over_many_chunks(spark, wave, length, monkeypatch):
    monkeypatch.setattr(signals, "BLOCK", 64)
    cut = spark.createDataFrame([("c", k, length * k, wave[length * k : length * (k + 1)].tolist()) for k in range(4096 // length)], "channel string, chunk long, start long, samples array<double>")
    got = line(signals.long_traces(signals.bandpass(cut, ["channel"], 0.5, 4.0, FS), ["channel"]))
    want = signals.zero_phase(signals.butterworth(0.5, 4.0, FS), wave[None], 27)[0]
    assert np.abs(got - want)[600:-600].max() < 0.01 * np.abs(want).max()
    with pytest.raises(ValueError, match="halo"):
        signals.bandpass(cut, ["channel"], 0.5, 4.0, FS, halo=64)


def test_band_powers_of_the_whole(spark, wave, monkeypatch):
    monkeypatch.setattr(signals, "BLOCK", 200)
    cut = spark.createDataFrame([("c", k, 128 * k, wave[128 * k : 128 * (k + 1)].tolist()) for k in range(32)], "channel string, chunk long, start long, samples array<double>")
    out = signals.band_powers(cut, ["channel"], FS, 50)
    assert out.columns == ["channel", "sample", "delta", "sigma", "gamma", "theta_ratio"] and out.count() == 4096
    for name in ("delta", "sigma", "gamma"):
        q = signals.zero_phase(signals.butterworth(*signals.BANDS[name], FS), wave[None], 27)[0] ** 2
        want = np.convolve(q, np.ones(50), "full")[24:][: len(q)] / 50
        got = line(out, name)
        assert np.abs(got - want)[700:-700].max() < 0.01 * want.max(), name


def test_artifacts_stay_in_their_recording(spark):
    rng = np.random.default_rng(3)
    rows = [(rec, 0, k, float(v)) for rec in ("a", "b") for k, v in enumerate(rng.normal(size=400))]
    rows = [(r, c, k, 500.0 if r == "a" and 200 <= k < 204 else v) for r, c, k, v in rows]
    df = spark.createDataFrame(rows, "rec string, channel int, sample long, value double")
    norms = signals.chunk_norms(df, ["rec", "channel"], "sample", "value", 4)
    bad = signals.artifact_chunks(norms, ["channel"], 4, 6.0, recording=("rec",))
    assert [(r.rec, r.chunk) for r in bad.collect()] == [("a", 50)]
    out = signals.without_artifacts(df, bad, ["rec", "channel"], "sample", "value", 4, recording=("rec",))
    assert out.filter("replaced").select("rec").distinct().collect()[0].rec == "a" and out.filter("replaced").count() == 4
    assert out.filter("rec = 'b'").select("sample", "value").exceptAll(df.filter("rec = 'b'").select("sample", "value")).count() == 0


def test_preprocessing_is_a_list_of_steps(spark, traces):
    out, fs = signals.preprocessed(traces, ["channel"], FS, [("reference", [], "channel"), ("band", 20.0, 80.0), ("resample", 4)])
    assert fs == 125.0 and signals.long_traces(out, ["channel"]).count() == 1024
    two = traces.unionByName(traces.withColumn("channel", F.lit("d")).withColumn("samples", F.transform("samples", lambda v: 2 * v)))
    got, _ = signals.preprocessed(two, ["channel"], FS, [("band", 20.0, 80.0), ("reference", [], "channel")])
    assert signals.long_traces(got, ["channel"]).count() == 2 * 4096


def test_resampled_keeps_the_slow_wave(traces, monkeypatch):
    monkeypatch.setattr(signals, "BLOCK", 250)
    got = line(signals.long_traces(signals.resampled(traces, ["channel"], 4, 16), ["channel"]))
    assert len(got) == 1024
    t = np.arange(1024) * 4 / FS
    want = np.sin(2 * np.pi * 50 * t) + 0.5 * np.sin(2 * np.pi * 4 * t)
    assert np.abs(got - want)[50:-50].max() < 0.35


def test_spectrogram_across_chunks(traces, wave, monkeypatch):
    monkeypatch.setattr(signals, "BLOCK", 300)
    out = signals.spectrogram(traces, ["channel"], FS, nperseg=256, overlap=128, nfft=512).orderBy("seg").collect()
    starts = np.arange(0, 4096 - 256 + 1, 128)
    want = signals.psd(np.stack([wave[a : a + 256] for a in starts]), FS, signals.tukey(256), 512)
    assert [r.seg for r in out] == list(range(len(starts)))
    assert np.allclose([r.psd for r in out], want, rtol=1e-4, atol=1e-9)
    assert out[3].t == pytest.approx((3 * 128 + 128) / FS) and abs(np.argmax(out[5].psd) * FS / 512 - 50) < 2


def test_first_component_is_that_of_svd(spark):
    rng = np.random.default_rng(1)
    s = np.exp(rng.normal(size=(60, 5)) + np.outer(rng.normal(size=60), [1, 2, 0, 1, 0]))
    df = spark.createDataFrame([("c", k, v.tolist()) for k, v in enumerate(s)], "channel string, seg int, psd array<double>")
    got = line(signals.first_component(df, ["channel"], "seg", "psd"), "score", "seg")
    x = np.log10(s + 1e-10)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    v = np.linalg.svd(z, full_matrices=False)[2][0]
    assert np.allclose(got, z @ (v * np.sign(v[np.abs(v).argmax()])), atol=1e-8)


def test_artifacts_are_filled_by_the_cubic(spark):
    x = np.arange(60, dtype=float)
    y = 0.01 * x**3 - x
    bad = y.copy()
    bad[20:24] = 1e4
    df = spark.createDataFrame([("c", int(k), float(v)) for k, v in enumerate(bad)], "channel string, sample long, value double")
    chunks = spark.createDataFrame([(5,)], "chunk long")
    out = signals.without_artifacts(df, chunks, ["channel"], "sample", "value", 4)
    assert np.allclose(line(out), y) and out.filter("replaced").count() == 4
    edge = signals.without_artifacts(df, spark.createDataFrame([(0,), (14,)], "chunk long"), ["channel"], "sample", "value", 4)
    assert line(edge)[:4].tolist() == [y[4]] * 4 and line(edge)[-4:].tolist() == [y[55]] * 4


def test_coherence(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 128))
    rows = [(name, k, (shift * base[k] + noise * rng.normal(size=128)).tolist()) for name, shift, noise in (("a", 1, 0), ("b", -2, 0), ("c", 0, 1)) for k in range(30)]
    z = coherence.segment_spectra(spark.createDataFrame(rows, "channel string, seg int, x array<double>"), ["channel"], 128.0, 5.0, 20.0)
    left = z.filter("channel = 'a'").withColumnRenamed("channel", "ca")
    out = coherence.coherence(left, z.withColumnRenamed("channel", "cb"), [], "ca", "cb").collect()
    by = lambda c: [r for r in out if r.cb == c]
    assert all(r.coh == pytest.approx(1) and r.phase == pytest.approx(0) for r in by("a")) and len(by("a")) == 16
    assert all(r.coh == pytest.approx(1) and abs(r.phase) == pytest.approx(np.pi) for r in by("b"))
    assert np.mean([r.coh for r in by("c")]) < 0.15


@pytest.mark.parametrize("method", ["simple", "savgol", "median", "gaussian"])
def test_velocity_of_a_straight_line(spark, method):
    df = spark.createDataFrame([("s", k / 10, 3.0 * k / 10, 4.0 * k / 10) for k in range(60)], "s string, t double, x double, y double")
    v = [r.v for r in motion.velocity(df, ["s"], "t", "x", "y", method).orderBy("t").collect()]
    assert len(v) == 59 and np.allclose(v[12:-12], 5.0)


def test_velocity_outliers(spark):
    x = [float(k) for k in range(40)]
    x[20] += 5000
    df = spark.createDataFrame([("s", float(k), v, 0.0) for k, v in enumerate(x)], "s string, t double, x double, y double")
    raw = motion.velocity(df, ["s"], "t", "x", "y", resmooth=False)
    assert raw.filter("v = 0").count() == 2 and raw.filter("raw > 4000").count() == 2
    d = motion.velocity_by_derivative(df, ["s"], "t", "x", "y", most=530.0)
    assert d.count() == 40 and d.agg(F.max("v")).first()[0] <= 530


def ragged(spark, wave):
    """Chunks of all lengths, one of a single sample, in no order."""
    cuts = [0, 700, 701, 1500, 1502, 2600, 4000, 4096]
    rows = [("c", k, a, wave[a:b].tolist()) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return spark.createDataFrame(rows[::-1], "channel string, chunk long, start long, samples array<double>")


def test_a_short_chunk_changes_no_block(spark, traces, wave):
    for df in (traces, ragged(spark, wave)):
        blocks = signals.even_blocks(df, ["channel"], 256, 30, 50).orderBy("chunk").collect()
        assert [(b.chunk, b.start, b.n, b.before) for b in blocks] == [(k, 256 * k, 256, 0 if k == 0 else 30) for k in range(16)]
        for b in blocks:
            assert b.samples == wave[b.start - b.before : b.start + b.n + 50].tolist()


def test_blocks_from_any_start(spark):
    df = spark.createDataFrame([("c", 0, -7, [float(k) for k in range(20)]), ("c", 1, 40, [1.0, 2.0]), ("c", 2, 50, [])], "channel string, chunk long, start long, samples array<double>")
    got = signals.even_blocks(df, ["channel"], 10, 2, 2).orderBy("chunk").collect()
    assert [(b.chunk, b.start, b.n, b.before) for b in got] == [(-1, -7, 7, 0), (0, 0, 10, 2), (1, 10, 3, 2), (4, 40, 2, 0)]
    assert got[1].samples == [float(k) for k in range(5, 19)]


def test_no_job_runs_while_a_filter_is_planned(spark, traces):
    spark.sparkContext.setJobGroup("planned", "")
    signals.bandpass(traces, ["channel"], 20.0, 80.0, FS)
    signals.band_powers(traces, ["channel"], FS, 50)
    signals.spectrogram(traces, ["channel"], FS, 256, 128, 512)
    signals.resampled(traces, ["channel"], 4)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planned")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", ["bandpass", "resampled", "spectrogram"])
def test_ragged_chunks_give_what_even_ones_give(spark, traces, wave, name, monkeypatch):
    monkeypatch.setattr(signals, "BLOCK", 256)
    run = {
        "bandpass": lambda df: signals.long_traces(signals.bandpass(df, ["channel"], 20.0, 80.0, FS), ["channel"]).select("sample", "value"),
        "resampled": lambda df: signals.long_traces(signals.resampled(df, ["channel"], 3, 8), ["channel"]).select("sample", "value"),
        "spectrogram": lambda df: signals.spectrogram(df, ["channel"], FS, 256, 128, 512).select("seg", "psd"),
    }[name]
    a, b = ([tuple(r) for r in run(df).orderBy(run(df).columns[0]).collect()] for df in (traces, ragged(spark, wave)))
    assert a == b and len(a) > 10


def test_kernels_see_a_bounded_number_of_samples(spark, monkeypatch):
    """A batch of many blocks of one layout goes to the kernel in parts; each block comes back once."""
    monkeypatch.setattr(signals, "TOGETHER", 256)
    rows = spark.createDataFrame([(k, 0, 0, [float(k)] * 64) for k in range(40)], "channel int, chunk long, start long, samples array<double>").coalesce(1)
    out = signals._on_blocks(rows, ["channel"], 64, 0, lambda x, before, n: np.c_[x[:, 0], np.full(len(x), x.size)], "_y").collect()
    assert sorted(r._y[0] for r in out) == list(range(40))
    assert max(r._y[1] for r in out) <= 256
