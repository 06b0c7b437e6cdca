"""Worked cases of pulses, intervals and windows (FIXTURES.md), and the quirks that we decided on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import intervals, pulses, rates, windows
from trialspark.plans import QUERIES


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def noisy(spark):
    return spark.createDataFrame([("r", 100, 600), ("r", 700, 760), ("r", 1250, 1350), ("r", 1400, 2000), ("r", 12000, 12500)], "rec_id string, rise long, fall long")


def test_short_highs(noisy):
    assert rows(pulses.drop_short_highs(noisy, 100), "rise") == [(100,), (1250,), (1400,), (12000,)]


def test_deglitch_keeps_a_last_high_that_is_not_merged(noisy):
    assert rows(pulses.deglitch(noisy, ["rec_id"], 100, 100), "rise", "fall") == [(100, 600), (1250, 2000), (12000, 12500)]
    report = pulses.clean_report(noisy, ["rec_id"], 100, 100).first()
    assert (report.raw_highs, report.dropped_highs, report.merged_lows, report.clean_highs) == (5, 1, 1, 3)


def test_deglitch_is_stable(spark):
    rng = np.random.default_rng(3)
    edges = np.cumsum(rng.integers(1, 300, 400)).tolist()
    df = spark.createDataFrame([("r", edges[k], edges[k + 1]) for k in range(0, 400, 2)], "rec_id string, rise long, fall long")
    once = pulses.deglitch(df, ["rec_id"], 100, 100)
    assert rows(pulses.deglitch(once, ["rec_id"], 100, 100), "rise", "fall") == rows(once, "rise", "fall")


def test_edges_and_pairs(spark):
    din = spark.createDataFrame([("r", t, s) for t, s in [(0, 1), (5, 0), (10, 1), (20, 0), (30, 1)]], "rec_id string, t long, state int")
    e = pulses.edges(din, ["rec_id"])
    assert rows(e, "t", "edge") == [(5, -1), (10, 1), (20, -1), (30, 1)]
    assert rows(pulses.pair_edges(e, ["rec_id"]), "pulse_idx", "rise", "fall") == [(0, 10, 20)]


def test_concat_parts_drops_a_repeated_first_state(spark):
    din = spark.createDataFrame([("r", 1, 0, 1), ("r", 1, 1, 0), ("r", 2, 0, 0), ("r", 2, 1, 1), ("r", 3, 0, 0)], "rec_id string, part int, seq int, state int")
    assert rows(pulses.concat_parts(din, ["rec_id"]), "part", "seq") == [(1, 0), (1, 1), (2, 1), (3, 0)]


def test_split_by_gap(spark):
    df = spark.createDataFrame([("r", t) for t in (100, 1250, 12000)], "rec_id string, rise long")
    assert rows(pulses.split_by_gap(df, ["rec_id"], "rise", 10_000), "rise", "segment") == [(100, 1), (1250, 1), (12000, 2)]
    assert rows(pulses.split_by_gap(df, ["rec_id"], "rise", 1150), "rise", "segment")[1] == (1250, 1)


def test_refractory(spark):
    df = spark.createDataFrame([("r", int(t * 10)) for t in (0, 1, 4, 5, 7.9, 8, 12.5)], "k string, t long")
    assert rows(pulses.refractory(df, ["k"], "t", 40), "t") == [(0,), (40,), (80,), (125,)]


def test_schmitt(spark):
    df = spark.createDataFrame([("r", k, float(v)) for k, v in enumerate((0, 2, 4, 2, 0.5, 2, 3, 3.5))], "k string, i int, v double")
    out = pulses.schmitt(df, ["k"], ["i"], "v", F.lit(1.0), F.lit(3.0)).orderBy("i").collect()
    assert [r.state for r in out] == [0, 0, 1, 1, 0, 0, 0, 1]


def test_find_peaks(spark):
    v = [0, 1, 0, 2, 2, 2, 0, 5, 4, 6, 0]
    df = spark.createDataFrame([("r", k, float(x)) for k, x in enumerate(v)], "k string, i int, v double")
    assert rows(pulses.find_peaks(df, ["k"], "i", "v"), "i") == [(1,), (4,), (7,), (9,)]
    assert rows(pulses.find_peaks(df, ["k"], "i", "v", height=2.0, distance=3), "i") == [(4,), (9,)]
    assert rows(pulses.find_peaks(df, ["k"], "i", "v", flat=False), "i") == [(1,), (7,), (9,)]
    holes = spark.createDataFrame([("r", k, x) for k, x in enumerate((None, 9.0, None, 1.0, 3.0, 2.0, 5.0, None))], "k string, i int, v double")
    assert rows(pulses.find_peaks(holes, ["k"], "i", "v", flat=False), "i") == [(4,)]


def test_peaks_in_range_leave_flat_tops_out(spark, tmp_path):
    values = (1.0, 30.0, 30.0, 2.0, 40.0, 3.0)
    df = spark.createDataFrame([(k, 7, "view", v) for k, v in enumerate(values)], "event_id long, user_id long, event_type string, value double")
    df.withColumn("ts", F.timestamp_seconds("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in QUERIES["peaks_in_range"](spark, str(tmp_path)).collect()] == [(7, 1)]


@pytest.mark.parametrize("closed", ["left", "both", "neither"])
def test_interval_join_is_the_nested_loop(spark, closed):
    rng = np.random.default_rng(1)
    ev = [(int(k), int(t)) for k, t in zip(rng.integers(0, 3, 300), rng.integers(-50, 200, 300), strict=True)]
    tr = [(int(k), i, int(t), int(t) + 25) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 40), rng.integers(-60, 180, 40), strict=True))]
    inside = {"left": lambda t, a, b: a <= t < b, "both": lambda t, a, b: a <= t <= b, "neither": lambda t, a, b: a < t < b}[closed]
    want = sorted((t, i) for k, t in ev for q, i, a, b in tr if k == q and inside(t, a, b))
    events, trials = spark.createDataFrame(ev, "k int, t long"), spark.createDataFrame(tr, "k int, i int, a long, b long")
    got = intervals.interval_join(events, trials, ["k"], "t", "a", "b", 10, closed)
    assert rows(got, "t", "i") == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_interpolation_clamps(spark):
    knots = spark.createDataFrame([("r", 0.0, 10.0), ("r", 2.0, 20.0), ("r", 3.0, 0.0)], "k string, t double, v double")
    grid = spark.createDataFrame([("r", x) for x in (-1.0, 0.0, 1.0, 2.5, 9.0)], "k string, x double")
    assert [v for _, v in rows(intervals.interpolated(grid, knots, ["k"], "x", "t", "v"), "x", "value_at")] == [10, 10, 15, 10, 0]


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 1.999, 2.0)], "x double")
    assert rows(rates.histogram(df, [], "x", 0.0, 1.0, 2), "bin", "n") == [(0, 2), (1, 3)]


def test_temporal_features(spark):
    trials = spark.createDataFrame([(1,), (2,)], "trial int")
    hits = spark.createDataFrame([(1, t) for t in (100, 300, 310, 900)], "trial int, rel long")
    a, b = rates.temporal_features(hits, trials, ["trial"], "rel", 1000, 4, 1000.0).orderBy("trial").collect()
    assert a.binned_counts == [1, 2, 0, 1] and (a.first_latency, a.last_time) == (0.1, 0.9)
    assert a.time_var == pytest.approx(0.08951875)
    assert (b.first_latency, b.last_time, b.time_var, b.total) == (1.0, 0.0, 0.0, 0)


def test_moving_average_and_blocks(spark):
    df = spark.createDataFrame([("r", k, float(k + 1)) for k in range(5)], "k string, i int, v double")
    smooth = lambda w: [r.smooth for r in windows.moving_average(df, ["k"], ["i"], "v", w).orderBy("i").collect()]
    assert smooth(4) == [0.75, 1.5, 2.5, 3.5, 3.0]
    assert smooth(3) == [1, 2, 3, 4, 3]
    assert rows(windows.block_average(df, ["k"], ["i"], "v", 2), "block", "mean") == [(0, 1.5), (1, 3.5), (2, 5.0)]


def test_frequency_bins_drop_the_overflow(spark):
    df = spark.createDataFrame([(float(f), 10.0 * f) for f in range(5)], "f double, v double")
    assert rows(windows.frequency_bins(df, [], "f", "v", 0.0, 2.0, 2), "freq", "value") == [(0.5, 5.0), (2.5, 25.0)]


def test_gaussian_weights():
    w = windows.gaussian_weights(2.0)
    assert len(w) == 17 and w[8] == pytest.approx(0.199475, abs=1e-6) and w[9] == pytest.approx(0.176036, abs=1e-6)


def mirrored(x, half):
    return np.concatenate([x[:half][::-1], x, x[-half:][::-1]])


def test_smoothers_match_numpy(spark):
    x = np.random.default_rng(0).normal(size=40)
    df = spark.createDataFrame([("r", k, float(v)) for k, v in enumerate(x)], "k string, i int, v double")
    got = lambda d: np.array([r.smooth for r in d.orderBy("i").collect()])
    w = windows.gaussian_weights(1.5)
    assert np.allclose(got(windows.gaussian_smooth(df, ["k"], "i", "v", 1.5)), np.convolve(mirrored(x, len(w) // 2), w, "valid"))
    m = mirrored(x, 2)
    assert np.allclose(got(windows.median_filter(df, ["k"], ["i"], "v")), [np.median(m[k : k + 5]) for k in range(40)])
    s = got(windows.savgol(df, ["k"], ["i"], "v", 11, 3))
    fit = lambda lo, at: np.polyval(np.polyfit(np.arange(11), x[lo : lo + 11], 3), at)
    want = [fit(0, k) if k < 5 else fit(29, k - 29) if k > 34 else fit(k - 5, 5) for k in range(40)]
    assert np.allclose(s, want)
    assert got(windows.savgol(df.filter("i < 6"), ["k"], ["i"], "v", 11, 3)).tolist() == x[:6].tolist()
