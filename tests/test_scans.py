"""Running sums, refractory scans, thinning and prominence against plain loops."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import decode, pulses, scans


def test_buckets_rise_with_values(spark):
    rng = random.Random(0)
    values = sorted([0.0, -0.0, 1.0, 2.0, 4.0, 0.5, 2**-1000, -(2**-1000), 1e300, -1e300, float("inf"), float("-inf")] + [rng.gauss(0, 10 ** rng.randint(-9, 9)) for _ in range(3000)] + [2.0**k * (1 + s * 2**-52) for k in range(-60, 60) for s in (-1, 0, 1)])
    got = [r.b for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", scans.bucket(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got)
    assert len(set(got)) > 1000


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_sums(spark, keys):
    rng = random.Random(1)
    rows = [(i % 3, rng.choice([rng.gauss(0, 1), float(rng.randint(-3, 3)), None]), i, rng.randint(0, 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, v double, id int, w int")
    got = {r.id: (r.before, r.rank) for r in scans.running(df, keys, ["v", "id"], {"before": F.col("w").cast("long"), "rank": F.lit(1).cast("long")}).collect()}
    for own in ([rows] if not keys else [[r for r in rows if r[0] == k] for k in range(3)]):
        total = 0
        for n, r in enumerate(sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))):
            assert got[r[2]] == (total, n)
            total += r[3]
    assert len(got) == 2000


def plain_refractory(times, interval):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] >= interval:
            kept.append(t)
    return kept


@pytest.mark.parametrize("interval, a_range", [(7, 1), (7, 3), (1, 2), (50, 4096), (0, 5)])
def test_refractory_over_ranges(spark, interval, a_range):
    rng = random.Random(interval)
    times = {k: [rng.randint(-400, 2000) for _ in range(n)] + [5000] for k, n in (("a", 600), ("b", 15), ("c", 0))}
    df = spark.createDataFrame([(k, t) for k, own in times.items() for t in own] + [("a", None)], "k string, t long")
    got = scans.refractory(df, ["k"], "t", interval, a_range).collect()
    for k, own in times.items():
        assert sorted(r.t for r in got if r.k == k) == plain_refractory(own, interval)


def test_thinning_as_from_the_highest_down():
    rng = np.random.default_rng(2)
    for n, distance in ((1, 3), (200, 5), (200, 40), (60, 1000)):
        at = np.sort(rng.choice(1000, n, replace=False))
        v = rng.integers(0, 12, n).astype(float)
        keep = np.ones(n, dtype=bool)
        for k in sorted(range(n), key=lambda k: (-v[k], -at[k])):
            if keep[k]:
                keep &= ~((np.abs(at - at[k]) < distance) & (at != at[k]))
        assert (scans.thinned(at, v, distance) == keep).all()


def test_peaks_apart_in_a_busy_key(spark):
    rng = np.random.default_rng(3)
    at = np.cumsum(rng.integers(1, 9, 500))
    v = rng.integers(0, 30, 500)
    df = spark.createDataFrame([("k", int(a), float(x)) for a, x in zip(at, v, strict=True)], "k string, i long, v double")
    got = sorted(r.i for r in scans.peaks_apart(df, ["k"], "i", "v", 6).collect())
    assert got == at[scans.thinned(at, v.astype(float), 6)].tolist()


def plain_prominence(v, i):
    bases = []
    for side in (v[:i][::-1], v[i + 1 :]):
        low = v[i]
        for x in side:
            if x > v[i]:
                break
            low = min(low, x)
        bases.append(low)
    return v[i] - max(bases)


@pytest.mark.parametrize("chunk", [1, 4, 64, 8192])
def test_prominence_across_chunks(spark, chunk):
    rng = np.random.default_rng(chunk)
    series = {"walk": np.cumsum(rng.normal(0, 1, 300)), "steps": rng.integers(0, 6, 200).astype(float), "up": np.arange(50) + 3.0 * (np.arange(50) % 2), "flat": np.ones(10)}
    rows = spark.createDataFrame([(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v)], "k string, i long, v double")
    peaks = pulses.find_peaks(rows, ["k"], "i", "v").withColumnRenamed("peak", "v")
    got = scans.prominences(rows, peaks, ["k"], "i", "v", chunk).collect()
    assert len(got) == peaks.count() > 60
    for r in got:
        assert r.prominence == pytest.approx(plain_prominence(series[r.k], r.i))


def test_auc_without_a_window_over_all_rows(spark):
    rng = random.Random(5)
    rows = [(i, round(rng.gauss(i % 2, 1), 1), i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, s double, y int")
    won = sum((a > b) + 0.5 * (a == b) for _, a, y in rows if y for _, b, z in rows if not z)
    assert decode.auc(df, [], "s", "y").first().auc == pytest.approx(won / 300 / 300)
    plan = decode.auc(df, [], "s", "y")._jdf.queryExecution().optimizedPlan().toString()
    assert set(re.findall(r"windowspecdefinition\((\w+)#", plan)) == {"_o", "_b"}
