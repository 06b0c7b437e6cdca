"""Tuning indices, statistics and decoding against worked cases and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.functions.stats import f_tail, incomplete_beta, t_tails
from trialspark.operators import decode, rates, selection, signals, tuning


@pytest.fixture(scope="module")
def curve(spark):
    return spark.createDataFrame([(1, t, r) for t, r in ((0.0, 10.0), (45.0, 4.0), (90.0, 2.0), (135.0, 4.0))], "unit int, theta double, mean double")


def test_indices(curve):
    assert tuning.osi(curve, ["unit"], "theta", "mean").first().osi == pytest.approx(2 / 3)
    v = tuning.gosi_vector(curve, ["unit"], "theta", "mean").first()
    assert (v.gosi, v.circular_variance, v.preferred_vector) == pytest.approx((0.4, 0.6, 0.0))
    m = tuning.modulation(curve, ["unit"], "mean").first()
    assert (m.osi_max, m.modulation_depth) == pytest.approx((0.8, 2 / 3))


def test_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(1, t, 5.0) for t in (0.0, 45.0, 90.0, 135.0)], "unit int, theta double, mean double")
    assert tuning.osi(df, ["unit"], "theta", "mean").first().preferred == 0.0


def test_sfdi(spark):
    x = [[[4, 6], [1, 3]], [[5, 5], [2, 2]]]
    df = spark.createDataFrame([(1, 0.0, s, float(x[p][s][r])) for p in range(2) for s in range(2) for r in range(2)], "unit int, theta double, sf int, rate double")
    out = tuning.sfdi(df, ["unit"], "theta", "sf", "rate").first()
    assert (out.r_max, out.r_min, out.sse) == pytest.approx((5, 2, 4)) and out.sfdi == pytest.approx(0.391304, abs=1e-6)


def test_anova(spark):
    df = spark.createDataFrame([(1, g, float(v)) for g, vs in enumerate(((1, 2, 3), (2, 3, 4), (5, 6, 7))) for v in vs], "unit int, g int, v double")
    assert tuning.anova(df, ["unit"], "g", "v").first().f_stat == pytest.approx(13)


def test_tails(spark):
    x = np.linspace(0.05, 0.95, 7)
    assert np.allclose(incomplete_beta(np.full(7, 2.0), np.full(7, 3.0), x), 6 * x**2 - 8 * x**3 + 3 * x**4)
    r = spark.range(1).select(f_tail(F.lit(13.0), F.lit(2), F.lit(6)).alias("f"), t_tails(F.lit(2.776445), F.lit(4)).alias("t")).first()
    assert r.f == pytest.approx((1 + 26 / 6) ** -3, abs=1e-9) and r.t == pytest.approx(0.05, abs=1e-6)


def test_one_sample_t(spark):
    df = spark.createDataFrame([(1, v) for v in (0.6, 0.7, 0.8, 0.7, 0.7)], "k int, v double")
    assert decode.t_one_sample(df, ["k"], "v", 0.5).first().t == pytest.approx(6.324555, abs=1e-6)


def test_tuning_fit_finds_the_curve(spark):
    theta = np.arange(0, 180, 22.5)
    d = np.minimum((theta - 60) % 180, 180 - (theta - 60) % 180)
    y = 2 + 9 * np.exp(-(d**2) / (2 * 25**2))
    df = spark.createDataFrame([(1, float(t), float(v)) for t, v in zip(theta, y, strict=True)], "unit int, theta double, mean double")
    out = tuning.tuning_fit(df, ["unit"], "theta", "mean").first()
    assert out.r2 > 0.999 and out.preferred == pytest.approx(60, abs=1.5) and out.width == pytest.approx(25, rel=0.06)


def test_artifact_norms(spark):
    df = spark.createDataFrame([("c", k, 1.0 if k < 9 else 11.0) for k in range(10)], "ch string, chunk long, norm double")
    assert signals.artifact_chunks(df, ["ch"], 20, 2.0).count() == 1
    assert signals.artifact_chunks(df, ["ch"], 20, 3.0).count() == 0


def test_lda_boundary_and_numpy(spark):
    df = spark.createDataFrame([(k, int(k > 2), [float(v)]) for k, v in enumerate((0, 1, 2, 4, 5, 6))], "id int, y int, x array<double>")
    model = decode.lda_fit(df, [], "y")
    at = spark.createDataFrame([(0, [2.9]), (1, [3.1])], "id int, x array<double>")
    assert [r.predicted for r in decode.lda_predict(at, model, [], "y").orderBy("id").collect()] == [0, 1]
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 90)
    x = rng.normal(size=(90, 4)) + y[:, None]
    rows = spark.createDataFrame([(k, int(y[k]), x[k].tolist()) for k in range(90)], "id int, y int, x array<double>")
    got = {r.id: r.predicted for r in decode.lda_predict(rows, decode.lda_fit(rows, [], "y"), [], "y").collect()}
    means = np.stack([x[y == c].mean(axis=0) for c in range(3)])
    cov = sum((x[y == c] - means[c]).T @ (x[y == c] - means[c]) for c in range(3)) / 90
    w = means @ np.linalg.inv(cov)
    score = x @ w.T - 0.5 * (w * means).sum(axis=1) + np.log(np.bincount(y) / 90)
    assert [got[k] for k in range(90)] == score.argmax(axis=1).tolist()


def test_folds_partition_the_rows(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(60)], "id int, y int")
    out = decode.stratified_folds(df, [], "y", "id", 5).collect()
    assert len(out) == 60 and {r.fold for r in out} == set(range(5))
    assert all(sum(r.fold == f and r.y == c for r in out) == 4 for f in range(5) for c in range(3))


def test_cross_validation_learns_and_shuffles_do_not(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(k, k % 2, [float(v) for v in rng.normal(size=3) + 2 * (k % 2)]) for k in range(120)], "id int, y int, x array<double>")
    score = lambda d: decode.fold_scores(decode.cross_validated(d, [], "y", "id"), [], "y").first()
    assert score(df).accuracy > 0.85 and score(df).n == 120
    assert score(decode.shuffled_labels(df, [], "y", "id", 3)).accuracy < 0.7


def test_confusion_sums_to_trials(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y int, predicted int")
    m = decode.confusion(df, [], "y")
    assert m.agg(F.sum("n")).first()[0] == 4
    s = {r["class"]: r for r in decode.class_scores(m, [], "y").collect()}
    assert s["1"].precision == pytest.approx(2 / 3) and s["0"].recall == 0.5


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 0), (0.5, 1), (0.9, 1)], "s double, y int")
    assert decode.auc(df, [], "s", "y").first().auc == pytest.approx(3.5 / 4)


def test_choices(spark):
    df = spark.createDataFrame([("good", 1), ("noise", 2), (None, 3)], "quality string, unit int")
    assert [r.unit for r in selection.without_noise(selection.default_quality(df)).orderBy("unit").collect()] == [1, 3]
    split = selection.train_test(spark.createDataFrame([(k, "a" if k < 70 else "b") for k in range(80)], "id int, y string"), "y", ["id"])
    n = {(r.y, r.part): r["count"] for r in split.groupBy("y", "part").count().collect()}
    assert n == {("a", "train"): 40, ("a", "test"): 20, ("b", "train"): 5, ("b", "test"): 5}


def test_axes_match_numpy(spark):
    rng = np.random.default_rng(3)
    y = np.arange(90) % 3
    x = rng.normal(size=(90, 4)) * [3, 1, 1, 0.5] + np.outer(y, [0, 2, 0, 1])
    rows = spark.createDataFrame([(k, int(y[k]), x[k].tolist()) for k in range(90)], "id int, y int, x array<double>")
    place = lambda axes: np.array([r.place for r in decode.projected(rows, axes.filter("axis = 0"), []).orderBy("id").collect()])
    pca = place(decode.principal_axes(rows, []))
    u, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(pca), np.abs(u[:, 0] * s[0])) and decode.principal_axes(rows, []).count() == 2
    lda = place(decode.lda_axes(rows, [], "y"))
    ratio = lambda z: np.var([z[y == c].mean() for c in range(3)]) / np.mean([z[y == c].var() for c in range(3)])
    assert ratio(lda) > max(ratio(x[:, k]) for k in range(4)) and ratio(lda) > ratio(pca)
    shares = [r.share for r in decode.lda_axes(rows, [], "y").orderBy("axis").collect()]
    assert len(shares) == 2 and shares[0] > shares[1] and sum(shares) == pytest.approx(1)


def test_halton_is_even():
    u = decode.halton(4096, 3)
    assert ((u > 0) & (u < 1)).all()
    assert abs((((u - 0.5) ** 2).sum(axis=1) <= 0.25).mean() - np.pi / 6) < 0.005


def test_splits_leave_out_sizes_that_a_class_lacks(spark):
    df = spark.createDataFrame([(k, k % 2 if k < 40 else 1) for k in range(60)], "id int, y int")
    got = decode.repeated_splits(df, [], "y", "id", [5, 15, 16], 5, [0, 1])
    assert {(r.n_train, r.part, r["count"]) for r in got.groupBy("n_train", "part").count().collect()} == {(5, "train", 20), (5, "test", 20), (15, "train", 60), (15, "test", 20)}


def test_pairs_of_weighted_rows(spark):
    """A row that stands for three gives what three rows give."""
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 3), int(i // 3 % 5), [float(v) for v in rng.standard_normal(3) + i % 3]) for i in range(90)]
    once = spark.createDataFrame(rows, "id long, y int, fold int, x array<double>")
    thrice = once.withColumn("_c", F.explode(F.array(*map(F.lit, range(3))))).drop("_c")
    score = lambda df, w: sorted(tuple(round(float(v), 9) for v in r) for r in decode.fold_scores(decode.pairwise_predictions(df, [], "y", shrink=0.1, weight=w), ["a", "b"], "class", weight=w).collect())
    got = score(once.withColumn("n", F.lit(3)), "n")
    assert got == score(thrice, None) and [r[:3] for r in got] == [(0, 1, 180), (0, 2, 180), (1, 2, 180)]


def test_feature_vectors_are_the_design_of_the_sets(spark):
    hits = spark.createDataFrame([(1, 10), (1, 400), (2, 999)], "trial long, rel long")
    trials = spark.createDataFrame([(1,), (2,), (3,)], "trial long")
    features = rates.temporal_features(hits, trials, ["trial"], "rel", 1000, 20, 1000.0)
    want = decode.design(rates.feature_sets(features, ["trial"]), ["trial", "feature_set"], "feature", "value")
    told = lambda df: sorted((r.trial, r.feature_set, r.x) for r in df.collect())
    assert told(rates.feature_vectors(features, ["trial"])) == told(want) and want.count() == 12
