"""Classifiers fitted by key: accuracy, bounds, and jobs that don't grow with the configurations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import classifiers, decode
from trialspark.plans import QUERIES


def blobs(seed, n, p, c, apart):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, c, n)
    return (rng.standard_normal((c, p)) * apart)[y] + rng.standard_normal((n, p)), y


@pytest.mark.parametrize("method", classifiers.METHODS)
def test_accuracy_on_held_out_rows(method):
    x, y = blobs(0, 800, 10, 4, 1.2)
    body = classifiers.packed_fit(method, x[:400], y[:400], 0)
    assert (classifiers.packed_predict(method, body, x[400:]) == y[400:]).mean() > 0.93
    assert (classifiers.packed_predict(method, body, x[:400]) == y[:400]).mean() > 0.95


@pytest.mark.parametrize("method", classifiers.METHODS[1:])
def test_bent_borders(method):
    """A ring about a disc: no straight border parts them."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1200, 2))
    y = ((x**2).sum(axis=1) > 1.4).astype(int)
    body = classifiers.packed_fit(method, x[:600], y[:600], 0)
    assert (classifiers.packed_predict(method, body, x[600:]) == y[600:]).mean() > 0.93


def test_logistic_is_at_the_minimum():
    """The gradient of the penalised likelihood is nought."""
    x, y = blobs(2, 300, 5, 3, 0.5)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w = classifiers.fit_logistic(z, y, 3, np.random.default_rng(0))["w"]
    z1 = np.c_[z, np.ones(len(z))]
    p = np.exp(z1 @ w)
    p /= p.sum(axis=1, keepdims=True)
    grad = z1.T @ (p - np.eye(3)[y]) + np.r_[w[:-1], np.zeros((1, 3))]
    assert np.abs(grad).max() < 1e-3


def test_svm_meets_its_conditions():
    """Rows outside the margin have no weight, rows inside it the greatest."""
    x, y = blobs(3, 200, 3, 2, 0.8)
    model = classifiers.fit_svm(x, y, 2, np.random.default_rng(0))
    k = np.exp(-model["gamma"] * ((x[:, None] - model["x"][None]) ** 2).sum(axis=2))
    margin = (k @ model["w"][0] + model["b"][0]) * np.where(y == 0, 1, -1)
    weight = np.zeros(len(x))
    for v, w in zip(model["x"], model["w"][0], strict=True):
        weight[np.flatnonzero((x == v).all(axis=1))] = abs(w)
    assert (weight[margin > 1.01] < 1e-6).all() and (weight[margin < 0.99] > 1 - 1e-6).all()


def test_one_class_and_constant_features():
    x = np.ones((20, 3))
    for method in classifiers.METHODS:
        assert (classifiers.packed_predict(method, classifiers.packed_fit(method, x, np.full(20, 4), 0), x) == 4).all()
        assert classifiers.packed_predict(method, classifiers.packed_fit(method, x, np.arange(20) % 2, 0), x).shape == (20,)


def frame(spark, configs, n=120):
    rows = []
    for c in range(configs):
        x, y = blobs(c, n, 4, 3, 1.5 if c % 2 == 0 else 0.0)
        rows += [(f"set{c}", i, int(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "config string, id long, y int, x array<double>")


def test_sweep_scores(spark):
    predicted = classifiers.decoding_sweep(frame(spark, 2), ["config"], "y", "id", methods=("logistic", "svm")).cache()
    assert predicted.count() == 2 * 2 * 120 and predicted.select("config", "method", "id").distinct().count() == 480
    got = {(r.config, r.method): r for r in classifiers.sweep_scores(predicted, ["config"], "y").collect()}
    assert all(got["set0", m].mean_accuracy > 0.85 and got["set0", m].above_chance for m in ("logistic", "svm"))
    assert all(got["set1", m].mean_accuracy < 0.55 for m in ("logistic", "svm"))
    best = classifiers.best_configuration(classifiers.sweep_scores(predicted, ["config"], "y").withColumn("g", F.lit(1)), ["g"], ["config", "method"]).collect()
    assert len(best) == 1 and best[0].config == "set0" and best[0].configurations == 4 and best[0].above >= 2


def test_fits_hold_a_bounded_number_of_rows(spark):
    """All rows are predicted though fits see few; a fit's rows are the first in a hashed order."""
    rows = frame(spark, 1, 600)
    folded = decode.stratified_folds(rows, ["config"], "y", "id", 5)
    models = classifiers.keyed_fits(folded, ["config"], "y", "id", methods=("svm",), most=60)
    predicted = classifiers.keyed_predictions(folded, models, ["config"], "y", "id", bucket=50)
    assert predicted.count() == 600
    assert predicted.filter("y = predicted").count() > 500


def test_jobs_do_not_grow_with_the_configurations(spark):
    def jobs(configs):
        spark.sparkContext.setJobGroup(f"sweep{configs}", "")
        classifiers.decoding_sweep(frame(spark, configs, 40), ["config"], "y", "id", methods=("logistic",)).write.format("noop").mode("overwrite").save()
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"sweep{configs}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    assert jobs(6) <= jobs(1) + 2  # adaptive plans run a stage more or less as a job of its own


def test_counts_of_equal_rows_are_those_of_single_predictions(spark):
    """Rows of which each stands four times: scored once, counted four times."""
    once = frame(spark, 2, 60)
    rows = once.withColumn("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.col("id") + 1000 * c)))
    folded = decode.stratified_folds(rows, ["config"], "y", "id", 5).cache()
    models = classifiers.keyed_fits(folded, ["config"], "y", "id", most=60).cache()
    by = ["config", "fold", "method", "y", "predicted"]
    counts = classifiers.keyed_counts(folded, models, ["config"], "y", bucket=10)
    single = classifiers.keyed_predictions(folded, models, ["config"], "y", "id").groupBy(*by).agg(F.count("*").alias("n"))
    told = lambda df: sorted(tuple(r) for r in df.groupBy(*by).agg(F.sum("n")).collect())
    assert told(counts) == told(single)
    a, b = (sorted(tuple(r) for r in classifiers.sweep_scores(df, ["config"], "y", "n").collect()) for df in (counts, single))
    assert a == b and sum(r[2] for r in a) == 2 * 240 * len(classifiers.METHODS)


def test_draws_by_labels_alone(spark):
    """What a fit may see follows from ids and folds, before there are features."""
    rows = frame(spark, 1, 300)
    folded = decode.stratified_folds(rows, ["config"], "y", "id", 5)
    narrow = classifiers.drawn_rows(folded.drop("x"), ["config"], "id", 60)
    got = classifiers.fits_of_drawn(narrow.join(rows.select("id", "x"), "id"), ["config"], "y", "id", methods=("logistic",))
    want = classifiers.keyed_fits(folded, ["config"], "y", "id", methods=("logistic",), most=60)
    models = [{r.fold: bytes(r.model) for r in df.collect()} for df in (got, want)]
    assert narrow.count() == 75 and len(models[0]) == 5
    x = np.random.default_rng(0).standard_normal((50, 4))
    assert all((classifiers.packed_predict("logistic", models[0][k], x) == classifiers.packed_predict("logistic", models[1][k], x)).all() for k in range(5))


def test_nearest_means_come_to_the_rows(spark):
    """No row is shuffled to its fold's means, whatever the planner thinks of their size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["nearest_mean_train_accuracy"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert sum("Sort" in x for x in joins) == 1 and any("BroadcastNestedLoopJoin" in x for x in joins)  # the other is of sums by fold and label


def test_smoothing_makes_each_shift_once(spark):
    """However many weights speak of a neighbour, the window has it once: 21 shifts, where there were 121."""
    from trialspark.operators import windows

    df = spark.range(40).selectExpr("0 AS k", "id AS i", "cast(id AS double) AS v")
    plan = windows.savgol(df, ["k"], ["i"], "v", 11, 3)._jdf.queryExecution().analyzed().toString()
    assert plan.count("lag(") <= 21
