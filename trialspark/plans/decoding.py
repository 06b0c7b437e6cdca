"""Decoding: embeddings are trials by units, their labels the conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark.operators import decode, selection
from trialspark.plans.base import SAMPLES, query, table


def _rows(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


EMB = "emb AS (SELECT vec_id, label, embedding FROM embeddings)"


@query(f"WITH {SAMPLES}, m AS (SELECT channel, avg(value) AS m, stddev_pop(value) AS s FROM samples GROUP BY channel) SELECT vec_id, channel AS feature, round((value - m.m) / CASE WHEN m.s = 0 THEN 1 ELSE m.s END, 6) AS z FROM (SELECT sample AS vec_id, channel, value FROM samples) s JOIN m USING (channel)")
def standardized(spark, d):
    f = decode.long_features(_rows(spark, d), ["vec_id"])
    return decode.standardized(f, [], "feature", "value").select("vec_id", "feature", "z")


@query(f"WITH {SAMPLES} SELECT sample AS vec_id, CAST(count(*) AS INTEGER) AS n, round(sum(value * (channel + 1)), 6) AS weighed FROM samples GROUP BY sample")
def design_matrix(spark, d):
    x = decode.design(decode.long_features(_rows(spark, d), ["vec_id"]), ["vec_id"], "feature", "value")
    return x.select("vec_id", F.size("x").alias("n"), F.aggregate(F.transform("x", lambda v, k: v * (k + 1)), F.lit(0.0), lambda s, v: s + v).alias("weighed"))


def _predicted(spark, d):
    return decode.cross_validated(_rows(spark, d), [], "label", "vec_id", k=5, shrink=0.1)


@query()
def lda_cv(spark, d):
    """Out-of-fold predictions of discriminant analysis; the tests hold the fit against NumPy."""
    return _predicted(spark, d).select("vec_id", "label", "fold", "predicted", "confidence")


@query()
def lda_scores(spark, d):
    return decode.fold_scores(_predicted(spark, d), [], "label")


@query()
def confusion(spark, d):
    return decode.confusion(_predicted(spark, d), [], "label")


@query()
def class_scores(spark, d):
    return decode.class_scores(decode.confusion(_predicted(spark, d), [], "label"), [], "label")


@query()
def confidence_density(spark, d):
    return decode.confidence_density(_predicted(spark, d), "label")


@query()
def feature_importance(spark, d):
    return decode.importance(decode.lda_fit(_rows(spark, d), [], "label", shrink=0.1), [])


@query()
def shuffle_control(spark, d):
    """Accuracy after the labels are permuted, over three seeds: about chance."""
    out = None
    for seed in range(3):
        one = decode.shuffled_labels(_rows(spark, d), [], "label", "vec_id", seed).withColumn("seed", F.lit(seed))
        out = one if out is None else out.unionByName(one)
    return decode.fold_scores(decode.cross_validated(out, ["seed"], "label", "vec_id", shrink=0.1), ["seed"], "label")


@query()
def pairwise_accuracy(spark, d):
    """A cross-validated model for each pair of labels, all from the same sums, as a symmetric matrix."""
    predicted = decode.pairwise_cross_validated(_rows(spark, d), [], "label", "vec_id", k=5, shrink=0.1)
    return decode.symmetric(decode.fold_scores(predicted, ["a", "b"], "class"), "accuracy")


@query()
def learning_curve(spark, d):
    """Accuracy against rows of each class in training, over seeds: 30 to 170 of a class where the table has as many, and fewer."""
    split = decode.repeated_splits(_rows(spark, d), [], "label", "vec_id", [5, 10, 20, *range(30, 171, 10)], 10, [0, 1, 2])
    return decode.split_accuracy(split, ["n_train", "seed"], "label", shrink=0.2)


RANK = "s AS (SELECT vec_id, CAST(label < 5 AS INTEGER) AS y, round(CAST(embedding[1] AS DOUBLE), 2) AS score FROM embeddings)"


def _scores(spark, d):
    return table(spark, d, "embeddings").select("vec_id", (F.col("label") < 5).cast("int").alias("y"), F.round(F.col("embedding")[0].cast("double"), 2).alias("score"))


@query(f"WITH {RANK}, p AS (SELECT score FROM s WHERE y = 1), n AS (SELECT score FROM s WHERE y = 0) SELECT (SELECT count(*) FROM p) AS n_pos, (SELECT count(*) FROM n) AS n_neg, round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END), 6) AS auc FROM p, n")
def roc_auc(spark, d):
    return decode.auc(_scores(spark, d), [], "score", "y")


@query(f"WITH {RANK}, t AS (SELECT DISTINCT score AS threshold FROM s) SELECT t.threshold, round(count(*) FILTER (WHERE s.y = 0 AND s.score >= t.threshold) / CAST(count(*) FILTER (WHERE s.y = 0) AS DOUBLE), 6) AS fpr, round(count(*) FILTER (WHERE s.y = 1 AND s.score >= t.threshold) / CAST(count(*) FILTER (WHERE s.y = 1) AS DOUBLE), 6) AS tpr FROM t, s GROUP BY t.threshold")
def roc_points(spark, d):
    return decode.roc_points(_scores(spark, d), [], "score", "y")


@query("WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings), m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)) SELECT vec_id, label FROM r, m WHERE r.r <= m.m")
def balanced_sample(spark, d):
    return selection.sample_per_class(table(spark, d, "embeddings").select("vec_id", "label"), "label", ["vec_id"])


@query("WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) SELECT vec_id, label FROM r WHERE (label = 0 AND r <= 3) OR (label = 1 AND r <= 5)")
def counted_sample(spark, d):
    return selection.sample_per_class(table(spark, d, "embeddings").select("vec_id", "label"), "label", ["vec_id"], counts={0: 3, 1: 5})


@query("""WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings), p AS (SELECT *, CASE WHEN n < 60 THEN n // 2 ELSE 40 END AS a, CASE WHEN n < 60 THEN n // 2 ELSE 20 END AS b FROM r)
SELECT vec_id, label, CASE WHEN r <= a THEN 'train' ELSE 'test' END AS part FROM p WHERE r <= a + b""")
def train_test_split(spark, d):
    return selection.train_test(table(spark, d, "embeddings").select("vec_id", "label"), "label", ["vec_id"])


SHAPES = "x AS (SELECT label, CAST(k AS INTEGER) AS dim, CAST(embedding[k + 1] AS DOUBLE) AS v FROM embeddings, range(3) r(k))"


@query(f"WITH {SHAPES} SELECT label, dim, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM x GROUP BY ALL")
def class_ellipsoids(spark, d):
    return decode.ellipsoids(_rows(spark, d), [], "label")


@query()
def ellipsoid_overlap(spark, d):
    """Monte Carlo overlaps of the classes' ellipsoids from hashed points."""
    return decode.overlap(decode.ellipsoids(_rows(spark, d), [], "label"), "label")


@query(f"WITH {SAMPLES}, e AS (SELECT sample AS vec_id, channel, value FROM samples), s AS (SELECT channel, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM e GROUP BY channel) SELECT channel, n, round(m, 6) AS mean, round((m - 0.01) / (s / sqrt(n)), 6) AS t, n - 1 AS dof FROM s")
def t_one_sample(spark, d):
    f = decode.long_features(_rows(spark, d), ["vec_id"]).withColumnRenamed("feature", "channel")
    return decode.t_one_sample(f, ["channel"], "value", 0.01)


@query(f"WITH {EMB}, r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM emb) SELECT vec_id, label FROM r WHERE r % 4 = 0")
def every_nth(spark, d):
    return selection.every_nth(_rows(spark, d).select("vec_id", "label"), ["label"], ["vec_id"], 4)


@query()
def lda_projection(spark, d):
    """Rows on the two axes that part the classes best (see the tests)."""
    rows = _rows(spark, d)
    return decode.projected(rows, decode.lda_axes(rows, [], "label", dims=2), []).select("vec_id", "label", "axis", "place")


@query()
def pca_embedding(spark, d):
    rows = _rows(spark, d)
    return decode.projected(rows, decode.principal_axes(rows, []), []).select("vec_id", "label", "axis", "place")
