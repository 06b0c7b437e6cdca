"""Decoding of trials over configurations: feature sets, phases and fields, by several classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.operators import classifiers, decode, rates
from trialspark.plans.around import _hits
from trialspark.plans.base import DAY, HOUR, RESP, onsets, query, responses, table

#: Phases of the day after an onset: from and to.
PHASES = {"on": (0, DAY // 3), "off": (DAY // 3, 2 * DAY // 3), "full": (0, DAY)}
#: Training rows of a fit at most: a bound for what a worker holds.
MOST = 500


def fields(spark, d) -> DataFrame:
    """(trial, field, y): the fields' labels are the quarter of the day (left) and the weekday (right). Folds and draws follow
    from these alone, so they are made before there are features, once for all feature sets and phases."""
    return onsets(spark, d).select("trial", F.explode(F.map_from_arrays(F.array(F.lit("left"), F.lit("right")), F.array("quarter", "weekday"))).alias("field", "y"))


def configured(spark, d, labelled: DataFrame) -> DataFrame:
    """(feature_set, phase, columns of labelled, x): the features of labelled trials in each set and phase. Trials meet their
    labels before their features are dealt out to the sets."""
    hits, trials, keys = _hits(spark, d).filter("rel >= 0"), onsets(spark, d), ["user_id", "trial"]
    long = []
    for phase, (low, high) in PHASES.items():
        own = hits.filter((F.col("rel") >= low) & (F.col("rel") < high)).withColumn("rel", F.col("rel") - low)
        features = rates.temporal_features(own, trials, keys, "rel", high - low, 20, HOUR).drop("user_id", "on", "quarter", "weekday")
        long.append(features.withColumn("phase", F.lit(phase)))
    return rates.feature_vectors(reduce(DataFrame.unionByName, long).join(labelled, "trial"), ["phase", *labelled.columns])


def _combined(spark, d, folded: DataFrame) -> DataFrame:
    """(field, fold, y, x, n): how many of the folded trials have these features in the whole day."""
    rows = configured(spark, d, folded).filter("feature_set = 'combined' AND phase = 'full'")
    return rows.groupBy("field", "fold", F.col("y").cast("int").alias("y"), "x").agg(F.count("*").alias("n"))


KEYS = ["feature_set", "phase", "field"]


@query()
def decoding_sweep(spark, d):
    """Out-of-fold accuracy of four classifiers for each feature set, phase and field; the fits are one keyed job."""
    folded = decode.stratified_folds(fields(spark, d), ["field"], "y", "trial", 5)
    drawn = classifiers.drawn_rows(folded, ["field"], "trial", MOST)
    models = classifiers.fits_of_drawn(configured(spark, d, drawn), KEYS, "y", "trial")
    counts = classifiers.keyed_counts(configured(spark, d, folded), models, KEYS, "y")
    return classifiers.sweep_scores(counts, KEYS, "y", "n")


@query()
def classifier_suite(spark, d):
    """Out-of-fold predictions of the four classifiers over five folds of the embeddings."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return classifiers.decoding_sweep(rows, [], "label", "vec_id").select("vec_id", "label", "fold", "method", "predicted")


@query()
def field_accuracy(spark, d):
    """Discriminant analysis of both fields' labels from one matrix: the field is part of the models' key."""
    rows = _combined(spark, d, decode.stratified_folds(fields(spark, d), ["field"], "y", "trial", 5))
    predicted = decode.lda_predict(rows, decode.held_out_models(rows, ["field"], "y", shrink=0.1, weight="n"), ["field", "fold"], "y")
    return decode.fold_scores(predicted, ["field"], "y", weight="n")


@query()
def field_pair_families(spark, d):
    """Pairwise accuracies of the fields' labels (as orientations of 22.5 degrees a step), summed up by kind of pair and field."""
    rows = _combined(spark, d, decode.pair_folds(fields(spark, d), ["field"], "y", "trial"))
    predicted = decode.pairwise_predictions(rows, ["field"], "y", shrink=0.1, weight="n")
    scores = decode.fold_scores(predicted, ["field", "a", "b"], "class", weight="n").withColumns({"a": F.col("a") * 22.5, "b": F.col("b") * 22.5})
    return decode.family_summary(scores, ["field"], "accuracy")


CONFIGS = "c AS (SELECT * FROM (VALUES ('left', 'rates', 1), ('left', 'timing', 2), ('right', 'rates', 3), ('right', 'timing', 4)) t(field, feature_set, k), (VALUES ('first', 0), ('second', 5)) m(method, off))"
GIVEN_SWEEP = f"{CONFIGS}, g AS (SELECT field, feature_set, method, vec_id, label, CAST(vec_id % 5 AS INTEGER) AS fold, CASE WHEN (vec_id * k + off) % (k + 3) = 0 THEN label ELSE CAST((label + vec_id) % 10 AS INTEGER) END AS predicted FROM embeddings, c)"
SWEEP_SCORES = f"""{GIVEN_SWEEP}, f AS (SELECT field, feature_set, method, fold, avg(CAST(label = predicted AS INTEGER)) AS a, count(*) AS n FROM g GROUP BY ALL), ch AS (SELECT 1.0 / count(DISTINCT label) AS chance FROM embeddings),
s AS (SELECT field, feature_set, method, CAST(sum(n) AS BIGINT) AS n, count(*) AS folds, avg(a) AS mean_accuracy, stddev_pop(a) AS sd_accuracy, stddev_samp(a) AS sd, any_value(chance) AS chance FROM f, ch GROUP BY ALL),
t AS (SELECT *, CASE WHEN sd > 0 THEN (mean_accuracy - chance) / (sd / sqrt(folds)) END AS t FROM s)"""


def _given_sweep(spark, d):
    """Predictions that follow from the ids, as if eight configurations had been fitted: one in a few is right."""
    configs = [F.struct(F.lit(f).alias("field"), F.lit(s).alias("feature_set"), F.lit(m).alias("method"), F.lit(k).alias("k"), F.lit(off).alias("off")) for f, s, k in (("left", "rates", 1), ("left", "timing", 2), ("right", "rates", 3), ("right", "timing", 4)) for m, off in (("first", 0), ("second", 5))]
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.explode(F.array(*configs)).alias("c"))
    right = (F.col("vec_id") * F.col("c.k") + F.col("c.off")) % (F.col("c.k") + 3) == 0
    predicted = F.when(right, F.col("label")).otherwise(((F.col("label") + F.col("vec_id")) % 10).cast("int"))
    return rows.select("c.field", "c.feature_set", "c.method", "vec_id", "label", (F.col("vec_id") % 5).cast("int").alias("fold"), predicted.alias("predicted"))


@query(f"WITH {SWEEP_SCORES} SELECT field, feature_set, method, n, folds, round(mean_accuracy, 6) AS mean_accuracy, round(sd_accuracy, 6) AS sd_accuracy, round(chance, 6) AS chance, round(t, 6) AS t, mean_accuracy > chance AND (sd = 0 OR t > 2.7764) AS above_chance FROM t")
def given_sweep_scores(spark, d):
    return classifiers.sweep_scores(_given_sweep(spark, d), ["field", "feature_set"], "label")


@query(f"WITH {SWEEP_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY mean_accuracy DESC, feature_set, method) AS r, count(*) OVER (PARTITION BY field) AS configurations, count(*) FILTER (WHERE mean_accuracy > chance AND (sd = 0 OR t > 2.7764)) OVER (PARTITION BY field) AS above FROM t) SELECT field, feature_set, method, round(mean_accuracy, 6) AS mean_accuracy, configurations, above FROM r WHERE r = 1")
def best_configuration(spark, d):
    scores = classifiers.sweep_scores(_given_sweep(spark, d), ["field", "feature_set"], "label")
    return classifiers.best_configuration(scores, ["field"], ["feature_set", "method"])


@query()
def lda_train_accuracy(spark, d):
    """Accuracy of discriminant analysis on the rows it was fitted on, over folds."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    folded = decode.stratified_folds(rows, [], "label", "vec_id", 5)
    return decode.train_accuracy(folded, decode.held_out_models(folded, [], "label", shrink=0.1), [], "label")


#: A linear score by one number, fitted on all folds but one: each class's mean; the nearest mean is predicted.
NEAREST = f"""{RESP}, r AS (SELECT l_orderkey * 10 + sf AS id, tf AS label, l_orderkey % 5 AS fold, CAST(rate AS DOUBLE) AS v FROM resp), s AS (SELECT fold, label, sum(v) AS s, count(*) AS n FROM r GROUP BY ALL),
m AS (SELECT h.fold, s.label, sum(s.s) / sum(s.n) AS mean FROM (SELECT DISTINCT fold FROM r) h JOIN s ON s.fold <> h.fold GROUP BY ALL), ms AS (SELECT fold, list(struct_pack(label, mean)) AS means FROM m GROUP BY fold),
p AS (SELECT ms.fold, r.label, list_min(list_transform(means, lambda m: struct_pack(d := abs(r.v - m.mean), l := m.label))).l AS predicted FROM r JOIN ms ON ms.fold <> r.fold),
f AS (SELECT fold, avg(CAST(label = predicted AS INTEGER)) AS a FROM p GROUP BY fold)"""


@query(f"WITH {NEAREST} SELECT round(avg(a), 6) AS train_accuracy FROM f")
def nearest_mean_train_accuracy(spark, d):
    """The same measure for a nearest-mean rule of one number, which SQL can fit too."""
    r = responses(spark, d).select((F.col("l_orderkey") * 10 + F.col("sf")).alias("id"), F.col("tf").alias("label"), (F.col("l_orderkey") % 5).alias("fold"), F.col("rate").cast("double").alias("v"))
    s = r.groupBy("fold", "label").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    whole = s.groupBy("label").agg(F.sum("s").alias("s_all"), F.sum("n").alias("n_all"))
    means = s.join(whole, "label").groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("label", ((F.col("s_all") - F.col("s")) / (F.col("n_all") - F.col("n"))).alias("mean")))).alias("means"))
    every = means.agg(F.collect_list(F.struct(F.col("fold").alias("held"), "means")).alias("_every"))  # a row of all folds' means
    spread = r.crossJoin(F.broadcast(every)).withColumn("_h", F.explode("_every")).select("fold", "label", "v", "_h.*").filter("fold <> held")
    best = F.array_min(F.transform("means", lambda m: F.struct(F.abs(F.col("v") - m["mean"]).alias("d"), m["label"].alias("l"))))["l"]
    return decode.mean_over_folds(spread.select(F.col("held").alias("fold"), "label", best.alias("predicted")), [], "label", "train_accuracy")
