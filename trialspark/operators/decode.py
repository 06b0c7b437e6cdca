"""Decoding: cross-validated classifiers and their statistics.

Discriminant analysis is fitted from sums: each model key (session, configuration, fold, pair, ...) has class counts, sums
and one matrix of products, added up in the cluster, so hundreds of folds are one job. Only p x p solves run in a worker, a
model at a time; scoring joins the solved coefficients to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.scans import ranked, running, totals
from trialspark.operators.selection import hashed_order


def design(features: DataFrame, row: list[str], feature: str, value: str) -> DataFrame:
    """(row, x): each row's values as an array in the order of the features' names."""
    got = features.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct(F.col(feature).alias("f"), F.col(value).cast("double").alias("v")))).alias("_s"))
    return got.select(*row, F.transform("_s", lambda s: s["v"]).alias("x"))


def long_features(rows: DataFrame, row: list[str], x: str = "x") -> DataFrame:
    """(row, feature, value): the inverse of design(), features numbered from 0."""
    return rows.select(*row, F.posexplode(x).alias("feature", "value")).withColumn("value", F.col("value").cast("double"))


def standardized(features: DataFrame, keys: list[str], feature: str, value: str, name: str = "z", fit_on: Column | None = None) -> DataFrame:
    """features with z-scores by feature (population deviation, 0 counts as 1), fitted on the rows where fit_on holds."""
    v = F.col(value) if fit_on is None else F.when(fit_on, F.col(value))
    stats = features.groupBy(*keys, feature).agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))
    sd = F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    return features.join(stats, [*keys, feature]).withColumn(name, (F.col(value) - F.col("_m")) / sd).drop("_m", "_s")


def stratified_folds(rows: DataFrame, keys: list[str], label: str, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """rows with fold 0 .. k-1: each class is dealt out in a hashed order. k is cut to the least class, but not under 2."""
    own = Window.partitionBy(*keys, label)
    dealt = rows.withColumns({"_r": F.row_number().over(own.orderBy(hashed_order(id_col, seed), id_col)) - 1})
    least = rows.groupBy(*keys, label).count().groupBy(*keys).agg(F.greatest(F.lit(2), F.least(F.lit(k), F.min("count"))).alias("_k"))
    joined = dealt.join(least, keys) if keys else dealt.crossJoin(F.broadcast(least))
    return joined.withColumn("fold", F.pmod("_r", "_k").cast("int")).drop("_r", "_k")


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def class_moments(rows: DataFrame, keys: list[str], label: str, x: str = "x", weight: str | None = None) -> DataFrame:
    """(keys, label, n, s, g): counts, sums and matrices of products of batches of rows, to be added up by key. A row stands
    for `weight` rows."""
    rows = rows.select(*keys, label, x, (F.col(weight) if weight else F.lit(1)).cast("long").alias("_many"))

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            for key, own in pdf.groupby([*keys, label], sort=False, dropna=False):
                m, many = np.stack(own[x].to_list()).astype(float), own["_many"].to_numpy()
                times = m * many[:, None] if weight else m
                yield pd.DataFrame([[*key, int(many.sum()), times.sum(axis=0), (m.T @ times).ravel()]], columns=[*keys, label, "n", "s", "g"])

    return rows.mapInPandas(moments, f"{_schema(rows, [*keys, label])}, n long, s array<double>, g array<double>")


def lda_fit(rows: DataFrame, keys: list[str], label: str, x: str = "x", shrink: float = 0.0) -> DataFrame:
    """(keys, label, prior, mean, w, bias): linear discriminant functions w x + bias of each class, by pooled covariance.

    Sums of products are made by tasks over batches and added up by key. A covariance without full rank is inverted as far
    as it goes; shrink moves it towards a multiple of the identity.
    """
    key_schema = _schema(rows, [*keys, label])
    partial = class_moments(rows, keys, label, x)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [pdf[k].iloc[0] for k in keys]
        return pd.DataFrame([[*own, *row] for row in discriminants(*added_moments(pdf, label), shrink)], columns=[*keys, label, "prior", "mean", "w", "bias"])

    return partial.groupBy(*keys).applyInPandas(solve, f"{key_schema}, {DISCRIMINANT}")


DISCRIMINANT = "prior double, mean array<double>, w array<double>, bias double"


def added_moments(pdf: pd.DataFrame, label: str) -> tuple[dict, dict, dict]:
    """Counts, sums and matrices of products of each class, from rows of class_moments()."""
    by = pdf.groupby(label, sort=True)
    p = len(pdf["s"].iloc[0])
    n = {c: int(own["n"].sum()) for c, own in by}
    return n, {c: np.sum(own["s"].to_list(), axis=0) for c, own in by}, {c: np.sum(own["g"].to_list(), axis=0).reshape(p, p) for c, own in by}


def discriminants(n: dict, s: dict, g: dict, shrink: float) -> list[tuple]:
    """(class, prior, mean, w, bias) of each class with rows."""
    classes = [c for c in n if n[c] > 0]
    total = sum(n[c] for c in classes)
    within = sum(g[c] - np.outer(s[c], s[c]) / n[c] for c in classes)
    p = len(within)
    cov = within / max(1, total)
    cov = (1 - shrink) * cov + shrink * np.trace(cov) / p * np.eye(p)
    inverse = np.linalg.pinv(cov, hermitian=True)
    out = []
    for c in classes:
        mean = s[c] / n[c]
        w = inverse @ mean
        out.append((c, n[c] / total, mean, w, float(-0.5 * mean @ w + np.log(n[c] / total))))
    return out


def _held_out_moments(pdf: pd.DataFrame, label: str):
    """For each fold: (fold, moments of all rows but its own). Moments of all rows less those of the fold."""
    n, s, g = added_moments(pdf, label)
    for fold, own in pdf.groupby("fold", sort=True):
        m, t, h = added_moments(own, label)
        yield fold, tuple({c: whole[c] - part.get(c, 0) for c in whole} for whole, part in ((n, m), (s, t), (g, h)))


def lda_axes(rows: DataFrame, keys: list[str], label: str, x: str = "x", dims: int = 3) -> DataFrame:
    """(keys, axis, w, offset, share): the directions that part the classes best, and their shares of the variance between.

    Directions solve the eigenproblem of the spread between classes against that within; the largest weight is positive.
    """
    partial = class_moments(rows, keys, label, x)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf.groupby(label)["n"].sum()
        s = {c: np.sum(own["s"].to_list(), axis=0) for c, own in pdf.groupby(label)}
        p = len(next(iter(s.values())))
        centre = sum(s.values()) / n.sum()
        within, between = np.sum(pdf["g"].to_list(), axis=0).reshape(p, p), np.zeros((p, p))
        for c in n.index:
            mean = s[c] / n[c]
            within = within - n[c] * np.outer(mean, mean)
            between = between + n[c] * np.outer(mean - centre, mean - centre)
        values, vectors = np.linalg.eigh(within / n.sum())
        good = values > 1e-12 * values.max()
        white = vectors[:, good] / np.sqrt(values[good])
        spread, turned = np.linalg.eigh(white.T @ between @ white / n.sum())
        axes = white @ turned[:, ::-1]
        spread = np.clip(spread[::-1], 0, None)
        out = []
        for k in range(min(dims, len(n) - 1, axes.shape[1])):
            w = axes[:, k] * np.sign(axes[np.abs(axes[:, k]).argmax(), k])
            out.append([*[pdf[c].iloc[0] for c in keys], k, w, float(-centre @ w), float(spread[k] / spread.sum())])
        return pd.DataFrame(out, columns=[*keys, "axis", "w", "offset", "share"])

    key_schema = "".join(f"{_schema(rows, [c])}, " for c in keys)
    return partial.groupBy(*keys).applyInPandas(solve, f"{key_schema}axis int, w array<double>, offset double, share double")


def principal_axes(rows: DataFrame, keys: list[str], x: str = "x", dims: int = 2) -> DataFrame:
    """(keys, axis, w, offset, share): the first principal components of the centred rows; the largest weight is positive."""
    partial = class_moments(rows.withColumn("_all", F.lit(0)), keys, "_all", x)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s = pdf["n"].sum(), np.sum(pdf["s"].to_list(), axis=0)
        p = len(s)
        cov = np.sum(pdf["g"].to_list(), axis=0).reshape(p, p) / n - np.outer(s, s) / n**2
        values, vectors = np.linalg.eigh(cov)
        out = []
        for k in range(min(dims, p)):
            w = vectors[:, -1 - k]
            w = w * np.sign(w[np.abs(w).argmax()])
            out.append([*[pdf[c].iloc[0] for c in keys], k, w, float(-(s / n) @ w), float(values[-1 - k] / values.sum())])
        return pd.DataFrame(out, columns=[*keys, "axis", "w", "offset", "share"])

    key_schema = "".join(f"{_schema(rows, [c])}, " for c in keys)
    return partial.groupBy(*keys).applyInPandas(solve, f"{key_schema}axis int, w array<double>, offset double, share double")


def projected(rows: DataFrame, axes: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """rows with their place on each axis of lda_axes() or principal_axes(): (columns of rows, axis, place)."""
    own = axes.select(*keys, "axis", "w", "offset")
    joined = rows.join(own, keys) if keys else rows.crossJoin(F.broadcast(own))
    dot = F.aggregate(F.zip_with(x, "w", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda t, v: t + v)
    return joined.select(*rows.columns, "axis", (dot + F.col("offset")).alias("place"))


def lda_predict(rows: DataFrame, model: DataFrame, keys: list[str], label: str, x: str = "x", name: str = "predicted") -> DataFrame:
    """rows with predicted, its probability, and scores (class -> probability): a softmax of the discriminants.

    Models are a row for each key, joined by it. Ties go to the first class.
    """
    packed = model.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("c"), "w", "bias"))).alias("_m")) if keys else model.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("c"), "w", "bias"))).alias("_m"))
    joined = rows.join(packed, keys) if keys else rows.crossJoin(F.broadcast(packed))
    return _scored(joined, rows.columns, x, name)


def _scored(joined: DataFrame, columns: list[str], x: str, name: str) -> DataFrame:
    """lda_predict() of rows that have their model in _m: (c, w, bias) of each class."""
    dot = lambda w: F.aggregate(F.zip_with(x, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda t, v: t + v)
    scored = joined.withColumn("_d", F.transform("_m", lambda m: F.struct((dot(m["w"]) + m["bias"]).alias("d"), m["c"].alias("c"))))
    top = F.array_max(F.transform("_d", lambda d: d["d"]))
    weights = scored.withColumn("_t", top).withColumn("_e", F.transform("_d", lambda d: F.struct(d["c"].alias("c"), F.exp(d["d"] - F.col("_t")).alias("e"))))
    total = F.aggregate("_e", F.lit(0.0), lambda t, e: t + e["e"])
    out = weights.withColumn("_p", F.transform("_e", lambda e: F.struct(e["c"].alias("c"), (e["e"] / total).alias("p"))))
    best = F.filter("_d", lambda d: d["d"] == F.col("_t"))[0]["c"]
    return out.select(*columns, best.alias(name), F.array_max(F.transform("_p", lambda p: p["p"])).alias("confidence"), F.col("_p").alias("scores"))


def cross_validated(rows: DataFrame, keys: list[str], label: str, id_col: str, x: str = "x", k: int = 5, seed: int = 0, shrink: float = 0.0) -> DataFrame:
    """rows with fold and the prediction of the model that did not see their fold; all folds of all keys are one fit."""
    folded = stratified_folds(rows, keys, label, id_col, k, seed)
    return lda_predict(folded, held_out_models(folded, keys, label, x, shrink), [*keys, "fold"], label, x)


def held_out_models(folded: DataFrame, keys: list[str], label: str, x: str = "x", shrink: float = 0.0, weight: str | None = None) -> DataFrame:
    """(keys, fold, label, prior, mean, w, bias): for each fold the model of the other folds' rows.

    Each row is added up once, in its own fold: a fold's training sums are those of all rows less its own.
    """
    partial = class_moments(folded, [*keys, "fold"], label, x, weight)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [pdf[k].iloc[0] for k in keys]
        rows = [[*own, fold, *row] for fold, moments in _held_out_moments(pdf, label) for row in discriminants(*moments, shrink)]
        return pd.DataFrame(rows, columns=[*keys, "fold", label, "prior", "mean", "w", "bias"])

    return partial.groupBy(*keys).applyInPandas(solve, f"{_schema(folded, [*keys, 'fold', label])}, {DISCRIMINANT}")


def pairwise_cross_validated(rows: DataFrame, keys: list[str], label: str, id_col: str, x: str = "x", k: int = 5, seed: int = 0, shrink: float = 0.0, least: int = 20) -> DataFrame:
    """(rows, a, b, class, fold, predicted, ...): rows times the pairs of labels they belong to, predicted out of fold.

    Labels with under `least` rows have no pairs. All pairs are solved from the same sums by fold and label.
    """
    return pairwise_predictions(pair_folds(rows, keys, label, id_col, k, seed, least), keys, label, x, shrink)


def pair_folds(rows: DataFrame, keys: list[str], label: str, id_col: str, k: int = 5, seed: int = 0, least: int = 20) -> DataFrame:
    """rows with their folds; labels with under `least` rows are left out."""
    enough = rows.groupBy(*keys, label).count().filter(F.col("count") >= least).select(*keys, label)
    return stratified_folds(rows.join(enough, [*keys, label], "left_semi"), keys, label, id_col, k, seed)


def pairwise_predictions(folded: DataFrame, keys: list[str], label: str, x: str = "x", shrink: float = 0.0, weight: str | None = None) -> DataFrame:
    """pairwise_cross_validated() of rows that have their folds (pair_folds); a row stands for `weight` rows.

    A row is joined to all models of its fold and label at once, and meets its pairs where it lies.
    """
    partial = class_moments(folded, [*keys, "fold"], label, x, weight)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own, out = [pdf[c].iloc[0] for c in keys], []
        for fold, moments in _held_out_moments(pdf, label):
            classes = sorted(moments[0])
            for i, a in enumerate(classes):
                for b in classes[i + 1 :]:
                    for row in discriminants(*[{c: m[c] for c in (a, b)} for m in moments], shrink):
                        out.append([*own, fold, a, b, int(row[0] == b), *row[1:]])
        return pd.DataFrame(out, columns=[*keys, "fold", "a", "b", "class", "prior", "mean", "w", "bias"])

    kind = folded.schema[label].dataType.simpleString()
    models = partial.groupBy(*keys).applyInPandas(solve, f"{_schema(folded, [*keys, 'fold'])}, a {kind}, b {kind}, class int, {DISCRIMINANT}")
    packed = models.groupBy(*keys, "fold", "a", "b").agg(F.array_sort(F.collect_list(F.struct(F.col("class").alias("c"), "w", "bias"))).alias("_m"))
    side = lambda own, c: F.struct(F.col(own).alias(label), F.struct("a", "b", F.lit(c).alias("class"), "_m").alias("_pair"))
    sides = packed.select(*keys, "fold", F.explode(F.array(side("a", 0), side("b", 1))).alias("_s")).select(*keys, "fold", "_s.*")
    own = sides.groupBy(*keys, "fold", label).agg(F.collect_list("_pair").alias("_pairs"))
    met = folded.join(own, [*keys, "fold", label]).withColumn("_pair", F.explode("_pairs")).select(*folded.columns, "_pair.*")
    return _scored(met, [*folded.columns, "a", "b", "class"], x, "predicted")


def train_accuracy(folded: DataFrame, models: DataFrame, keys: list[str], label: str, x: str = "x") -> DataFrame:
    """(keys, train_accuracy): the mean over folds of each fold's model's accuracy on the rows it was fitted on."""
    held = models.groupBy(*keys).agg(F.collect_set("fold").alias("_held"))
    spread = folded.join(held, keys) if keys else folded.crossJoin(F.broadcast(held))  # a row of all folds' numbers
    spread = spread.withColumn("_h", F.explode("_held")).filter("fold <> _h").drop("fold", "_held").withColumnRenamed("_h", "fold")
    return mean_over_folds(lda_predict(spread, models, [*keys, "fold"], label, x), keys, label, "train_accuracy")


def mean_over_folds(predicted: DataFrame, keys: list[str], label: str, name: str) -> DataFrame:
    """(keys, name): the mean over folds of the share of right predictions."""
    f = predicted.groupBy(*keys, "fold").agg(F.avg((F.col(label) == F.col("predicted")).cast("double")).alias("_a"))
    return f.groupBy(*keys).agg(F.avg("_a").alias(name))


def fold_scores(predicted: DataFrame, keys: list[str], label: str, name: str = "predicted", weight: str | None = None) -> DataFrame:
    """(keys, n, accuracy, fold_mean, fold_sd, classes, chance, above): over rows, and over folds (population deviation). A row
    stands for `weight` rows."""
    many = F.col(weight) if weight else F.lit(1).cast("long")
    right = (F.col(label) == F.col(name)).cast("double")
    f = predicted.groupBy(*keys, "fold").agg((F.sum(right * many) / F.sum(F.when(right.isNotNull(), many))).alias("_a"), F.sum(right * many).alias("_r"), F.sum(many).alias("_n"))
    out = f.groupBy(*keys).agg(F.sum("_n").alias("n"), (F.sum("_r") / F.sum("_n")).alias("accuracy"), F.avg("_a").alias("fold_mean"), F.stddev_pop("_a").alias("fold_sd"))
    classes = predicted.groupBy(*keys).agg(F.count_distinct(label).alias("classes"))
    joined = out.join(classes, keys) if keys else out.crossJoin(classes)
    return joined.withColumn("chance", 1 / F.col("classes")).withColumn("above", F.col("accuracy") - F.col("chance"))


def confusion(predicted: DataFrame, keys: list[str], label: str, name: str = "predicted") -> DataFrame:
    """(keys, label, predicted, n, share): counts, and shares of each label's rows."""
    n = predicted.groupBy(*keys, label, name).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, label)))


def class_scores(matrix: DataFrame, keys: list[str], label: str, name: str = "predicted") -> DataFrame:
    """(keys, class, support, precision, recall, f1) of a confusion(); classes as text; 0 where nothing was predicted."""
    hit = F.when(F.col(label) == F.col(name), F.col("n")).otherwise(0)
    r = matrix.groupBy(*keys, F.col(label).cast("string").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("_h"))
    p = matrix.groupBy(*keys, F.col(name).cast("string").alias("class")).agg(F.sum("n").alias("_p"))
    both = r.join(p, [*keys, "class"], "left")
    precision, recall = F.coalesce(F.col("_h") / F.col("_p"), F.lit(0.0)), F.col("_h") / F.col("support")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return both.select(*keys, "class", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def macro_f1(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, macro_f1, mean_recall, weighted_recall)."""
    return scores.groupBy(*keys).agg(F.avg("f1").alias("macro_f1"), F.avg("recall").alias("mean_recall"), (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("weighted_recall"))


def shuffled_labels(rows: DataFrame, keys: list[str], label: str, id_col: str, seed: int) -> DataFrame:
    """rows with their labels permuted within the keys: the k-th row by id gets the label of the k-th in a hashed order."""
    a = ranked(rows.drop(label), keys, [id_col], "_k")
    b = ranked(rows.select(*keys, id_col, label, hashed_order(id_col, seed).alias("_h")), keys, ["_h", id_col], "_k").select(*keys, label, "_k")
    return a.join(b, [*keys, "_k"]).drop("_k")


def t_one_sample(df: DataFrame, keys: list[str], value: str, against: float) -> DataFrame:
    """(keys, n, mean, t, dof)."""
    s = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
    return s.select(*keys, "n", "mean", F.when(F.col("_s") > 0, (F.col("mean") - against) / (F.col("_s") / F.sqrt("n"))).alias("t"), (F.col("n") - 1).alias("dof"))


def t_independent(df: DataFrame, keys: list[str], group: str, a, b, value: str) -> DataFrame:
    """(keys, n_a, n_b, difference, t, dof): Student's, with pooled variance."""
    side = lambda g: F.when(F.col(group) == F.lit(g), F.col(value).cast("double"))
    s = df.groupBy(*keys).agg(*[f(side(g)).alias(f"{n}_{k}") for k, g in (("a", a), ("b", b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    dof = F.col("n_a") + F.col("n_b") - 2
    pooled = ((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / dof
    se = F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b")))
    return s.select(*keys, "n_a", "n_b", (F.col("m_a") - F.col("m_b")).alias("difference"), F.when(se > 0, (F.col("m_a") - F.col("m_b")) / se).alias("t"), dof.alias("dof"))


def t_paired(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    return t_one_sample(df.withColumn("_d", F.col(a) - F.col(b)), keys, "_d", 0.0)


def _by_score(scored: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Each distinct score: its positive and negative rows (_p, _n), those of all lower scores, and those of all."""
    at = scored.groupBy(*keys, score).agg(F.sum(F.col(positive)).cast("double").alias("_p"), F.sum(1 - F.col(positive)).cast("double").alias("_n"))
    below = running(at, keys, [score], {"_p_below": F.col("_p"), "_n_below": F.col("_n")})
    return totals(below, keys, _p_all=F.sum("_p"), _n_all=F.sum("_n"))


def roc_points(scored: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """(keys, threshold, fpr, tpr): rates of rows at or over each distinct score; positive is 0 or 1."""
    over = lambda c: (F.col(f"_{c}_all") - F.col(f"_{c}_below")) / F.nullif(F.col(f"_{c}_all"), F.lit(0.0))
    return _by_score(scored, keys, score, positive).select(*keys, F.col(score).alias("threshold"), over("n").alias("fpr"), over("p").alias("tpr"))


def auc(scored: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """(keys, n_pos, n_neg, auc): the chance that a positive row outscores a negative one, ties counting half.

    Rows are added up by distinct score first, and running sums go over buckets of scores (scans.running).
    """
    won = _by_score(scored, keys, score, positive).withColumn("_w", F.col("_p") * (F.col("_n_below") + F.col("_n") / 2))
    out = won.groupBy(*keys).agg(F.sum("_p").cast("long").alias("n_pos"), F.sum("_n").cast("long").alias("n_neg"), F.sum("_w").alias("_w"))
    return out.select(*keys, "n_pos", "n_neg", (F.col("_w") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auc"))


def pairwise_rows(rows: DataFrame, label: str) -> DataFrame:
    """Rows times the pairs of labels they belong to: a < b, class 0 or 1."""
    d = rows.select(label).filter(F.col(label).isNotNull()).distinct()
    pairs = d.select(F.col(label).alias("a")).join(d.select(F.col(label).alias("b")), F.col("a") < F.col("b"))
    first = rows.join(pairs, F.col(label) == F.col("a")).withColumn("class", F.lit(0))
    return first.unionByName(rows.join(pairs, F.col(label) == F.col("b")).withColumn("class", F.lit(1)))


def symmetric(results: DataFrame, score: str) -> DataFrame:
    """(a, b, score) with b, a and, with 1, the diagonal."""
    back = results.select(F.col("b").alias("a"), F.col("a").alias("b"), score)
    own = results.select("a").union(results.select("b")).distinct().select("a", F.col("a").alias("b"), F.lit(1.0).alias(score))
    return results.select("a", "b", score).unionByName(back).unionByName(own)


def repeated_splits(rows: DataFrame, keys: list[str], label: str, id_col: str, n_train: list[int], n_test: int, seeds: list[int]) -> DataFrame:
    """rows of each (n_train, seed) split with part: for each class the first n_train, then n_test in a hashed order.

    Sizes for which a class (of a key) has too few rows are left out.
    """
    least = rows.groupBy(*keys, label).count().groupBy(*keys).agg(F.min("count").alias("_least"))
    rows = (rows.join(least, keys) if keys else rows.crossJoin(F.broadcast(least))).select(*rows.columns, "_least")
    configs = F.explode(F.array(*[F.struct(F.lit(n).alias("n_train"), F.lit(s).alias("seed")) for n in n_train for s in seeds]))
    spread = rows.withColumn("_c", configs).filter(F.col("_c.n_train") + n_test <= F.col("_least")).select(*rows.drop("_least").columns, "_c.n_train", "_c.seed")
    w = Window.partitionBy(*keys, "n_train", "seed", label).orderBy(F.xxhash64(F.col(id_col), F.col("seed")), id_col)
    ranked = spread.withColumn("_r", F.row_number().over(w))
    part = F.when(F.col("_r") <= F.col("n_train"), "train").when(F.col("_r") <= F.col("n_train") + n_test, "test")
    return ranked.withColumn("part", part).filter("part IS NOT NULL").drop("_r")


def split_accuracy(split: DataFrame, keys: list[str], label: str, x: str = "x", shrink: float = 0.0) -> DataFrame:
    """(keys, n, accuracy): a model for each key from its training part, tried on its test part."""
    model = lda_fit(split.filter("part = 'train'"), keys, label, x, shrink)
    p = lda_predict(split.filter("part = 'test'"), model, keys, label, x)
    return p.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(label) == F.col("predicted")).cast("double")).alias("accuracy"))


def ellipsoids(rows: DataFrame, keys: list[str], label: str, x: str = "x", dims: int = 3) -> DataFrame:
    """(keys, label, dim, mean, sd): of the first dims coordinates; sd is the population's."""
    long = rows.select(*keys, label, F.posexplode(F.slice(x, 1, dims)).alias("dim", "value"))
    return long.groupBy(*keys, label, "dim").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def halton(points: int, dims: int) -> np.ndarray:
    """(points, dims) in the unit cube, spread evenly: in each dimension the numbers 1, 2, ... mirrored at the point, in a prime base."""
    primes = [p for p in range(2, 20 * dims + 10) if all(p % q for q in range(2, int(p**0.5) + 1))][:dims]
    out = np.zeros((points, dims))
    for d, base in enumerate(primes):
        n, scale = np.arange(1, points + 1), 1.0 / base
        while n.any():
            out[:, d] += scale * (n % base)
            n, scale = n // base, scale / base
    return out


def overlap(shapes: DataFrame, label: str, points: int = 50_000) -> DataFrame:
    """(a, b, overlap): share of a's ellipsoid (one deviation) that lies in b's, by points spread over both bounding boxes; 1 for a with a.

    The points are a low-discrepancy sequence, made in the task and the same for every pair: a pair is one row. Pairs grow with
    the square of the number of labels, which is one of conditions and not of rows.
    """
    packed = shapes.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "sd"))).alias("d"))
    a, b = packed.select(F.col(label).alias("a"), F.col("d").alias("da")), packed.select(F.col(label).alias("b"), F.col("d").alias("db"))

    @F.pandas_udf("double")
    def share(ma: pd.Series, sa: pd.Series, mb: pd.Series, sb: pd.Series) -> pd.Series:
        out, spread = [], {}
        for m, s, n, t in zip(ma, sa, mb, sb, strict=True):
            u = spread.setdefault(len(m), halton(points, len(m)) if len(m) not in spread else None)
            low, high = np.minimum(m - s, n - t), np.maximum(m + s, n + t)
            x = low + u * (high - low)
            with np.errstate(divide="ignore", invalid="ignore"):
                own, other = (((x - c) / r) ** 2 for c, r in ((m, s), (n, t)))
            inside, both = own.sum(axis=1) <= 1, (own.sum(axis=1) <= 1) & (other.sum(axis=1) <= 1)
            out.append(both.sum() / inside.sum() if inside.any() else None)
        return pd.Series(out, dtype="float64")

    pairs = a.join(b, F.col("a") != F.col("b"))
    found = pairs.select("a", "b", F.nanvl(share("da.mean", "da.sd", "db.mean", "db.sd"), F.lit(None).cast("double")).alias("overlap"))
    return found.unionByName(packed.select(F.col(label).alias("a"), F.col(label).alias("b"), F.lit(1.0).alias("overlap")))


def importance(model: DataFrame, keys: list[str], w: str = "w") -> DataFrame:
    """(keys, feature, importance): mean absolute coefficient over the classes."""
    return model.select(*keys, F.posexplode(w).alias("feature", "_w")).groupBy(*keys, "feature").agg(F.avg(F.abs("_w")).alias("importance"))


def confidence_density(predicted: DataFrame, label: str, bins: int = 20) -> DataFrame:
    """(correct, bin, n, density): the chosen class's probability in bins of 0 to 1, for right and wrong rows."""
    right = predicted.withColumn("correct", F.col(label) == F.col("predicted")).withColumn("bin", F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int"))
    n = right.groupBy("correct", "bin").agg(F.count("*").alias("n"))
    return n.withColumn("density", F.col("n") * bins / F.sum("n").over(Window.partitionBy("correct")))


def pair_family(a: Column, b: Column) -> Column:
    """What kind of pair two orientations are: orthogonal if 90 apart, adjacent if 45 apart, else near or far."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    d = F.least(d, 180 - d)
    return F.when(d == 90, "orthogonal").when(d == 45, "adjacent").when(d < 45, "near").otherwise("far")


def family_summary(results: DataFrame, keys: list[str], score: str, a: str = "a", b: str = "b") -> DataFrame:
    """(keys, family, n, mean, sd, cardinal): scores by kind of pair; cardinal is the mean over 0 and 90 alone."""
    cardinal = F.col(a).isin(0, 90) & F.col(b).isin(0, 90)
    out = results.withColumn("family", pair_family(F.col(a), F.col(b))).groupBy(*keys, "family")
    return out.agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"), F.avg(F.when(cardinal, F.col(score))).alias("cardinal"))
