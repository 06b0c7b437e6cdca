"""Classifiers fitted by key: every (key, method, fold) is a group of one Spark job, fitted in a worker from bounded rows.

The kernels below are small NumPy fits of one matrix; what is Spark's is all that surrounds them: folds, the bounded draw of
training rows, one shuffle that brings each fit its rows, and the scoring of all held-out rows in buckets.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.decode import _schema, stratified_folds
from trialspark.operators.selection import hashed_order

METHODS = ("logistic", "forest", "mlp", "svm")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_logistic(x: np.ndarray, y: np.ndarray, classes: int, rng: np.random.Generator, iterations: int = 1000, c: float = 1.0) -> dict:
    """Multinomial logistic regression with a squared penalty of 1 / (2 c), by limited-memory quasi-Newton steps."""
    x1, hot = np.c_[x, np.ones(len(x))], np.eye(classes)[y]
    free = np.ones(x1.shape[1])[:, None]
    free[-1] = 0  # the bias isn't held down

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x1 @ w
        z -= z.max(axis=1, keepdims=True)
        total = np.log(np.exp(z).sum(axis=1))
        grad = x1.T @ (np.exp(z - total[:, None]) - hot) + free * w / c
        return float((total - z[np.arange(len(y)), y]).sum() + 0.5 / c * (free * w * w).sum()), grad

    w = np.zeros((x1.shape[1], classes))
    f, g = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        if np.abs(g).max() < 1e-6 * len(y):
            break
        q, back = g.copy(), []
        for s, d in reversed(steps):
            a = (s * q).sum() / (s * d).sum()
            back.append(a)
            q -= a * d
        q *= (steps[-1][0] * steps[-1][1]).sum() / (steps[-1][1] ** 2).sum() if steps else 1 / max(1.0, np.abs(g).sum())
        for (s, d), a in zip(steps, reversed(back), strict=True):
            q += s * (a - (d * q).sum() / (s * d).sum())
        size, slope = 1.0, (g * q).sum()
        while size > 1e-10:
            w2 = w - size * q
            f2, g2 = loss(w2)
            if f2 <= f - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        if ((w2 - w) * (g2 - g)).sum() > 1e-12:
            steps = [*steps[-9:], (w2 - w, g2 - g)]
        w, f, g = w2, f2, g2
    return {"w": w}


def logistic_scores(model: dict, x: np.ndarray) -> np.ndarray:
    return np.c_[x, np.ones(len(x))] @ model["w"]


def fit_mlp(x: np.ndarray, y: np.ndarray, classes: int, rng: np.random.Generator, hidden: tuple[int, ...] = (100, 50), iterations: int = 1000, rate: float = 1e-3, alpha: float = 1e-4) -> dict:
    """Rectified layers by Adam in batches of 200; stops when the loss hasn't fallen by 1e-4 for ten rounds."""
    sizes = [x.shape[1], *hidden, classes]
    w = [rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:], strict=False)]
    w = [*w, *(np.zeros(b) for b in sizes[1:])]
    layers, m, v, t, best, idle = len(hidden) + 1, [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0, np.inf, 0
    batch = min(200, len(x))
    for _ in range(iterations):
        order, total = rng.permutation(len(x)), 0.0
        for lo in range(0, len(x), batch):
            at = order[lo : lo + batch]
            acts = [x[at]]
            for k in range(layers):
                z = acts[-1] @ w[k] + w[layers + k]
                acts.append(np.maximum(z, 0) if k < layers - 1 else _softmax(z))
            total += -np.log(np.maximum(acts[-1][np.arange(len(at)), y[at]], 1e-12)).sum()
            delta, grads = acts[-1].copy(), [None] * len(w)
            delta[np.arange(len(at)), y[at]] -= 1
            delta /= len(at)
            for k in range(layers - 1, -1, -1):
                grads[k], grads[layers + k] = acts[k].T @ delta + alpha * w[k] / len(at), delta.sum(axis=0)
                delta = (delta @ w[k].T) * (acts[k] > 0)
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m[k] / (np.sqrt(v[k]) + 1e-8)
        total /= len(x)
        idle = 0 if total < best - 1e-4 else idle + 1
        best = min(best, total)
        if idle >= 10:
            break
    return {f"w{k}": a for k, a in enumerate(w)}


def mlp_scores(model: dict, x: np.ndarray) -> np.ndarray:
    layers = len(model) // 2
    for k in range(layers):
        x = x @ model[f"w{k}"] + model[f"w{layers + k}"]
        x = np.maximum(x, 0) if k < layers - 1 else x
    return x


def fit_svm(x: np.ndarray, y: np.ndarray, classes: int, rng: np.random.Generator, c: float = 1.0, tolerance: float = 1e-3) -> dict:
    """Support vectors with an RBF kernel (gamma = 1 / (features x variance)), one machine for each pair of classes.

    The dual is solved by the pair of multipliers that most break its conditions, again and again.
    """
    gamma = 1 / max(1e-12, x.shape[1] * x.var())
    square = (x * x).sum(axis=1)
    weights, biases = [], []
    for a in range(classes):
        for b in range(a + 1, classes):
            at = np.flatnonzero((y == a) | (y == b))
            s = np.where(y[at] == a, 1.0, -1.0)
            k = np.exp(-gamma * np.maximum(square[at, None] + square[at] - 2 * x[at] @ x[at].T, 0))
            alpha, grad = np.zeros(len(at)), -np.ones(len(at))
            for _ in range(100 * len(at) + 1000):
                up = ((s > 0) & (alpha < c)) | ((s < 0) & (alpha > 0))
                low = ((s > 0) & (alpha > 0)) | ((s < 0) & (alpha < c))
                f = -s * grad
                if not up.any() or not low.any():
                    break
                i, j = int(np.where(up, f, -np.inf).argmax()), int(np.where(low, f, np.inf).argmin())
                if f[i] - f[j] < tolerance:
                    break
                step = (f[i] - f[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
                step = min(step, c - alpha[i] if s[i] > 0 else alpha[i], alpha[j] if s[j] > 0 else c - alpha[j])
                alpha[i] += s[i] * step
                alpha[j] -= s[j] * step
                grad += step * s * (k[i] - k[j])
            f = -s * grad
            free = (alpha > 1e-8) & (alpha < c - 1e-8)
            up = ((s > 0) & (alpha < c)) | ((s < 0) & (alpha > 0))
            low = ((s > 0) & (alpha > 0)) | ((s < 0) & (alpha < c))
            bias = f[free].mean() if free.any() else (np.where(up, f, -np.inf).max() + np.where(low, f, np.inf).min()) / 2 if len(at) else 0.0
            own = np.zeros(len(x))
            own[at] = alpha * s
            weights.append(own)
            biases.append(bias if np.isfinite(bias) else 0.0)
    used = np.flatnonzero(np.any(np.array(weights) != 0, axis=0)) if weights else np.zeros(0, dtype=int)
    return {"x": x[used], "w": np.array(weights)[:, used] if weights else np.zeros((0, 0)), "b": np.array(biases), "gamma": np.array(gamma), "classes": np.array(classes)}


def svm_scores(model: dict, x: np.ndarray) -> np.ndarray:
    """Votes of the pairs' machines; margins part equal votes."""
    classes, own = int(model["classes"]), model["x"]
    k = np.exp(-model["gamma"] * np.maximum((x * x).sum(axis=1)[:, None] + (own * own).sum(axis=1) - 2 * x @ own.T, 0))
    out, pairs = np.zeros((len(x), classes)), [(a, b) for a in range(classes) for b in range(a + 1, classes)]
    for (a, b), w, bias in zip(pairs, model["w"], model["b"], strict=True):
        margin = k @ w + bias
        out[:, a] += (margin > 0) + 1e-3 * np.tanh(margin)
        out[:, b] += (margin <= 0) - 1e-3 * np.tanh(margin)
    return out


def fit_forest(x: np.ndarray, y: np.ndarray, classes: int, rng: np.random.Generator, trees: int = 100) -> dict:
    """Trees over drawn rows, each node parted by the best of sqrt(features) features by Gini, until its rows are of one class.

    All trees grow a level at a time: their rows are sorted by node and value, and class counts run along them.
    """
    n, p = x.shape
    tries = max(1, int(np.sqrt(p)))
    rank = np.argsort(np.argsort(x, axis=0, kind="stable"), axis=0, kind="stable")
    drawn = np.bincount(np.repeat(np.arange(trees), n) * n + rng.integers(0, n, trees * n), minlength=trees * n)
    node, row = np.divmod(np.flatnonzero(drawn), n)
    weight = drawn[drawn > 0].astype(float)
    feature, cut, child, leaf = [np.full(trees, -1)], [np.zeros(trees)], [np.zeros(trees, dtype=np.int64)], [np.zeros((trees, classes))]
    base, width = 0, trees
    while len(row):
        counts = np.zeros((width, classes))
        np.add.at(counts, (node - base, y[row]), weight)
        leaf[-1] = counts
        open_ = (counts > 0).sum(axis=1) > 1
        alive = open_[node - base]
        row, node, weight = row[alive], node[alive], weight[alive]
        best, where, which = np.full(width, 1e-12), np.zeros(width), np.full(width, -1)
        size = counts.sum(axis=1)
        gini = size - (counts**2).sum(axis=1) / np.maximum(size, 1)
        picks = np.argsort(rng.random((width, p)), axis=1)[:, :tries] if p > tries else np.tile(np.arange(p), (width, 1))
        for t in range(picks.shape[1]):
            f = picks[node - base, t]
            order = np.argsort((node - base) * n + rank[row, f], kind="stable")
            r, m, v = row[order], node[order] - base, x[row[order], f[order]]
            run = np.zeros((len(r), classes))
            run[np.arange(len(r)), y[r]] = weight[order]
            run = np.cumsum(run, axis=0)
            first = np.flatnonzero(np.diff(m, prepend=-1))
            left = run - np.repeat(np.vstack([np.zeros((1, classes)), run[first[1:] - 1]]) if len(first) else run[:0], np.diff(np.append(first, len(r))), axis=0)
            right = counts[m] - left
            nl, nr = left.sum(axis=1), right.sum(axis=1)
            gain = gini[m] - (nl - (left**2).sum(axis=1) / np.maximum(nl, 1)) - (nr - (right**2).sum(axis=1) / np.maximum(nr, 1))
            able = np.append((m[1:] == m[:-1]) & (v[1:] > v[:-1]), False) if len(m) else np.zeros(0, dtype=bool)
            at = np.flatnonzero(able)
            at = at[np.lexsort((-gain[at], m[at]))]
            at = at[np.flatnonzero(np.diff(m[at], prepend=-1))]
            better = at[gain[at] > best[m[at]]]
            best[m[better]], where[m[better]], which[m[better]] = gain[better], (v[better] + v[better + 1]) / 2, f[order][better]
        split = which >= 0
        feature[-1], cut[-1] = which, where
        made = np.cumsum(split) - 1
        child[-1] = np.where(split, base + width + 2 * made, 0)
        going = split[node - base]
        row, node, weight = row[going], node[going], weight[going]
        side = x[row, which[node - base]] > where[node - base]
        node = child[-1][node - base] + side
        base, width = base + width, 2 * int(split.sum())
        if width:
            feature.append(np.full(width, -1))
            cut.append(np.zeros(width))
            child.append(np.zeros(width, dtype=np.int64))
            leaf.append(np.zeros((width, classes)))
    share = np.concatenate(leaf)
    return {"feature": np.concatenate(feature).astype(np.int32), "cut": np.concatenate(cut), "child": np.concatenate(child).astype(np.int32), "share": (share / np.maximum(share.sum(axis=1, keepdims=True), 1)).astype(np.float32), "trees": np.array(trees)}


def forest_scores(model: dict, x: np.ndarray) -> np.ndarray:
    """The trees' class shares, averaged. Only what has not come to a leaf yet goes on."""
    trees = int(model["trees"])
    at = np.tile(np.arange(trees), len(x))
    going = np.arange(len(at))
    while True:
        node = at[going]
        f = model["feature"][node]
        inner = f >= 0
        going, node, f = going[inner], node[inner], f[inner]
        if not len(going):
            return model["share"][at.reshape(len(x), trees)].mean(axis=1)
        at[going] = model["child"][node] + (x[going // trees, f] > model["cut"][node])


FITS = {"logistic": fit_logistic, "forest": fit_forest, "mlp": fit_mlp, "svm": fit_svm}
SCORES = {"logistic": logistic_scores, "forest": forest_scores, "mlp": mlp_scores, "svm": svm_scores}


def packed_fit(method: str, x: np.ndarray, y: np.ndarray, seed: int) -> bytes:
    """A fit on z-scored features (of these rows), as bytes. y: classes' numbers, of which not all need be there."""
    labels, own = np.unique(y, return_inverse=True)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1
    model = FITS[method]((x - mean) / sd, own, len(labels), np.random.default_rng(seed)) if len(labels) > 1 else {}
    out = io.BytesIO()
    np.savez_compressed(out, labels=labels, mean=mean, sd=sd, **{f"m_{k}": v for k, v in model.items()})
    return out.getvalue()


def packed_predict(method: str, body: bytes, x: np.ndarray) -> np.ndarray:
    with np.load(io.BytesIO(body)) as got:
        model = {k[2:]: got[k] for k in got.files if k.startswith("m_")}
        labels, mean, sd = got["labels"], got["mean"], got["sd"]
    return labels[SCORES[method](model, (x - mean) / sd).argmax(axis=1)] if model else np.repeat(labels, len(x))


def keyed_fits(folded: DataFrame, keys: list[str], label: str, id_col: str, x: str = "x", methods: tuple[str, ...] = METHODS, most: int = 2000, seed: int = 0) -> DataFrame:
    """(keys, fold, method, model): for each key and fold a fit of each method to the rows of the other folds.

    A fit takes at most `most` rows, the first in a hashed order: they are drawn before they are dealt out to the fits, so that
    no worker holds more, however many rows a key has. label counts from 0.
    """
    return fits_of_drawn(drawn_rows(folded, keys, id_col, most, seed), keys, label, id_col, x, methods, seed)


def drawn_rows(folded: DataFrame, keys: list[str], id_col: str, most: int, seed: int = 0) -> DataFrame:
    """folded's rows that fits may see, with _k, the last fold: of each key's folds the first rows in a hashed order, so that
    all folds but one have about `most`. Partitions keep no more than `most` of a fold before they are shuffled."""
    order = hashed_order(id_col, seed)
    drawn = folded.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "fold").orderBy(order, id_col))).filter(F.col("_r") <= most)
    held = folded.groupBy(*keys).agg(F.max("fold").alias("_k"))
    share = F.ceil(F.lit(most) / F.greatest(F.col("_k"), F.lit(1)))
    return (drawn.join(held, keys) if keys else drawn.crossJoin(F.broadcast(held))).filter(F.col("_r") <= share).drop("_r")


def fits_of_drawn(drawn: DataFrame, keys: list[str], label: str, id_col: str, x: str = "x", methods: tuple[str, ...] = METHODS, seed: int = 0) -> DataFrame:
    """keyed_fits() of rows that were drawn before (drawn_rows)."""
    spread = drawn.withColumn("_held", F.explode(F.sequence(F.lit(0), "_k"))).filter("fold <> _held")
    spread = spread.withColumn("method", F.explode(F.array(*map(F.lit, methods)))).select(*keys, F.col("_held").cast("int").alias("fold"), "method", F.col(label).cast("int").alias("_y"), F.col(id_col).alias("_id"), F.col(x).alias("_x"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id")
        body = packed_fit(pdf["method"].iloc[0], np.stack(pdf["_x"].to_list()).astype(float), pdf["_y"].to_numpy(), seed)
        return pdf.iloc[:1][[*keys, "fold", "method"]].assign(model=[body])

    return spread.groupBy(*keys, "fold", "method").applyInPandas(fit, f"{_schema(spread, [*keys, 'fold', 'method'])}, model binary")


def keyed_predictions(folded: DataFrame, models: DataFrame, keys: list[str], label: str, id_col: str, x: str = "x", bucket: int = 5000) -> DataFrame:
    """(keys, fold, method, id, label, predicted): each row by the models that didn't see its fold, some `bucket` rows at a time."""
    n = folded.groupBy(*keys, "fold").agg(F.ceil(F.count("*") / bucket).cast("int").alias("_n"))
    rows = folded.join(n, [*keys, "fold"]).withColumn("_b", F.pmod(F.xxhash64(id_col), F.col("_n")).cast("int"))
    rows = rows.select(*keys, "fold", "_b", F.col(id_col), F.col(label).cast("int").alias(label), F.col(x).alias("_x"))
    spread = models.join(n, [*keys, "fold"]).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    schema = f"{_schema(rows, [*keys, 'fold', id_col, label])}, method string, predicted int"

    def predict(own: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        columns = [*keys, "fold", id_col, label, "method", "predicted"]
        if not len(own) or not len(fits):
            return pd.DataFrame(columns=columns)
        m = np.stack(own["_x"].to_list()).astype(float)
        return pd.concat([own.assign(method=f.method, predicted=packed_predict(f.method, f.model, m)) for f in fits.itertuples(index=False)])[columns]

    by = [*keys, "fold", "_b"]
    return rows.groupBy(*by).cogroup(spread.groupBy(*by)).applyInPandas(predict, schema)


def keyed_counts(folded: DataFrame, models: DataFrame, keys: list[str], label: str, x: str = "x", bucket: int = 5000) -> DataFrame:
    """(keys, fold, method, label, predicted, n): how many rows of a label are predicted as what, by the models that didn't see
    their fold. Equal rows are added up before they are scored, and each distinct row is scored once for each model."""
    rows = folded.select(*keys, "fold", F.col(label).cast("int").alias(label), F.col(x).alias("_x")).groupBy(*keys, "fold", label, "_x").agg(F.count("*").alias("n"))
    n = rows.groupBy(*keys, "fold").agg(F.ceil(F.count("*") / bucket).cast("int").alias("_n"))
    dealt = rows.join(n, [*keys, "fold"]).withColumn("_b", F.pmod(F.xxhash64("_x"), F.col("_n")).cast("int")).drop("_n")
    spread = models.join(n, [*keys, "fold"]).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    schema = f"{_schema(dealt, [*keys, 'fold', label])}, method string, predicted int, n long"

    def predict(own: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        columns = [*keys, "fold", label, "method", "predicted"]
        if not len(own) or not len(fits):
            return pd.DataFrame(columns=[*columns, "n"])
        m, at = np.unique(np.stack(own["_x"].to_list()).astype(float), axis=0, return_inverse=True)
        told = pd.concat([own.drop(columns="_x").assign(method=f.method, predicted=packed_predict(f.method, f.model, m)[at.ravel()]) for f in fits.itertuples(index=False)])
        return told.groupby(columns, as_index=False, sort=False, dropna=False)["n"].sum()

    by = [*keys, "fold", "_b"]
    return dealt.groupBy(*by).cogroup(spread.groupBy(*by)).applyInPandas(predict, schema)


def decoding_sweep(rows: DataFrame, keys: list[str], label: str, id_col: str, x: str = "x", methods: tuple[str, ...] = METHODS, k: int = 5, most: int = 2000, seed: int = 0) -> DataFrame:
    """(keys, fold, method, id, label, predicted): out-of-fold predictions of every method for every key, as one keyed job.

    keys name the configuration (session, feature set, phase, field, ...). Folds are stratified in each key. The number of
    Spark jobs doesn't depend on the number of configurations.
    """
    folded = stratified_folds(rows, keys, label, id_col, k, seed)
    return keyed_predictions(folded, keyed_fits(folded, keys, label, id_col, x, methods, most, seed), keys, label, id_col, x)


def sweep_scores(predicted: DataFrame, keys: list[str], label: str, weight: str | None = None) -> DataFrame:
    """(keys, method, n, folds, mean_accuracy, sd_accuracy, chance, t, above_chance): accuracies over folds (population
    deviation), their one-sample t against chance, and whether it is over the 5 % point of the two-sided test. A row stands
    for `weight` rows."""
    own = [*keys, "method"]
    many = F.col(weight) if weight else F.lit(1).cast("long")
    right = (F.col(label) == F.col("predicted")).cast("double")
    f = predicted.groupBy(*own, "fold").agg((F.sum(right * many) / F.sum(F.when(right.isNotNull(), many))).alias("_a"), F.sum(many).alias("_n"))
    chance = predicted.groupBy(*own).agg((1 / F.count_distinct(label)).alias("chance"))
    out = f.groupBy(*own).agg(F.sum("_n").alias("n"), F.count("*").alias("folds"), F.avg("_a").alias("mean_accuracy"), F.stddev_pop("_a").alias("sd_accuracy"), F.stddev_samp("_a").alias("_s")).join(chance, own)
    t = F.when(F.col("_s") > 0, (F.col("mean_accuracy") - F.col("chance")) / (F.col("_s") / F.sqrt("folds")))
    point = F.element_at(F.array(*map(F.lit, T_95)), F.least(F.col("folds") - 1, F.lit(len(T_95))).cast("int"))
    above = F.coalesce((F.col("mean_accuracy") > F.col("chance")) & (F.col("folds") > 1) & ((t > point) | (F.col("_s") == 0)), F.lit(False))
    return out.withColumn("t", t).withColumn("above_chance", above).drop("_s")


#: Two-sided 5 % points of Student's t for 1 to 10 degrees of freedom.
T_95 = (12.7062, 4.3027, 3.1824, 2.7764, 2.5706, 2.4469, 2.3646, 2.3060, 2.2622, 2.2281)


def best_configuration(scores: DataFrame, by: list[str], config: list[str], score: str = "mean_accuracy") -> DataFrame:
    """(by, config, score, configurations, above): the configuration of the highest score for each `by`, how many there are, and
    how many are above chance. Of equal scores the first by name is taken."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), *config))
    every = Window.partitionBy(*by)
    out = scores.withColumns({"_r": rank, "configurations": F.count("*").over(every), "above": F.count_if("above_chance").over(every)})
    return out.filter("_r = 1").select(*by, *config, score, "configurations", "above")
