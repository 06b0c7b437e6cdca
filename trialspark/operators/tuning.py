"""Tuning indices of units from their responses to conditions. Angles are in degrees, orientations repeat after 180."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repeat_idx(trials: DataFrame, keys: list[str], condition: list[str], order: list[str]) -> DataFrame:
    """trials with repeat_idx: how many earlier trials had the same condition."""
    return trials.withColumn("repeat_idx", F.row_number().over(Window.partitionBy(*keys, *condition).orderBy(*order)) - 1)


def condition_index(trials: DataFrame, keys: list[str], factor: str, name: str | None = None) -> DataFrame:
    """trials with the rank, from 0, of the factor's value among its distinct values.

    The values of a factor are few; they are ranked as a small table and joined, so that no window spans all trials.
    """
    name = name or f"{factor}_index"
    values = trials.select(*keys, factor).filter(F.col(factor).isNotNull()).distinct()
    ranked = values.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(factor)) - 1)
    return trials.join(ranked, [*keys, factor], "left")


def preferred(means: DataFrame, unit: list[str], mean: str, order: list[str]) -> DataFrame:
    """Each unit's row of the highest mean; of equal ones the first in this order."""
    w = Window.partitionBy(*unit).orderBy(F.col(mean).desc_nulls_last(), *order)
    return means.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def osi(means: DataFrame, unit: list[str], theta: str, mean: str, others: list[str] | None = None) -> DataFrame:
    """(unit, preferred theta, r_pref, r_orth, osi): (pref - orth) / (pref + orth) at the preferred other factors.

    The orthogonal orientation is half the orientations further, by rank, round the circle; 0 where the sum is not over 0.
    """
    others = others or []
    at = condition_index(means, unit, theta, "_i").withColumn("_n", F.max("_i").over(Window.partitionBy(*unit)) + 1)
    best = preferred(at, unit, mean, [theta, *others])
    best = best.select(*unit, *others, F.col(theta).alias("preferred"), F.col(mean).alias("r_pref"), F.expr("pmod(_i + _n div 2, _n)").alias("_i"))
    orth = at.select(*unit, *others, "_i", F.col(mean).alias("r_orth"))
    both = best.join(orth, [*unit, *others, "_i"], "left")
    total = F.col("r_pref") + F.col("r_orth")
    return both.select(*unit, *others, "preferred", "r_pref", "r_orth", F.when(total > 0, (F.col("r_pref") - F.col("r_orth")) / total).otherwise(F.lit(0.0)).alias("osi"))


def _vector(theta: str, mean: str) -> tuple[Column, Column, Column]:
    angle = F.radians(F.col(theta) * 2)
    return F.sum(F.col(mean) * F.cos(angle)), F.sum(F.col(mean) * F.sin(angle)), F.sum(mean)


def gosi_vector(means: DataFrame, unit: list[str], theta: str, mean: str, eps: float = 0.0) -> DataFrame:
    """(unit, gosi, preferred_vector, circular_variance): length and half the angle of the sum of R exp(2i theta), by sum R.

    gosi is 0 and circular variance 1 where sum R is not over 0. eps is added to the denominator of gosi.
    """
    x, y, total = _vector(theta, mean)
    s = means.groupBy(*unit).agg(x.alias("_x"), y.alias("_y"), total.alias("_t"))
    length = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))
    half = F.degrees(F.atan2("_y", "_x")) / 2
    good = F.col("_t") > 0
    return s.select(
        *unit,
        F.when(good, length / (F.col("_t") + eps)).otherwise(0.0).alias("gosi"),
        F.when(half < 0, half + 180).otherwise(half).alias("preferred_vector"),
        F.when(good, 1 - length / F.col("_t")).otherwise(1.0).alias("circular_variance"),
    )


def orientation_distance(a: Column, b: Column) -> Column:
    """Distance of two orientations round the half circle."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180 - d)


def gosi_pref_orth(means: DataFrame, unit: list[str], theta: str, mean: str) -> DataFrame:
    """(unit, preferred, gosi_pref_orth): preferred against the measured orientation nearest to 90 degrees from it."""
    best = preferred(means, unit, mean, [theta]).select(*unit, F.col(theta).alias("preferred"), F.col(mean).alias("_p"))
    away = means.join(best, unit).withColumn("_d", orientation_distance(F.col(theta), F.col("preferred") + 90))
    orth = away.withColumn("_r", F.row_number().over(Window.partitionBy(*unit).orderBy("_d", theta))).filter("_r = 1")
    total = F.col("_p") + F.col(mean)
    return orth.select(*unit, "preferred", F.when(total > 0, (F.col("_p") - F.col(mean)) / total).otherwise(0.0).alias("gosi_pref_orth"))


def modulation(means: DataFrame, unit: list[str], mean: str) -> DataFrame:
    """(unit, high, low, osi_max, modulation_depth): (max - min) / max and (max - min) / (max + min), 0 for no denominator."""
    s = means.groupBy(*unit).agg(F.max(mean).alias("high"), F.min(mean).alias("low"))
    span, total = F.col("high") - F.col("low"), F.col("high") + F.col("low")
    return s.select(*unit, "high", "low", F.when(F.col("high") > 0, span / F.col("high")).otherwise(0.0).alias("osi_max"), F.when(total > 0, span / total).otherwise(0.0).alias("modulation_depth"))


def sfdi(trials: DataFrame, unit: list[str], theta: str, sf: str, value: str) -> DataFrame:
    """(unit, preferred, r_max, r_min, sse, sfdi) at the orientation of the unit's best condition mean over sf.

    sfdi = (max - min) / (max + min + sse / (n - m)); m spatial frequencies, n trials, sse about each frequency's mean.
    """
    v = F.col(value)
    means = trials.groupBy(*unit, theta, sf).agg(F.count("*").alias("_n"), F.avg(v).alias("_m"), F.sum((v * v)).alias("_q"))
    best = preferred(means, unit, "_m", [theta, sf]).select(*unit, theta)
    own = means.join(best, [*unit, theta])
    sse = F.sum(F.col("_q") - F.col("_n") * F.col("_m") * F.col("_m"))
    s = own.groupBy(*unit, F.col(theta).alias("preferred")).agg(F.max("_m").alias("r_max"), F.min("_m").alias("r_min"), sse.alias("sse"), F.sum("_n").alias("_n"), F.count("*").alias("_k"))
    noise = F.when(F.col("_n") > F.col("_k"), F.col("sse") / (F.col("_n") - F.col("_k"))).otherwise(0.0)
    total = F.col("r_max") + F.col("r_min") + noise
    return s.select(*unit, "preferred", "r_max", "r_min", "sse", F.when(total > 0, (F.col("r_max") - F.col("r_min")) / total).otherwise(0.0).alias("sfdi"))


def factor_index(means: DataFrame, unit: list[str], theta: str, factor: str, mean: str) -> DataFrame:
    """(unit, preferred, index): (max - min) / (max + min) over a factor's levels at the preferred orientation."""
    best = preferred(means, unit, mean, [theta, factor]).select(*unit, theta)
    own = means.join(best, [*unit, theta]).groupBy(*unit, F.col(theta).alias("preferred")).agg(F.max(mean).alias("_a"), F.min(mean).alias("_b"))
    total = F.col("_a") + F.col("_b")
    return own.select(*unit, "preferred", F.when(total > 0, (F.col("_a") - F.col("_b")) / total).otherwise(0.0).alias("index"))


def anova(trials: DataFrame, unit: list[str], group: str, value: str) -> DataFrame:
    """(unit, k, n, ss_between, ss_within, f_stat): one-way analysis of variance over the groups of each unit."""
    v = F.col(value)
    g = trials.groupBy(*unit, group).agg(F.count(v).alias("_n"), F.sum(v).alias("_s"), F.sum(v * v).alias("_q")).filter("_n > 0")
    s = g.groupBy(*unit).agg(F.count("*").alias("k"), F.sum("_n").alias("n"), (F.sum(F.col("_s") * F.col("_s") / F.col("_n")) - F.sum("_s") * F.sum("_s") / F.sum("_n")).alias("ss_between"), F.sum(F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")).alias("ss_within"))
    fair = (F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("ss_within") > 0)
    return s.withColumn("f_stat", F.when(fair, (F.col("ss_between") / (F.col("k") - 1)) / (F.col("ss_within") / (F.col("n") - F.col("k")))))


def z_tuning(stats: DataFrame, unit: list[str], mean: str = "mean", sem: str = "sem") -> DataFrame:
    """stats with z (of the condition means within the unit) and z_noise, the mean of sem / deviation of the means."""
    every = Window.partitionBy(*unit)
    sd = F.nullif(F.stddev_pop(mean).over(every), F.lit(0.0))
    out = stats.withColumn("_sd", sd).withColumn("z", (F.col(mean) - F.avg(mean).over(every)) / F.col("_sd"))
    return out.withColumn("z_noise", F.avg(F.col(sem) / F.col("_sd")).over(every)).drop("_sd")


def _profile(t: np.ndarray, y: np.ndarray, used: np.ndarray, p: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Amplitude, baseline and squared error of each unit (row) at each of its points (preferred p, width w), in closed form.

    t, y, used: (units, means), used being 0 where a unit has fewer means; p, w: (units or 1, points).
    """
    d = np.abs(np.mod(t[:, None, :] - p[:, :, None] + 90, 180) - 90)
    g = np.exp(-(d**2) / (2 * w[:, :, None] ** 2)) * used[:, None, :]
    n, sy, syy = (x.sum(axis=1)[:, None] for x in (used, y, y * y))
    sg, sgg, sgy, top = g.sum(axis=2), (g * g).sum(axis=2), (g * y[:, None, :]).sum(axis=2), np.maximum(np.where(used > 0, y, -np.inf).max(axis=1), 0)[:, None]
    det = n * sgg - sg * sg
    a = np.clip(np.where(det > 1e-12, (n * sgy - sg * sy) / np.where(det > 1e-12, det, 1), 0), 0, top)
    b = (sy - a * sg) / n
    a = np.where(b < 0, np.clip(sgy / np.maximum(sgg, 1e-300), 0, top), a)
    b = np.maximum(b, 0)
    return a, b, np.maximum(syy - 2 * a * sgy - 2 * b * sy + a * a * sgg + 2 * a * b * sg + n * b * b, 0)


def fit_curves(t: np.ndarray, y: np.ndarray, used: np.ndarray, pref_step: float, widths: int, refine: int, rounds: int) -> np.ndarray:
    """(units, 5): preferred, width, amplitude, baseline, squared error; the best of a grid, then of finer ones about the best."""
    ratio, row = 90.0 ** (1 / (widths - 1)), np.arange(len(y))
    p, w = (x.reshape(1, -1) for x in np.meshgrid(np.arange(0, 180, pref_step), ratio ** np.arange(widths), indexing="ij"))
    k = np.arange(-refine, refine + 1)
    for level in range(rounds + 1):
        a, b, sse = _profile(t, y, used, p, w)
        at = np.round(sse, 9).argmin(axis=1)
        p, w = (np.broadcast_to(x, sse.shape)[row, at] for x in (p, w))
        best = np.stack([p, w, a[row, at], b[row, at], sse[row, at]], axis=1)
        scale = refine ** (level + 1.0)
        grid = np.meshgrid(k, k, indexing="ij")
        p = np.mod(p[:, None] + grid[0].ravel() * pref_step / scale, 180)
        w = np.clip(w[:, None] * ratio ** (grid[1].ravel() / scale), 1, 90)
    return best


def tuning_fit(means: DataFrame, unit: list[str], theta: str, mean: str, least: int = 4, pref_step: float = 5.0, widths: int = 24, refine: int = 8, rounds: int = 3) -> DataFrame:
    """(unit, n, preferred, width, amplitude, baseline, sse, r2): the circular Gaussian that fits each unit's means best.

    response = baseline + amplitude exp(-d**2 / (2 width**2)), d the orientation distance to the preferred one; amplitude
    (at most the highest mean) and baseline are not negative, and have a closed form at each preferred orientation and width
    (1 to 90). A unit's means are one row; a task searches the grid of both for a batch of units at once, then finer grids
    about each unit's best. Units with under `least` orientations have no row; null means are left out.
    """
    own = means.select(*unit, F.col(theta).cast("double").alias("_t"), F.col(mean).cast("double").alias("_y")).filter("_y IS NOT NULL")
    rows = own.groupBy(*unit).agg(F.array_sort(F.collect_list(F.struct("_t", "_y"))).alias("_m"), F.count_distinct("_t").alias("_k")).filter(F.col("_k") >= least)
    rows = rows.select(*unit, F.col("_m._t").alias("_t"), F.col("_m._y").alias("_y"))
    names = [*unit, "n", "preferred", "width", "amplitude", "baseline", "sse", "r2"]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 200):
                some = pdf.iloc[lo : lo + 200]
                size = some["_t"].map(len).to_numpy()
                t, y, used = (np.zeros((len(some), size.max())) for _ in range(3))
                for k, (at, values) in enumerate(zip(some["_t"], some["_y"], strict=True)):
                    t[k, : size[k]], y[k, : size[k]], used[k, : size[k]] = at, values, 1
                best = fit_curves(t, y, used, pref_step, widths, refine, rounds)
                total = (y * y).sum(axis=1) - y.sum(axis=1) ** 2 / size
                r2 = np.where(total > 0, 1 - best[:, 4] / np.where(total > 0, total, 1), np.nan)
                out = dict(zip(names[len(unit) + 1 :], [*best.T, r2], strict=True))
                yield some[unit].assign(n=size.astype(np.int64), **out)[names]

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in unit)
    found = rows.mapInPandas(fit, f"{kinds}, n long, preferred double, width double, amplitude double, baseline double, sse double, r2 double")
    return found.withColumn("r2", F.nanvl("r2", F.lit(None).cast("double")))


def tuning_curve(fits: DataFrame, points: int = 181) -> DataFrame:
    """fits with theta and response: the fitted curve at 0, 1, ... degrees."""
    at = fits.withColumn("theta", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("theta", F.col("theta").cast("double"))
    d = orientation_distance(F.col("theta"), F.col("preferred"))
    return at.withColumn("response", F.col("baseline") + F.col("amplitude") * F.exp(-d * d / (2 * F.col("width") * F.col("width"))))


def spike_triggered_average(hits: DataFrame, frames: DataFrame, unit: list[str], frame: str, pixel: str, pixels: int) -> DataFrame:
    """(unit, pixel, n_spikes, white, black): mean over a unit's spikes of the frame before each, a single white pixel.

    hits carry the frame they fall on, frames name its pixel. Every pixel has a row. black is the mean of the inverse.
    """
    seen = hits.join(frames.select(frame, pixel), frame)
    n = seen.groupBy(*unit).agg(F.count("*").alias("n_spikes"))
    per = seen.groupBy(*unit, pixel).agg(F.count("*").alias("_n"))
    grid = n.select(*unit, "n_spikes", F.explode(F.sequence(F.lit(0), F.lit(pixels - 1))).alias(pixel)).withColumn(pixel, F.col(pixel).cast(frames.schema[pixel].dataType))
    share = F.coalesce("_n", F.lit(0)) / F.col("n_spikes")
    return grid.join(per, [*unit, pixel], "left").select(*unit, pixel, "n_spikes", share.alias("white"), (1 - share).alias("black"))


def response_map(hits: DataFrame, dots: DataFrame, unit: list[str], dot: str, polarity: str, shown: str, per_second: float, length: int) -> DataFrame:
    """(unit, dot, white, black, difference): mean rate after each dot of a polarity.

    dots: a row for each time a dot is shown (shown identifies it); hits carry `shown`. Times without hits count as 0.
    """
    n = hits.groupBy(*unit, shown).agg(F.count("*").alias("_n"))
    seen = n.join(dots, shown).groupBy(*unit, dot, polarity).agg(F.sum("_n").alias("_n"))
    times = dots.groupBy(dot, polarity).agg(F.count("*").alias("_t"))
    grid = hits.select(*unit).distinct().crossJoin(F.broadcast(times))
    rate = F.coalesce("_n", F.lit(0)) / F.col("_t") / F.lit(length / per_second)
    rates = grid.join(seen, [*unit, dot, polarity], "left").select(*unit, dot, polarity, rate.alias("_r"))
    both = rates.groupBy(*unit, dot).agg(F.max(F.when(F.col(polarity) == "white", F.col("_r"))).alias("white"), F.max(F.when(F.col(polarity) == "black", F.col("_r"))).alias("black"))
    return both.withColumn("difference", F.col("white") - F.col("black"))


def population_summary(metrics: DataFrame, preferred_col: str, gosi_col: str, tuned_col: str) -> DataFrame:
    """(n_units, median_gosi, median_preferred, tuned_share) of all units."""
    return metrics.agg(F.count("*").alias("n_units"), F.median(gosi_col).alias("median_gosi"), F.median(preferred_col).alias("median_preferred"), F.avg(F.col(tuned_col).cast("double")).alias("tuned_share"))
