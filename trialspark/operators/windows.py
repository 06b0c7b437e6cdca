"""Window operators: smoothing kernels, z-scores, block means and ranks, as Spark window expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def _shifts(value: str, w, reach: int) -> tuple[dict[str, Column], Callable[[int], Column]]:
    """Columns with the value of each row up to `reach` before and after, and the column of a shift. However often an
    expression speaks of a shift, the window makes it once."""
    name = lambda k: f"_x{k}" if k >= 0 else f"_y{-k}"
    return {name(k): F.lag(value, -k).over(w) for k in range(-reach, reach + 1)}, lambda k: F.col(name(k))


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, width: int, name: str = "smooth") -> DataFrame:
    """Mean over `width` rows around each, rows beyond the ends counting as 0: 4 is two before to one after."""
    w = _over(keys, order).rowsBetween(-(width // 2), (width + 1) // 2 - 1)
    return df.withColumn(name, F.sum(value).over(w) / F.lit(float(width)))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    half = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    return w / w.sum()


def kernel_smooth(df: DataFrame, keys: list[str], at: str, value: str, weights: np.ndarray, name: str = "smooth") -> DataFrame:
    """df with the weighted mean of its neighbours, mirrored at the ends (a b | b a); `at` numbers a group's rows from 0.

    A row's neighbours come from one sorted window, each shift once; mirrored ones are among them. Rows that have all their
    neighbours are a plain sum. A null value counts as 0.
    """
    half, n = len(weights) // 2, F.col("_n")
    shifts, shifted = _shifts(value, Window.partitionBy(*keys).orderBy(at), half)
    sized = df.withColumns({"_n": F.count("*").over(Window.partitionBy(*keys)), **shifts})
    near = F.array(*[shifted(k) for k in range(-half, half + 1)])
    taps = F.array(*[F.struct(F.lit(k - half).alias("k"), F.lit(float(w)).alias("w")) for k, w in enumerate(weights)])

    def term(tap: Column) -> Column:
        turned = F.pmod(F.col(at) + tap["k"], 2 * n)
        place = F.when(turned < n, turned).otherwise(2 * n - 1 - turned) - F.col(at) + half
        return tap["w"] * F.coalesce(F.get(near, place.cast("int")).cast("double"), F.lit(0.0))

    inside = sum((F.lit(float(w)) * F.coalesce(shifted(k - half).cast("double"), F.lit(0.0)) for k, w in enumerate(weights)), F.lit(0.0))
    at_ends = F.aggregate(F.transform(taps, term), F.lit(0.0), lambda t, x: t + x)
    return sized.withColumn(name, F.when((F.col(at) >= half) & (F.col(at) < n - half), inside).otherwise(at_ends)).drop("_n", *shifts)


def gaussian_smooth(df: DataFrame, keys: list[str], at: str, value: str, sigma: float, name: str = "smooth") -> DataFrame:
    """kernel_smooth() by a Gaussian cut at four deviations."""
    return kernel_smooth(df, keys, at, value, gaussian_weights(sigma), name)


def savgol_weights(width: int, order: int, derivative: int = 0, at: int | None = None) -> np.ndarray:
    """Least-squares weights of a polynomial over `width` rows, for its value (or derivative) at place `at`, the middle."""
    at = width // 2 if at is None else at
    powers = np.vander(np.arange(width) - at, order + 1, increasing=True)
    return np.linalg.pinv(powers)[derivative] * float(np.prod(np.arange(1, derivative + 1)) if derivative else 1)


def savgol(df: DataFrame, keys: list[str], order: list[str], value: str, width: int = 11, degree: int = 3, derivative: int = 0, step: float = 1.0, name: str = "smooth") -> DataFrame:
    """Savitzky-Golay filter; within half a width of an end, the polynomial of the first or last rows. Shorter groups stay.

    An even width is made odd. Weights are literals, neighbours come from lag and lead, each once: no row leaves its window.
    """
    width += (width + 1) % 2
    half, scale = width // 2, step**derivative
    w = _over(keys, order)
    shifts, shifted = _shifts(value, w, width - 1)
    numbered = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*keys)), **shifts})

    def fit(weights: np.ndarray, first: int):
        return sum((F.lit(float(x)) * shifted(first + k) for k, x in enumerate(weights)), F.lit(0.0)) / F.lit(scale)

    out = F.when(F.col("_n") < width, F.col(value).cast("double"))
    for k in range(half):
        out = out.when(F.col("_i") == k, fit(savgol_weights(width, degree, derivative, k), -k))
        out = out.when(F.col("_i") == F.col("_n") - 1 - k, fit(savgol_weights(width, degree, derivative, width - 1 - k), -(width - 1 - k)))
    return numbered.withColumn(name, out.otherwise(fit(savgol_weights(width, degree, derivative), -half))).drop("_i", "_n", *shifts)


def median_filter(df: DataFrame, keys: list[str], order: list[str], value: str, width: int = 5, name: str = "smooth") -> DataFrame:
    """Median over `width` rows around each, mirrored at the ends."""
    half = width // 2
    w = _over(keys, order)
    shifts, shifted = _shifts(value, w, half)
    numbered = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*keys)), **shifts})
    taps = []
    for k in range(-half, half + 1):
        place = F.col("_i") + k
        mirrored = [F.when(F.col("_i") == i, shifted(-(i + k) - 1 - i)) for i in range(max(0, -k))] if k < 0 else []
        tail = [F.when(F.col("_n") - 1 - F.col("_i") == i, shifted(i - (k - i) + 1)) for i in range(k)] if k > 0 else []
        straight = F.when((place >= 0) & (place < F.col("_n")), shifted(k))
        taps.append(F.coalesce(straight, *mirrored, *tail))
    ordered = F.array_sort(F.array(*taps))
    return numbered.withColumn(name, F.element_at(ordered, half + 1)).drop("_i", "_n", *shifts)


def block_average(df: DataFrame, keys: list[str], order: list[str], value: str, block: int) -> DataFrame:
    """(keys, block, mean): means of each `block` rows, the last of what is left."""
    numbered = df.withColumn("block", F.floor((F.row_number().over(_over(keys, order)) - 1) / block).cast("int"))
    return numbered.groupBy(*keys, "block").agg(F.avg(value).alias("mean"))


def z_score(df: DataFrame, keys: list[str], value: str, name: str = "z", eps: float = 1e-10) -> DataFrame:
    """(value - mean) / (population deviation + eps) within the keys."""
    w = Window.partitionBy(*keys)
    return df.withColumn(name, (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + eps))


def depth_rank(channels: DataFrame, keys: list[str], depth: str, channel: str, name: str = "depth_rank") -> DataFrame:
    """channels with their rank from 0 by depth, then channel."""
    return channels.withColumn(name, F.row_number().over(_over(keys, [depth, channel])) - 1)


def depth_offsets(samples: DataFrame, channels: DataFrame, channel: str, value: str, rank: str = "depth_rank", step: float = 15.0, recording: tuple[str, ...] = ()) -> DataFrame:
    """channels with offset = -rank * step * the median, over the channels of a recording, of their deviations."""
    sd = samples.groupBy(*recording, channel).agg(F.stddev_pop(value).alias("_sd")).groupBy(*recording).agg(F.median("_sd").alias("_m"))
    joined = channels.join(sd, list(recording)) if recording else channels.crossJoin(F.broadcast(sd))
    return joined.withColumn("offset", -F.col(rank) * step * F.col("_m")).drop("_m")


def frequency_bins(df: DataFrame, keys: list[str], freq: str, value: str, first: float, width: float, bins: int) -> DataFrame:
    """(keys, fbin, freq, value): means within bins of `width` from `first`; empty bins have no row, nor what lies beyond."""
    at = F.floor((F.col(freq) - first) / width).cast("int")
    return df.withColumn("fbin", at).filter((F.col("fbin") >= 0) & (F.col("fbin") < bins)).groupBy(*keys, "fbin").agg(F.avg(freq).alias("freq"), F.avg(value).alias("value"))


def display_limits(df: DataFrame, keys: list[str], value: str, k: float = 3.0, extend: float = 0.2) -> DataFrame:
    """(keys, middle, mad, low, high): median +- k median absolute deviations, each side further by a share of the span."""
    m = df.groupBy(*keys).agg(F.median(value).alias("middle"))
    joined = df.join(m, keys) if keys else df.crossJoin(F.broadcast(m))
    d = joined.groupBy(*keys, "middle").agg(F.median(F.abs(F.col(value) - F.col("middle"))).alias("mad"))
    reach = F.col("mad") * k * (1 + 2 * extend)
    return d.withColumns({"low": F.col("middle") - reach, "high": F.col("middle") + reach})


def percentile_limits(df: DataFrame, keys: list[str], value: str, low: float = 1.0, high: float = 99.0, extend: float = 0.2) -> DataFrame:
    """(keys, low, high): exact percentiles, each side further by a share of the span."""
    p = df.groupBy(*keys).agg(F.percentile(value, low / 100).alias("_a"), F.percentile(value, high / 100).alias("_b"))
    span = (F.col("_b") - F.col("_a")) * extend
    return p.select(*keys, (F.col("_a") - span).alias("low"), (F.col("_b") + span).alias("high"))
