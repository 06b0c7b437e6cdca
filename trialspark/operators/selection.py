"""Filters, choices and samples of units, trials and configurations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def default_quality(units: DataFrame, default: str = "unknown", quality: str = "quality") -> DataFrame:
    return units.withColumn(quality, F.coalesce(quality, F.lit(default)))


def without_noise(units: DataFrame, quality: str = "quality") -> DataFrame:
    return units.filter(F.col(quality) != "noise")


def good_units(units: DataFrame, shank: str, unit: str, quality: str = "quality") -> DataFrame:
    """(shank, units): sorted units of quality good, mua or unsorted, in any case of letters."""
    return units.filter(F.lower(quality).isin("good", "mua", "unsorted")).groupBy(shank).agg(F.array_sort(F.collect_set(unit)).alias("units"))


def events_of(df: DataFrame, units: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """These columns of the rows whose unit is among the given ones."""
    return df.join(units.select(*keys), keys, "left_semi").select(*columns)


def with_label(df: DataFrame, label: str, wanted) -> DataFrame:
    """Rows of one label, such as the trials of one orientation."""
    return df.filter(F.col(label) == F.lit(wanted))


def class_order(df: DataFrame, keys: list[str], label: str, order: list[str], name: str = "place") -> DataFrame:
    """df with each row's place, from 0, among its keys' rows sorted by label and then in their own order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(label, *order)) - 1)


def zero_rate_report(rates: DataFrame, unit: str, rate: str) -> DataFrame:
    """(unit, n, n_zero): trials without spikes for each unit and, unit null, in all."""
    return rates.rollup(unit).agg(F.count("*").alias("n"), F.count_if(F.col(rate) == 0).alias("n_zero"))


def orientation_column(df: DataFrame, wanted: str | None, default: str = "orientation") -> Column:
    """The wanted column if there is one; else the default; else the first whose name has ori; else zeros."""
    named = [c for c in df.columns if "ori" in c.lower()]
    for c in (wanted, default, *named):
        if c and c in df.columns:
            return F.col(f"`{c}`").cast("double")
    return F.lit(0.0)


def valid_trials(features: DataFrame, trial: list[str], value: str, n_units: int, label: str | None = None) -> DataFrame:
    """Rows of trials that have a number for every one of n_units, and a label."""
    v = F.col(value)
    good = v.isNotNull() & ~F.isnan(v.cast("double"))
    whole = features.groupBy(*trial).agg(F.count_if(good).alias("_n"), F.count("*").alias("_a")).filter((F.col("_n") == n_units) & (F.col("_a") == n_units)).select(*trial)
    out = features.join(whole, trial, "left_semi")
    return out.filter(F.col(label).isNotNull()) if label else out


def pair_subset(df: DataFrame, label: str, a, b) -> DataFrame:
    """Rows of two labels, with class 0 for the first and 1 for the second."""
    return df.filter(F.col(label).isin(a, b)).withColumn("class", (F.col(label) == F.lit(b)).cast("int"))


def encoded(df: DataFrame, label: str, name: str = "class") -> DataFrame:
    """df with the rank of its label, from 0, among the distinct labels, which are few."""
    ranks = df.select(label).filter(F.col(label).isNotNull()).distinct().withColumn(name, F.row_number().over(Window.orderBy(label)) - 1)
    return df.join(ranks, label, "left")


def clamp(df: DataFrame, value: str, most: float, to_null: bool = False) -> DataFrame:
    return df.withColumn(value, F.when(F.col(value) > most, F.lit(None) if to_null else F.lit(0.0)).otherwise(F.col(value)))


def top(df: DataFrame, value: str, n: int, ties: list[str]) -> DataFrame:
    """The n rows of the largest values; ties by these columns."""
    return df.orderBy(F.col(value).desc(), *ties).limit(n)


def every_nth(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w) - 1).filter(F.col("_r") % n == 0).drop("_r")


def best_worst(results: DataFrame, keys: list[str], score: str, config: list[str]) -> DataFrame:
    """(keys, best, best_score, worst, worst_score): configurations as structs; ties to the first in their order."""
    s = F.struct(*config)
    order = lambda v: F.struct(v.alias("v"), s.alias("c"))
    out = results.groupBy(*keys).agg(F.min(order(-F.col(score))).alias("b"), F.min(order(F.col(score))).alias("w"))
    return out.select(*keys, F.col("b.c").alias("best"), (-F.col("b.v")).alias("best_score"), F.col("w.c").alias("worst"), F.col("w.v").alias("worst_score"))


def hashed_order(id_col: str, seed: int) -> Column:
    """A random order of ids that is the same wherever the rows are."""
    return F.xxhash64(F.col(id_col), F.lit(seed))


def sample_per_class(df: DataFrame, label: str, order: list, n: int | None = None, counts: dict | None = None, keys: list[str] | None = None) -> DataFrame:
    """Up to n rows of each class, or counts[label]; neither: as many as the smallest class has. The first in this order."""
    keys = keys or []
    w = Window.partitionBy(*keys, label).orderBy(*order)
    ranked = df.withColumn("_r", F.row_number().over(w))
    if counts is not None:
        most = F.coalesce(F.element_at(F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(v))]), F.col(label)), F.lit(0))
        return ranked.filter(F.col("_r") <= most).drop("_r")
    if n is not None:
        return ranked.filter(F.col("_r") <= n).drop("_r")
    least = df.groupBy(*keys, label).count().groupBy(*keys).agg(F.min("count").alias("_m")) if keys else df.groupBy(label).count().agg(F.min("count").alias("_m"))
    joined = ranked.join(least, keys) if keys else ranked.crossJoin(F.broadcast(least))
    return joined.filter("_r <= _m").drop("_r", "_m")


def train_test(df: DataFrame, label: str, order: list, n_train: int = 40, n_test: int = 20, keys: list[str] | None = None) -> DataFrame:
    """df's rows of either part, with part train or test: of each class the first n_train, then n_test in this order.

    A class that is too small for both gives half its rows to training and half to the test.
    """
    keys = keys or []
    w = Window.partitionBy(*keys, label)
    ranked = df.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    short = F.col("_n") < n_train + n_test
    a = F.when(short, F.floor(F.col("_n") / 2)).otherwise(n_train)
    b = F.when(short, F.floor(F.col("_n") / 2)).otherwise(n_test)
    part = F.when(F.col("_r") <= a, "train").when(F.col("_r") <= a + b, "test")
    return ranked.withColumn("part", part).filter("part IS NOT NULL").drop("_r", "_n")


def label_pairs(df: DataFrame, label: str) -> DataFrame:
    """(a, b) with a < b of the distinct labels."""
    d = df.select(label).filter(F.col(label).isNotNull()).distinct()
    return d.select(F.col(label).alias("a")).join(d.select(F.col(label).alias("b")), F.col("a") < F.col("b"))


def factor_levels(df: DataFrame, factors: list[str]) -> DataFrame:
    """All combinations of the factors' distinct values, whether they occur together or not."""
    return reduce(lambda x, y: x.crossJoin(y), [df.select(f).filter(F.col(f).isNotNull()).distinct() for f in factors])


def counts_by(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) with all subtotals, null where summed over."""
    return df.cube(a, b).agg(F.count("*").alias("n"))


def kept_by_threshold(metrics: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """metrics of each threshold's units, those whose value is under it, with the threshold as a model key."""
    spread = metrics.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return spread.filter(F.col(value) < F.col("threshold"))


def tuned_units(metrics: DataFrame, gosi: str, least: float, z_noise: str | None = None, most: float | None = None) -> DataFrame:
    """Units with gosi over least and, if given, z_noise under most."""
    wanted = F.col(gosi) > least
    return metrics.filter(wanted if z_noise is None or most is None else wanted & (F.col(z_noise) < most))


def position_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, sd, least, most); sd is the sample's."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))


def dataset_summary(trials: DataFrame, unit: str, factors: list[str]) -> DataFrame:
    """(n_units, n_trials, n_<factor>, least_repeats, most_repeats): one row; repeats are rows of a unit and condition."""
    n = trials.groupBy(unit, *factors).agg(F.count("*").alias("_n"))
    levels = [F.count_distinct(f).alias(f"n_{f}") for f in factors]
    return n.agg(F.count_distinct(unit).alias("n_units"), F.sum("_n").alias("n_trials"), *levels, F.min("_n").alias("least_repeats"), F.max("_n").alias("most_repeats"))


def session_statistics(responses: DataFrame, keys: list[str], unit: str, value: str) -> DataFrame:
    """(keys, n_units, mean, most): mean over units of their means, and the largest value of any."""
    u = responses.groupBy(*keys, unit).agg(F.avg(value).alias("_m"), F.max(value).alias("_x"))
    return u.groupBy(*keys).agg(F.count("*").alias("n_units"), F.avg("_m").alias("mean"), F.max("_x").alias("most"))


def parameter_orientation(trials: DataFrame, keys: list[str], params: str, field: str = "orientation", name: str = "orientation") -> DataFrame:
    """(keys, place, orientation): a field of each of an array of parameter records, by its place from 0."""
    return trials.select(*keys, F.posexplode(params).alias("place", "_p")).select(*keys, "place", F.col(f"_p.{field}").cast("double").alias(name))


def described(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, sd, least, q1, median, q3, most): of the numbers that aren't null; sd is the sample's."""
    v = F.col(value).cast("double")
    q = lambda share: F.percentile(v, F.lit(share))
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("least"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(v).alias("most"))
