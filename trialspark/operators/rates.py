"""Counts, rates and histograms around trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.intervals import interval_join
from trialspark.operators.scans import ranked, totals


def bin_number(x: Column, first: float, width: float, bins: int) -> Column:
    """Which bin x falls in, or null: bins are [edge, next edge), the last one closed."""
    at = F.floor((x - F.lit(first)) / F.lit(width)).cast("int")
    end = F.lit(first) + F.lit(width) * F.lit(bins)
    return F.when(x == end, F.lit(bins - 1)).when((at >= 0) & (at < bins), at)


def histogram(df: DataFrame, keys: list[str], x: str, first: float, width: float, bins: int, groups: DataFrame | None = None) -> DataFrame:
    """(keys, bin, n) for every bin of every group, empty ones too; groups: (keys) that count even without rows."""
    n = df.withColumn("bin", bin_number(F.col(x), first, width, bins)).filter("bin IS NOT NULL").groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    every = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    if keys:
        grid = (groups if groups is not None else df.select(*keys).distinct()).select(*keys, every)
    else:
        grid = df.sparkSession.range(1).select(every)
    return grid.join(n, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def windowed_rate(trains: DataFrame, times: str, start: float, end: float, closed: str = "left", name: str = "rate") -> DataFrame:
    """trains with the rate of its array of times in [start, end) or, closed both, [start, end]."""
    upper = (lambda s: s <= end) if closed == "both" else (lambda s: s < end)
    return trains.withColumn(name, F.size(F.filter(times, lambda s: (s >= start) & upper(s))) / F.lit(float(end - start)))


def mean_rate(hits: DataFrame, trials: DataFrame, keys: list[str], on: str, off: str, per_second: float, name: str = "rate") -> DataFrame:
    """(keys, rate): hits of each trial by the trial's length; 0 where it has none or no length."""
    n = hits.groupBy(*keys).agg(F.count("*").alias("_n"))
    length = (F.col(off) - F.col(on)) / F.lit(per_second)
    return trials.join(n, keys, "left").select(*trials.columns, F.when(length > 0, F.coalesce("_n", F.lit(0)) / length).otherwise(F.lit(0.0)).alias(name))


def pre_post(trains: DataFrame, times: str, before: float, after: float) -> DataFrame:
    """trains with counts and rates of times before 0 and from 0 on, by the windows' lengths."""
    pre, post = F.filter(times, lambda s: s < 0), F.filter(times, lambda s: s >= 0)
    return trains.withColumns({"pre_count": F.size(pre), "post_count": F.size(post), "pre_rate": F.size(pre) / F.lit(float(before)), "post_rate": F.size(post) / F.lit(float(after))})


def blank_rate(spikes: DataFrame, trials: DataFrame, keys: list[str], unit: str, time: str, on: str, length: int, per_second: float) -> DataFrame:
    """(keys, unit, blank_rate): the rate in the stretch of `length` before the first onset."""
    first = trials.groupBy(*keys).agg(F.min(on).alias("_on"))
    hit = (F.col(time) >= F.col("_on") - length) & (F.col(time) < F.col("_on"))
    joined = spikes.join(first, keys) if keys else spikes.crossJoin(first)
    return joined.groupBy(*keys, unit).agg((F.count_if(hit) / F.lit(length / per_second)).alias("blank_rate"))


def psth(hits: DataFrame, trials: DataFrame, condition: list[str], rel: str, first: int, width: int, bins: int, per_second: float, unit: list[str] | None = None) -> DataFrame:
    """(unit, condition, bin, n, n_trials, rate): rate of hits in bins of time from onset.

    rel is the time from onset in integer units. n_trials counts all trials of a condition, those without hits too.
    """
    unit = unit or []
    n_trials = trials.groupBy(*condition).agg(F.count("*").alias("n_trials"))
    n = histogram(hits, [*unit, *condition], rel, first, width, bins)
    out = n.join(n_trials, condition) if condition else n.crossJoin(F.broadcast(n_trials))
    return out.withColumn("rate", F.col("n") / (F.col("n_trials") * F.lit(width / per_second)))


def psth_modes(hits: DataFrame, trials: DataFrame, factors: list[str], rel: str, first: int, width: int, bins: int, per_second: float) -> DataFrame:
    """psth() for every subset of the factors at once; a factor that a row is summed over is null, grouping tells which."""
    counts = hits.withColumn("bin", bin_number(F.col(rel), first, width, bins)).filter("bin IS NOT NULL")
    n = counts.cube(*factors, "bin").agg(F.count("*").alias("n"), F.grouping_id().alias("_g")).filter("bin IS NOT NULL")
    n = n.withColumn("grouping", F.shiftright("_g", 1)).drop("_g")
    t = trials.cube(*factors).agg(F.count("*").alias("n_trials"), F.grouping_id().alias("grouping"))
    t = t.withColumnsRenamed({c: f"_{c}" for c in factors})
    out = n.join(t.withColumnRenamed("grouping", "_grouping"), (F.col("grouping") == F.col("_grouping")) & _all_same(factors))
    return out.select(*factors, "grouping", "bin", "n", "n_trials", (F.col("n") / (F.col("n_trials") * F.lit(width / per_second))).alias("rate"))


def _all_same(factors: list[str]) -> Column:
    same = F.lit(True)
    for c in factors:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return same


def raster(hits: DataFrame, trials: DataFrame, keys: list[str], condition: list[str], order: str, rel: str) -> DataFrame:
    """(keys, condition, trial, y, rel): hits on rows of trials, which are numbered by condition and then in order, less 0.5."""
    w = Window.partitionBy(*keys).orderBy(*condition, order)
    rows = trials.select(*keys, *condition, order, (F.row_number().over(w) - F.lit(0.5)).alias("y"))
    return hits.select(*keys, order, rel).join(rows, [*keys, order])


def mua_rate(spikes: DataFrame, keys: list[str], time: str, start: int, end: int, width: int, per_second: float) -> DataFrame:
    """(keys, bin, t, n, rate): all spikes in whole bins from start; a last, shorter bin is left out. t is a bin's middle."""
    bins = (end - start) // width
    inside = spikes.filter((F.col(time) >= start) & (F.col(time) < start + bins * width))
    n = histogram(inside, keys, time, start, width, bins)
    return n.withColumns({"t": F.lit(start) + F.col("bin") * width + F.lit(width / 2), "rate": F.col("n") / F.lit(width / per_second)})


def up_states(rates: DataFrame, keys: list[str], bin_col: str = "bin", rate: str = "rate", k: float = 0.5) -> DataFrame:
    """(keys, first, last, bins, peak): runs of bins whose rate is over mean + k population deviations."""
    marked = totals(rates, keys, _m=F.avg(rate), _s=F.stddev_pop(rate)).filter(F.col(rate) > F.col("_m") + k * F.col("_s"))
    ups = ranked(marked, keys, [bin_col], "_r").withColumn("_run", F.col(bin_col) - F.col("_r"))
    return ups.groupBy(*keys, "_run").agg(F.min(bin_col).alias("first"), F.max(bin_col).alias("last"), F.count("*").alias("bins"), F.max(rate).alias("peak")).drop("_run")


def window_units(spikes: DataFrame, unit: str, time: str, start: int, width: int) -> DataFrame:
    """(win, unit, n, times): for each stretch of time the units that fire in it."""
    win = F.floor((F.col(time) - start) / width).cast("int")
    return spikes.filter(F.col(time) >= start).groupBy(win.alias("win"), unit).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(time)).alias("times"))


def temporal_features(hits: DataFrame, trials: DataFrame, keys: list[str], rel: str, duration: int, bins: int = 20, per_second: float = 1.0) -> DataFrame:
    """trials with counts, rates, first_latency, last_time, time_var, total, mean_rate, and derived columns.

    Bins are equal parts of the duration. A trial without hits has latency = duration, last 0 and variance 0. Times are in
    seconds. early and late are the mean rates of the first and the last third (of 20 bins: 6 and 7); peak_bin counts from 0.
    """
    sec = F.col(rel) / F.lit(per_second)
    at = bin_number(F.col(rel), 0, duration / bins, bins)
    per_bin = hits.withColumn("_b", at).filter("_b IS NOT NULL").groupBy(*keys, "_b").agg(F.count("*").alias("_n"), F.min(sec).alias("_f"), F.max(sec).alias("_l"), F.sum(sec).alias("_s"), F.sum(sec * sec).alias("_q"))
    per_trial = per_bin.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_b", "_n"))).alias("_m"), F.sum("_n").alias("total"), F.min("_f").alias("_f"), F.max("_l").alias("_l"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.element_at("_m", k), F.lit(0)).cast("double"))
    long, part = duration / per_second, duration / bins / per_second
    out = trials.join(per_trial, keys, "left")
    out = out.withColumns({"binned_counts": F.when(F.col("_m").isNull(), F.array_repeat(F.lit(0.0), bins)).otherwise(filled), "total": F.coalesce("total", F.lit(0))})
    rates = F.transform("binned_counts", lambda n: n / F.lit(part))
    spread = F.col("_q") / F.col("total") - (F.col("_s") / F.col("total")) * (F.col("_s") / F.col("total"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    early, late = bins // 3, -(-bins // 3)
    return out.select(
        *trials.columns,
        "binned_counts",
        rates.alias("binned_rates"),
        F.coalesce("_f", F.lit(long)).alias("first_latency"),
        F.coalesce("_l", F.lit(0.0)).alias("last_time"),
        F.when(F.col("total") > 0, F.greatest(spread, F.lit(0.0))).otherwise(0.0).alias("time_var"),
        "total",
        (F.col("total") / F.lit(long)).alias("mean_rate"),
        ((F.array_position("binned_counts", F.array_max("binned_counts")) - 1) / F.lit(float(bins))).alias("peak_share"),
        (F.array_max(rates) - F.array_min(rates)).alias("rate_range"),
        (mean(F.slice(rates, bins - late + 1, late)) - mean(F.slice(rates, 1, early))).alias("late_minus_early"),
    )


def feature_sets(features: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of temporal_features -> (keys, feature_set, feature, value), one row for each feature of each set.

    The sets are binned_rates (the bins), spike_timing (first, last, variance, total), combined (both) and all (the
    derived features as well). No row is shuffled: a trial's features are exploded where it lies.
    """
    named = lambda sets, names: [(F.array(*map(F.lit, sets)), F.lit(n), F.col(n).cast("double")) for n in names]
    scalars = named(["spike_timing", "combined", "all"], ["first_latency", "last_time", "time_var", "total"])
    scalars += named(["all"], ["peak_share", "rate_range", "late_minus_early"])
    row = lambda sets, name, value: F.struct(sets.alias("sets"), name.alias("feature"), value.alias("value"))
    in_bins = F.array(*map(F.lit, ["binned_rates", "combined", "all"]))
    bins = F.transform("binned_rates", lambda x, k: row(in_bins, F.concat(F.lit("bin_"), k.cast("string")), x))
    each = features.select(*keys, F.explode(F.concat(bins, F.array(*[row(*x) for x in scalars]))).alias("_f"))
    return each.select(*keys, F.explode("_f.sets").alias("feature_set"), "_f.feature", "_f.value")


def feature_vectors(features: DataFrame, keys: list[str], bins: int = 20) -> DataFrame:
    """Rows of temporal_features -> (keys, feature_set, x): each set of feature_sets() as an array in the order of its features'
    names, made where the row lies."""
    names = {"binned_rates": [f"bin_{k}" for k in range(bins)], "spike_timing": ["first_latency", "last_time", "time_var", "total"]}
    names["combined"] = names["binned_rates"] + names["spike_timing"]
    names["all"] = [*names["combined"], "peak_share", "rate_range", "late_minus_early"]
    value = lambda name: F.col("binned_rates")[int(name[4:])] if name.startswith("bin_") else F.col(name)
    sets = [F.struct(F.lit(s).alias("feature_set"), F.array(*[value(n).cast("double") for n in sorted(own)]).alias("x")) for s, own in names.items()]
    return features.select(*keys, F.explode(F.array(*sets)).alias("_f")).select(*keys, "_f.*")



def dense_curve(responses: DataFrame, keys: list[str], at: str, places: list[float], value: str) -> DataFrame:
    """(keys, at, n, mean): each key's mean at each of these places, 0 where it has none there."""
    found = responses.filter(F.col(at).isin(*places)).groupBy(*keys, at).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    packed = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(at).cast("double").alias("k"), F.struct("n", "mean")))).alias("_m"))
    rows = packed.withColumn(at, F.explode(F.array(*[F.lit(float(p)) for p in places])))
    cell = F.try_element_at("_m", F.col(at))
    return rows.select(*keys, at, F.coalesce(cell["n"], F.lit(0)).alias("n"), F.coalesce(cell["mean"], F.lit(0.0)).alias("mean"))


def inter_event(hits: DataFrame, keys: list[str], time: str) -> DataFrame:
    """hits with the step from the event before in the same trial; the first ones go."""
    w = Window.partitionBy(*keys).orderBy(time)
    return hits.withColumn("isi", F.col(time) - F.lag(time).over(w)).filter("isi IS NOT NULL")


def condition_stats(responses: DataFrame, keys: list[str], value: str, ddof: int = 0) -> DataFrame:
    """(keys, n, mean, sd, sem): of each condition, with the population's (ddof 0) or the sample's deviation."""
    sd = (F.stddev_pop if ddof == 0 else F.stddev_samp)(value)
    return responses.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("sd")).withColumn("sem", F.col("sd") / F.sqrt("n"))


def response_rate(spikes: DataFrame, trials: DataFrame, keys: list[str], unit: str, trial: str, time: str, on: str, delay: int, length: int, per_second: float) -> DataFrame:
    """(keys, unit, trial, rate) of each trial with hits: the rate in [on + delay, on + delay + length)."""
    w = trials.withColumns({"low": F.col(on) + delay, "high": F.col(on) + delay + length})
    hit = interval_join(spikes, w, keys, time, "low", "high", max(1, length))
    return hit.groupBy(*keys, unit, trial).agg((F.count("*") / F.lit(length / per_second)).alias("rate"))
