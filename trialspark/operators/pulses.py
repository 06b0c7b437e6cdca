"""Pulse tables: digital-input transitions to edges, clean pulses, segments and trials.

Times are integers (samples or microseconds). Every window is partitioned by the recording keys, so recordings are
independent; within one, only transitions and pulses are sorted, never raw samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators import scans
from trialspark.operators.scans import refractory  # noqa: F401
from trialspark.operators.windows import moving_average


def _by(keys: list[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order)


def concat_parts(din: DataFrame, keys: list[str], part: str = "part", seq: str = "seq", state: str = "state") -> DataFrame:
    """One log from a recording's parts: the first row of a later part goes if it repeats the state before it."""
    w = _by(keys, part, seq)
    marked = din.withColumns({"_before": F.lag(state).over(w), "_first": F.row_number().over(_by([*keys, part], seq)) == 1})
    return marked.filter(~(F.col("_first") & F.col("_before").eqNullSafe(F.col(state)) & F.col("_before").isNotNull())).drop("_before", "_first")


def edges(din: DataFrame, keys: list[str], time: str = "t", state: str = "state", order: list[str] | None = None) -> DataFrame:
    """(keys, time, edge): edge 1 where the state rises, -1 where it falls; the first row is no edge."""
    w = _by(keys, *(order or [time]))
    step = F.col(state) - F.coalesce(F.lag(state).over(w), F.col(state))
    return din.withColumn("edge", step.cast("int")).filter("edge IN (-1, 1)").select(*keys, time, "edge")


def edges_by_level(din: DataFrame, keys: list[str], time: str = "t", state: str = "state", skip_first_fall: bool = False) -> DataFrame:
    """Every row of a transition log as an edge: state 1 a rise, state 0 a fall."""
    out = din.withColumn("edge", F.when(F.col(state) == 1, 1).otherwise(-1))
    if skip_first_fall:
        out = out.withColumn("_k", F.row_number().over(_by([*keys, "edge"], time))).filter("NOT (edge = -1 AND _k = 1)")
    return out.select(*keys, time, "edge")


def anchor_zero(df: DataFrame, keys: list[str], time: str = "t") -> DataFrame:
    """Times from the first one of each recording."""
    return df.withColumn(time, F.col(time) - F.min(time).over(Window.partitionBy(*keys)))


def to_samples(seconds: Column, fs: float) -> Column:
    """Seconds to samples, halves to the even number."""
    return F.rint(seconds * F.lit(float(fs))).cast("bigint")


def pair_edges(found: DataFrame, keys: list[str], time: str = "t") -> DataFrame:
    """(keys, pulse_idx, rise, fall): the k-th rise with the k-th fall after the first rise, as far as both go; idx from 0."""
    first = F.min(F.when(F.col("edge") == 1, F.col(time))).over(Window.partitionBy(*keys))
    usable = found.withColumn("_first", first).filter((F.col("edge") == 1) | (F.col(time) > F.col("_first")))
    numbered = usable.withColumn("pulse_idx", F.row_number().over(_by([*keys, "edge"], time)) - 1)
    sides = numbered.groupBy(*keys, "pulse_idx").agg(F.max(F.when(F.col("edge") == 1, F.col(time))).alias("rise"), F.max(F.when(F.col("edge") == -1, F.col(time))).alias("fall"))
    return sides.filter("rise IS NOT NULL AND fall IS NOT NULL")


def drop_short_highs(pulses: DataFrame, least: int) -> DataFrame:
    return pulses.filter(F.col("fall") - F.col("rise") >= least)


def merge_short_lows(pulses: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Pulses with a low of under `least` between them become one; (keys, pulse_idx, rise, fall)."""
    w = _by(keys, "rise")
    fresh = F.coalesce((F.col("rise") - F.lag("fall").over(w) >= least).cast("int"), F.lit(0))
    islands = pulses.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy(*keys, "_island").agg(F.min("rise").alias("rise"), F.max("fall").alias("fall"))
    return out.select(*keys, F.col("_island").alias("pulse_idx"), "rise", "fall")


def deglitch(pulses: DataFrame, keys: list[str], min_high: int, min_low: int) -> DataFrame:
    """Short highs go, then short lows are bridged. That is stable: bridging only lengthens highs and leaves long lows."""
    return merge_short_lows(drop_short_highs(pulses, min_high), keys, min_low)


def clean_report(pulses: DataFrame, keys: list[str], min_high: int, min_low: int) -> DataFrame:
    """(keys, raw_highs, dropped_highs, merged_lows, clean_highs) of deglitch()."""
    clean = deglitch(pulses, keys, min_high, min_low).groupBy(*keys).agg(F.count("*").alias("clean_highs"))
    raw = pulses.groupBy(*keys).agg(F.count("*").alias("raw_highs"), F.count_if(F.col("fall") - F.col("rise") < min_high).alias("dropped_highs"))
    out = raw.join(clean, keys, "left").withColumn("clean_highs", F.coalesce("clean_highs", F.lit(0)))
    return out.withColumn("merged_lows", F.col("raw_highs") - F.col("dropped_highs") - F.col("clean_highs"))


def drop_manual(found: DataFrame, drops: DataFrame, keys: list[str], time: str = "t") -> DataFrame:
    """Edges without those listed in drops (keys, edge, idx), idx from 0 among a recording's rises or falls."""
    numbered = found.withColumn("idx", F.row_number().over(_by([*keys, "edge"], time)) - 1)
    return numbered.join(drops, [*keys, "edge", "idx"], "left_anti").select(*keys, time, "edge")


def synth_falls(rises: DataFrame, duration: int, rise: str = "rise") -> DataFrame:
    return rises.withColumn("fall", F.col(rise) + F.lit(duration))


def split_by_gap(df: DataFrame, keys: list[str], time: str, gap: int, order: list[str] | None = None) -> DataFrame:
    """df with segment, from 1: a new one begins where more than gap lies between neighbours."""
    w = _by(keys, *(order or [time]))
    wide = F.coalesce((F.col(time) - F.lag(time).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", wide).withColumn("segment", 1 + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def segment_table(segmented: DataFrame, keys: list[str], time: str) -> DataFrame:
    """(keys, segment, start_index, n_trials, first, last): a row for each segment of split_by_gap()."""
    numbered = segmented.withColumn("_i", F.row_number().over(_by(keys, time)) - 1)
    return numbered.groupBy(*keys, "segment").agg(F.min("_i").alias("start_index"), F.count("*").alias("n_trials"), F.min(time).alias("first"), F.max(time).alias("last"))


def slice_edges(df: DataFrame, keys: list[str], time: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Rows start (from 0) up to end, exclusive, of each recording."""
    ranked = df.withColumn("_i", F.row_number().over(_by(keys, time)) - 1)
    wanted = F.col("_i") >= start if end is None else (F.col("_i") >= start) & (F.col("_i") < end)
    return ranked.filter(wanted).drop("_i")


def last_edges(df: DataFrame, keys: list[str], time: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    return df.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= n).drop("_i")


def interval_stats(df: DataFrame, keys: list[str], time: str, gap: int, order: list[str] | None = None) -> DataFrame:
    """(keys, n, median, p25, p75, iqr, low, high, n_wide): of the steps between neighbours; n_wide: steps over gap."""
    step = df.withColumn("_d", F.col(time) - F.lag(time).over(_by(keys, *(order or [time])))).filter("_d IS NOT NULL")
    q = lambda p: F.percentile("_d", F.lit(p))
    out = step.groupBy(*keys).agg(F.count("*").alias("n"), q(0.5).alias("median"), q(0.25).alias("p25"), q(0.75).alias("p75"), F.min("_d").alias("low"), F.max("_d").alias("high"), F.count_if(F.col("_d") > gap).alias("n_wide"))
    return out.withColumn("iqr", F.col("p75") - F.col("p25"))


def off_interval(df: DataFrame, keys: list[str], time: str, tolerance: float) -> DataFrame:
    """(keys, idx, step): steps further than tolerance from their recording's median step."""
    step = df.withColumns({"idx": F.row_number().over(_by(keys, time)) - 1, "step": F.lead(time).over(_by(keys, time)) - F.col(time)}).filter("step IS NOT NULL")
    middle = step.groupBy(*keys).agg(F.median("step").alias("_m"))
    return step.join(middle, keys).filter(F.abs(F.col("step") - F.col("_m")) > tolerance).select(*keys, "idx", "step")


def matched(a: DataFrame, b: DataFrame, keys: list[str], time: str, anchor: bool = True) -> DataFrame:
    """(keys, idx, ta, tb, diff): the k-th of a with the k-th of b, as far as both go."""
    side = lambda df, name: (anchor_zero(df, keys, time) if anchor else df).select(*keys, (F.row_number().over(_by(keys, time)) - 1).alias("idx"), F.col(time).alias(name))
    return side(a, "ta").join(side(b, "tb"), [*keys, "idx"]).withColumn("diff", F.col("ta") - F.col("tb"))


def compare_edges(a: DataFrame, b: DataFrame, keys: list[str], time: str, tolerance: int, anchor: bool = True) -> DataFrame:
    """(keys, n, median, std, low, high, n_off) of matched(): std is the population's."""
    pairs = matched(a, b, keys, time, anchor)
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.median("diff").alias("median"), F.stddev_pop("diff").alias("std"), F.min("diff").alias("low"), F.max("diff").alias("high"), F.count_if(F.abs("diff") > tolerance).alias("n_off"))


def drop_bad_trials(pulses: DataFrame, least: int) -> DataFrame:
    """pulses with good: at least `least` long."""
    return pulses.withColumn("good", F.col("fall") - F.col("rise") >= least)


def align_trials(pulses: DataFrame, params: DataFrame, keys: list[str], pulse_idx: str = "pulse_idx", trial_index: str = "trial_index") -> DataFrame:
    """The k-th pulse with the k-th trial, as far as both go."""
    return pulses.withColumnRenamed(pulse_idx, trial_index).join(params, [*keys, trial_index])


def count_check(pulses: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_pulses, n_trials, same)."""
    n = pulses.groupBy(*keys).agg(F.count("*").alias("n_pulses")).join(params.groupBy(*keys).agg(F.count("*").alias("n_trials")), keys, "full")
    n = n.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_pulses", "n_trials")})
    return n.withColumn("same", F.col("n_pulses") == F.col("n_trials"))


def pulse_frequency(df: DataFrame, keys: list[str], time: str, per_second: float) -> DataFrame:
    """df with khz: the rate that the step to the pulse before amounts to."""
    step = (F.col(time) - F.lag(time).over(_by(keys, time))) / F.lit(per_second)
    return df.withColumn("khz", F.when(step > 0, 1 / step / 1000))


def find_peaks(df: DataFrame, keys: list[str], order: str, value: str, height: float | None = None, distance: int = 1, flat: bool = True) -> DataFrame:
    """Local maxima (of a flat top its middle), at least height, and no two within `distance` rows: the higher stays.

    Without `flat` a maximum is a row over both its neighbours, so a flat top is none. Maxima are found with lag and lead; only
    those that stand too near to others go to Python (scans.peaks_apart).
    """
    w = _by(keys, order)
    rows = df.select(*keys, F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"), (F.row_number().over(w) - 1).alias("_i"))
    w = _by(keys, "_i")
    if flat:
        turn = F.coalesce((F.col("_v") != F.lag("_v").over(w)).cast("int"), F.lit(0))
        runs = rows.withColumn("_new", turn).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        tops = runs.groupBy(*keys, "_run").agg(F.max("_v").alias("_v"), F.min("_i").alias("_a"), F.max("_i").alias("_b"))
    else:
        tops = rows.select(*keys, F.col("_i").alias("_run"), "_v", F.col("_i").alias("_a"), F.col("_i").alias("_b"))
    r = _by(keys, "_run")
    tops = tops.withColumns({"_l": F.lag("_v").over(r), "_r": F.lead("_v").over(r)}).filter("_v > _l AND _v > _r")
    if height is not None:
        tops = tops.filter(F.col("_v") >= height)
    found = tops.select(*keys, F.floor((F.col("_a") + F.col("_b")) / 2).alias("_i"), F.col("_v"))
    if distance > 1:
        found = scans.peaks_apart(found, keys, "_i", "_v", distance)
    return found.join(rows.select(*keys, "_i", "_o"), [*keys, "_i"]).select(*keys, F.col("_o").alias(order), F.col("_v").alias("peak"))


def find_peaks_prominent(df: DataFrame, keys: list[str], order: str, value: str, least: float, height: float | None = None, distance: int = 1) -> DataFrame:
    """find_peaks() with prominence, of which at least `least` is asked for (scans.prominences)."""
    peaks = find_peaks(df, keys, order, value, height, distance)
    w = _by(keys, order)
    rows = df.select(*keys, order, F.col(value).cast("double").alias("peak"), (F.row_number().over(w) - 1).alias("place"))
    placed = peaks.drop("peak").join(rows, [*keys, order])
    out = scans.prominences(rows, placed, keys, "place", "peak")
    return out.filter(F.col("prominence") >= least).select(*keys, order, "peak", "prominence")


def filter_peaks(peaks: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Peaks strictly between two values."""
    return peaks.filter((F.col(value) > low) & (F.col(value) < high))


def schmitt(df: DataFrame, keys: list[str], order: list[str], value: str, low: Column, high: Column, name: str = "state") -> DataFrame:
    """df with a 0/1 state: 1 since value was last over high, 0 since it was last under low; 0 before either."""
    w = _by(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    told = F.when(F.col(value) > high, 1).when(F.col(value) < low, 0)
    return df.withColumn(name, F.coalesce(F.last(told, ignorenulls=True).over(w), F.lit(0)))


def schmitt_auto(df: DataFrame, keys: list[str], order: list[str], value: str, low: float = 0.25, high: float = 0.9, name: str = "state") -> DataFrame:
    """schmitt() with thresholds at these shares of a recording's range."""
    every = Window.partitionBy(*keys)
    ranged = df.withColumns({"_min": F.min(value).over(every), "_max": F.max(value).over(every)})
    at = lambda share: F.col("_min") + (F.col("_max") - F.col("_min")) * share
    return schmitt(ranged, keys, order, value, at(low), at(high), name).drop("_min", "_max")


def schmitt_edges(df: DataFrame, keys: list[str], order: list[str], value: str, width: int = 5, low: float = 0.25, high: float = 0.9) -> DataFrame:
    """(keys, order, state): where the state of schmitt_auto() over the moving average of `width` rows turns to 1 or 0."""
    states = schmitt_auto(moving_average(df, keys, order, value, width), keys, order, "smooth", low, high)
    turned = F.col("state") != F.coalesce(F.lag("state").over(_by(keys, *order)), F.lit(0))
    return states.withColumn("_turned", turned).filter("_turned").select(*keys, *order, "state")


def attach_segment_metadata(segmented: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    """Each segment with the parameters of its number; null where there are none."""
    return segmented.join(metadata, [*keys, "segment"], "left")
