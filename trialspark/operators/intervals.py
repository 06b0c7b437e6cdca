"""Joins in time: bucketed interval joins, as-of lookups, interpolation, clock maps and dense grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(events: DataFrame, windows: DataFrame, keys: list[str], time: str, low: str, high: str, bucket: int, closed: str = "left") -> DataFrame:
    """Events of the same keys within [low, high) (closed left), [low, high] (both) or (low, high) (neither).

    Times are integers. Both sides carry the number of a time bucket: an event is in one, a window in each that it meets.
    So the join is an equi-join whose keys spread even a single recording, and an event meets a window once. Choose the
    bucket about as wide as a window.
    """
    number = lambda c: F.floor(F.col(c) / F.lit(bucket)).cast("bigint")
    spread = windows.filter(F.col(high) >= F.col(low)).withColumn("_bucket", F.explode(F.sequence(number(low), number(high))))
    inside = {
        "left": (F.col(time) >= F.col(low)) & (F.col(time) < F.col(high)),
        "both": (F.col(time) >= F.col(low)) & (F.col(time) <= F.col(high)),
        "neither": (F.col(time) > F.col(low)) & (F.col(time) < F.col(high)),
    }[closed]
    return events.withColumn("_bucket", number(time)).join(spread, [*keys, "_bucket"]).filter(inside).drop("_bucket")


def trial_windows(trials: DataFrame, on: str = "on", before: int = 0, after: int = 0) -> DataFrame:
    """trials with low and high: [on - before, on + after)."""
    return trials.withColumns({"low": F.col(on) - before, "high": F.col(on) + after})


def phase_windows(pulses: DataFrame, keys: list[str], delay: int, baseline: int, iti: int) -> DataFrame:
    """pulses times three rows (phase, low, high): display [rise + delay, fall), baseline [rise - baseline, rise) and
    iti [fall, min(fall + iti, next rise))."""
    after = F.lead("rise").over(Window.partitionBy(*keys).orderBy("rise"))
    end = F.least(F.col("fall") + iti, F.coalesce(F.col("_next"), F.col("fall") + iti))
    rows = [("display", F.col("rise") + delay, F.col("fall")), ("baseline", F.col("rise") - baseline, F.col("rise")), ("iti", F.col("fall"), end)]
    return pulses.withColumn("_next", after).select(*pulses.columns, F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), a.alias("low"), b.alias("high")) for p, a, b in rows])).alias("_w")).select(*pulses.columns, "_w.*")


def dense_counts(units: DataFrame, trials: DataFrame, hits: DataFrame, session: list[str], unit: str, trial: str, name: str = "n") -> DataFrame:
    """A row for each unit and trial of a session, with the number of hits (0 where there are none) and the trial's columns."""
    n = hits.groupBy(*session, unit, trial).agg(F.count("*").alias(name))
    grid = units.select(*session, unit).distinct().join(trials, session) if session else units.select(unit).distinct().crossJoin(trials)
    return grid.join(n, [*session, unit, trial], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def asof(events: DataFrame, edges: DataFrame, keys: list[str], time: str, edge: str, payload: list[str]) -> DataFrame:
    """events with the payload of the last edge at or before them, null before the first one.

    Edges and events of a key are merged in time order and the last edge's payload is carried on; no pairs are formed.
    """
    e = edges.select(*keys, F.col(edge).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(edge).alias("_edge"), *payload).alias("_p"), F.lit(None).cast(events.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_row"))
    v = events.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(e.schema["_p"].dataType).alias("_p"), F.struct(*[F.col(c) for c in events.columns]).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    merged = e.unionByName(v).withColumn("_p", F.last("_p", ignorenulls=True).over(w)).filter("_side = 1")
    return merged.select("_row.*", F.col("_p._edge").alias("asof_edge"), *[F.col(f"_p.{c}").alias(c) for c in payload])


def interval_index(edges: DataFrame, keys: list[str], edge: str, last_for: int) -> DataFrame:
    """edges with idx from 0 and high, the next edge; the last one ends `last_for` after it."""
    w = Window.partitionBy(*keys).orderBy(edge)
    return edges.withColumns({"idx": F.row_number().over(w) - 1, "high": F.coalesce(F.lead(edge).over(w), F.col(edge) + last_for)})


def _backwards(keys: list[str]):
    """From the last row to the first: what comes after a row is then carried along, where a frame that reaches forward to
    the end would be gone through again for each row."""
    return Window.partitionBy(*keys).orderBy(F.col("_t").desc(), F.col("_side").desc())


def interpolated(grid: DataFrame, knots: DataFrame, keys: list[str], at: str, t: str, value: str, name: str = "value_at") -> DataFrame:
    """grid with the value on the line between the knots on either side; beyond the ends, that of the end knot."""
    k = knots.select(*keys, F.col(t).alias("_t"), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_side"), F.lit(None).cast(grid.schema[at].dataType).alias(at))
    g = grid.select(*keys, F.col(at).alias("_t"), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_side"), at)
    order = Window.partitionBy(*keys).orderBy("_t", "_side")
    knot = F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))
    both = k.unionByName(g).withColumns(
        {
            "_a": F.last(knot, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "_b": F.last(knot, ignorenulls=True).over(_backwards(keys).rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    share = (F.col("_t") - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    line = F.when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull() | (F.col("_t") == F.col("_a.t")), F.col("_a.v")).otherwise(F.col("_a.v") + share * (F.col("_b.v") - F.col("_a.v")))
    return both.filter("_side = 1").select(*keys, at, line.alias(name))


def nearest(grid: DataFrame, events: DataFrame, keys: list[str], at: str, time: str, payload: list[str]) -> DataFrame:
    """grid with the payload of the event nearest in time; of two as near, the earlier."""
    p = F.struct(F.col(time).alias("_e"), *payload)
    e = events.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), p.alias("_p"), F.lit(None).cast(grid.schema[at].dataType).alias(at))
    g = grid.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(e.schema["_p"].dataType).alias("_p"), at)
    order = Window.partitionBy(*keys).orderBy("_t", "_side")
    both = e.unionByName(g).withColumns({"_a": F.last("_p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.last("_p", ignorenulls=True).over(_backwards(keys).rowsBetween(Window.unboundedPreceding, -1))})
    take_a = F.col("_b").isNull() | (F.col("_t") - F.col("_a._e") <= F.col("_b._e") - F.col("_t"))
    chosen = both.filter("_side = 1").withColumn("_p", F.when(F.col("_a").isNull(), F.col("_b")).when(take_a, F.col("_a")).otherwise(F.col("_b")))
    return chosen.select(*keys, at, F.col("_p._e").alias("nearest"), *[F.col(f"_p.{c}").alias(c) for c in payload])


def clock_map(sync: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a0, a1, b0, b1): first and last pulse of two clocks that a recording shares (t_a, t_b)."""
    return sync.groupBy(*keys).agg(F.min("t_a").alias("a0"), F.max("t_a").alias("a1"), F.min("t_b").alias("b0"), F.max("t_b").alias("b1"))


def remapped(df: DataFrame, clocks: DataFrame, keys: list[str], time: str, name: str = "t_mapped") -> DataFrame:
    """df within the range of the first clock, with its times on the second."""
    line = F.col("b0") + (F.col(time) - F.col("a0")) * (F.col("b1") - F.col("b0")) / (F.col("a1") - F.col("a0"))
    return df.join(clocks, keys).filter(F.col(time).between(F.col("a0"), F.col("a1"))).withColumn(name, line).drop("a0", "a1", "b0", "b1")


def in_all(df: DataFrame, pair: list[str], session: str) -> DataFrame:
    """Rows whose pair stands in every session."""
    n = df.agg(F.count_distinct(session).alias("_all"))
    full = df.groupBy(*pair).agg(F.count_distinct(session).alias("_n")).join(F.broadcast(n), F.col("_n") == F.col("_all")).select(*pair)
    return df.join(full, pair, "left_semi")


def axis_check(a: DataFrame, b: DataFrame, idx: str, value: str, tolerance: float) -> DataFrame:
    """(n_a, n_b, n_off, same): whether two axes have the same places and values within tolerance."""
    both = a.select(F.col(idx), F.col(value).alias("_a")).join(b.select(F.col(idx), F.col(value).alias("_b")), idx, "full")
    out = both.agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count_if(F.coalesce(F.abs(F.col("_a") - F.col("_b")) > tolerance, F.lit(True))).alias("n_off"))
    return out.withColumn("same", F.col("n_off") == 0)


def combined_units(recordings: list[DataFrame]) -> DataFrame:
    """Spikes of several recordings of the same units, each row with its file_no from 0."""
    return reduce(DataFrame.unionByName, [r.withColumn("file_no", F.lit(k)) for k, r in enumerate(recordings)])


def with_qualities(combined: DataFrame, qualities: list[DataFrame], unit: str, quality: str = "quality") -> DataFrame:
    """combined_units() with each row's quality in its own recording, the unit's first known one, and whether all known ones agree.

    qualities: (unit, quality) of each recording, a row for each unit. Units that a recording doesn't rate have null there.
    """
    rated = combined_units([q.select(unit, quality) for q in qualities])
    whole = rated.groupBy(unit).agg(F.min_by(quality, F.when(F.col(quality).isNotNull(), F.col("file_no"))).alias("first_quality"), (F.count_distinct(quality) <= 1).alias("agree"))
    return combined.join(rated, [unit, "file_no"], "left").join(whole, unit, "left")


def snippets(events: DataFrame, samples: DataFrame, keys: list[str], at: str, sample: str, value: str, before: int, after: int, bucket: int) -> DataFrame:
    """(keys, at, snippet): the samples from at - before to at + after, both included, as an array in order."""
    w = events.select(*keys, at).withColumns({"low": F.col(at) - before, "high": F.col(at) + after})
    hit = interval_join(samples, w, keys, sample, "low", "high", bucket, closed="both")
    got = hit.groupBy(*keys, at).agg(F.array_sort(F.collect_list(F.struct(F.col(sample).alias("s"), F.col(value).alias("v")))).alias("_s"))
    return got.select(*keys, at, F.transform("_s", lambda x: x["v"]).alias("snippet"))


def lookup(df: DataFrame, key: str, table: dict, name: str, kind: str = "double") -> DataFrame:
    """df with the value that a small fixed table has for key; null where it has none."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v).cast(kind))]
    return df.withColumn(name, F.element_at(F.create_map(*pairs), F.col(key)))


def left_right(df: DataFrame, position: str = "target_position", target: str = "target", distractor: str = "distractor") -> DataFrame:
    """df with left and right: the target is left where position says LEFT, else right."""
    is_left: Column = F.col(position) == "LEFT"
    return df.withColumns({"left": F.when(is_left, F.col(target)).otherwise(F.col(distractor)), "right": F.when(is_left, F.col(distractor)).otherwise(F.col(target))})
