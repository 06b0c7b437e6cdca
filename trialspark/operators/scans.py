"""Running sums, ranks and runs over orders of any length, without a window over a whole key.

A value's *bucket* is its octave and one of 4096 equal parts of that, so buckets come in the order of the values and need no
sample of them. A running sum is that over octaves (a few for each key), over buckets within an octave, and over rows within
a bucket; a key of any size is spread over its buckets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 4096


def bucket(value: Column) -> Column:
    """A number that never falls as the value rises; values that differ by a part in 4096 mostly differ in it."""
    v = value.cast("double")
    size = F.abs(v)
    octave = F.floor(F.log2(size))
    at = (octave + 1100) * PARTS + F.floor((size / F.pow(F.lit(2.0), octave) - 1) * PARTS)
    finite = F.when(v == 0, 0).otherwise(F.when(v > 0, at).otherwise(-at))
    return F.when(v.isNull(), -10_000_000).when(F.isnan(v) | (v == float("inf")), 10_000_000).when(v == float("-inf"), -9_000_000).otherwise(finite).cast("long")


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of its expression over the rows before this one in the order, within the keys.

    The first column of `order` is a number (or what casts to one); nulls come first. Rows of one bucket are sorted in a task:
    they agree in their first 13 bits and so are few, unless the first column repeats, where the rows of one value stay
    together. Keys must not be null.
    """
    added = lambda name: F.sum(F.col(f"_s_{name}")).alias(f"_s_{name}")
    rows = df.withColumns({"_b": bucket(F.col(order[0])), **{f"_s_{name}": e for name, e in sums.items()}}).withColumn("_o", F.floor(F.col("_b") / PARTS))
    parts = rows.groupBy(*keys, "_o", "_b").agg(*map(added, sums))
    octaves = parts.groupBy(*keys, "_o").agg(*map(added, sums)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_o", *[f"_s_{n}" for n in sums]))).alias("_all"))

    def before(name: str) -> Column:
        kind = rows.schema[f"_s_{name}"].dataType
        lower = F.filter("_all", lambda a: a["_o"] < F.col("_x._o"))
        return F.aggregate(lower, F.lit(0).cast(kind), lambda t, a: (t + F.coalesce(a[f"_s_{name}"], F.lit(0))).cast(kind))

    octaves = octaves.withColumn("_x", F.explode("_all")).select(*keys, "_x._o", *[before(n).alias(f"_p_{n}") for n in sums])
    within = Window.partitionBy(*keys, "_o").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_o", "_b", *[F.coalesce(F.sum(f"_s_{n}").over(within), F.lit(0)).alias(f"_q_{n}") for n in sums])
    starts = parts.join(octaves, [*keys, "_o"]).select(*keys, "_b", *[(F.col(f"_p_{n}") + F.col(f"_q_{n}")).alias(f"_p_{n}") for n in sums])
    last = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(starts, [*keys, "_b"])
    return out.select(*df.columns, *[(F.col(f"_p_{n}") + F.coalesce(F.sum(f"_s_{n}").over(last), F.lit(0))).alias(n) for n in sums])


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """df with the row's number in the order within the keys, from 0. The order should leave no ties."""
    return running(df, keys, order, {name: F.lit(1).cast("long")})


def totals(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """df with aggregates of each key; a single row is joined where there are no keys."""
    sums = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggregates.items()])
    return df.join(sums, keys) if keys else df.crossJoin(F.broadcast(sums))


# The refractory scan: maps that compose.


def spaced_map(times: np.ndarray, interval) -> tuple[np.ndarray, np.ndarray]:
    """Of a range's sorted times: (thresholds, exits). Where the first time kept must be at or after a threshold t, and t is
    at most thresholds[k] but over those before, the last time kept is exits[k]; beyond all thresholds none is kept.

    Which time comes next is found for all at once; exits then follow from the last time to the first.
    """
    following = np.maximum(np.searchsorted(times, times + interval, "left"), np.arange(1, len(times) + 1))
    exits = np.arange(len(times))
    for k in range(len(times) - 1, -1, -1):
        if following[k] < len(times):
            exits[k] = exits[following[k]]
    last = np.flatnonzero(np.append(exits[1:] != exits[:-1], True))
    return times[last], times[exits[last]]


def spaced(times: np.ndarray, threshold, interval) -> np.ndarray:
    """Of sorted times: the first at or after the threshold, then each that is `interval` or more after the last one kept."""
    kept, k = [], int(np.searchsorted(times, threshold, "left")) if threshold is not None else 0
    while k < len(times):
        kept.append(times[k])
        k = max(k + 1, int(np.searchsorted(times, times[k] + interval, "left")))
    return np.array(kept, dtype=times.dtype)


def refractory(df: DataFrame, keys: list[str], time: str, interval: int, intervals_a_range: int = 1024) -> DataFrame:
    """(keys, time): the first event, and then each that is `interval` or more after the last one kept.

    A key's times are cut into ranges, a row each. Each range gives the map from what was kept before it to what is kept at its
    end; maps, a few numbers each, are followed from range to range; with what was kept before it, each range is then gone
    through. So a busy key is spread over its ranges, and the work is in proportion to the events. Null times are left out.
    """
    width = interval * intervals_a_range if interval > 0 else 1
    rows = df.select(*keys, F.col(time).cast("long").alias("_t")).filter("_t IS NOT NULL")
    ranges = rows.groupBy(*keys, F.floor(F.col("_t") / width).cast("long").alias("_range")).agg(F.array_sort(F.collect_list("_t")).alias("_ts"))

    @F.pandas_udf("thresholds array<long>, exits array<long>")
    def maps(times: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([spaced_map(t, interval) for t in times], columns=["thresholds", "exits"])

    @F.pandas_udf("array<long>")
    def follow(thresholds: pd.Series, exits: pd.Series) -> pd.Series:
        """For each range of a key what the first time kept must be at or after."""
        out = []
        for own, ends in zip(thresholds, exits, strict=True):
            before, last = [], None
            for t, e in zip(own, ends, strict=True):
                before.append(int(t[0] if last is None else last + interval))
                k = int(np.searchsorted(t, before[-1], "left"))
                last = e[k] if k < len(e) else last
            out.append(before)
        return pd.Series(out)

    @F.pandas_udf("array<long>")
    def keep(times: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series([spaced(t, None if first else k, interval) for t, (k, first) in zip(times, least[["least", "first"]].itertuples(index=False), strict=True)])

    told = ranges.withColumn("_map", maps("_ts")).select(*keys, "_range", "_map")
    told = told.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_range", "_map.thresholds", "_map.exits"))).alias("_m"))
    told = told.select(*keys, F.posexplode(F.arrays_zip(F.col("_m._range").alias("range"), follow("_m.thresholds", "_m.exits").alias("least"))).alias("_k", "_z"))
    told = told.select(*keys, F.col("_z.range").alias("_range"), F.struct(F.col("_z.least").alias("least"), (F.col("_k") == 0).alias("first")).alias("_least"))
    kept = ranges.join(told, [*keys, "_range"]).select(*keys, F.explode(keep("_ts", "_least")).alias("_t"))
    return kept.select(*keys, F.col("_t").cast(df.schema[time].dataType).alias(time))


# Peaks: thinning and prominence.


def thinned(places: np.ndarray, heights: np.ndarray, distance: int) -> np.ndarray:
    """Which of sorted places stay if, from the highest down (of equal ones the last first), each drops those nearer than `distance`.

    Dropped places leave a linked list, so each is passed over once.
    """
    n = len(places)
    before, after, stays = np.arange(-1, n - 1), np.arange(1, n + 1), np.ones(n, dtype=bool)
    for k in np.lexsort((-places, -heights)):
        if not stays[k]:
            continue
        a, b = before[k], after[k]
        while a >= 0 and places[k] - places[a] < distance:
            stays[a] = False
            a = before[a]
        while b < n and places[b] - places[k] < distance:
            stays[b] = False
            b = after[b]
        before[k], after[k] = a, b
        if a >= 0:
            after[a] = k
        if b < n:
            before[b] = k
    return stays


def peaks_apart(peaks: DataFrame, keys: list[str], place: str, height: str, distance: int) -> DataFrame:
    """(keys, place, height): peaks thinned so that no two are nearer than `distance`, the higher staying.

    Peaks with a gap of `distance` or more between them don't touch one another: each stretch without such a gap is a row,
    thinned alone in one pass over its peaks by height.
    """
    w = Window.partitionBy(*keys).orderBy(place)
    gap = F.coalesce((F.col(place) - F.lag(place).over(w) >= distance).cast("long"), F.lit(0))
    peaks = peaks.withColumn("_g", gap).withColumn("_stretch", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = peaks.groupBy(*keys, "_stretch").agg(F.array_sort(F.collect_list(F.struct(place, height))).alias("_p"))

    @F.pandas_udf("array<boolean>")
    def thin(places: pd.Series, heights: pd.Series) -> pd.Series:
        return pd.Series([thinned(p, h, distance) for p, h in zip(places, heights, strict=True)])

    alone = stretches.filter(F.size("_p") == 1).select(*keys, F.col("_p")[0].alias("_x"))
    crowded = stretches.filter(F.size("_p") > 1).withColumn("_stays", thin(F.col(f"_p.{place}"), F.col(f"_p.{height}")))
    crowded = crowded.select(*keys, F.explode(F.filter("_p", lambda p, k: F.get("_stays", k))).alias("_x"))
    return alone.unionByName(crowded).select(*keys, f"_x.{place}", f"_x.{height}")


def lowest_till_higher(v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in `at` (sorted): the least of v from there back to the last value that is higher, and whether there is one.

    A stack of falling values with the least since each: every value is put on it and taken off once.
    """
    least, found, stack, wanted = np.empty(len(at)), np.zeros(len(at), dtype=bool), [], 0
    for k, x in enumerate(v):
        low = x
        while stack and stack[-1][0] <= x:
            low = min(low, stack.pop()[1])
        if wanted < len(at) and at[wanted] == k:
            least[wanted], found[wanted] = low, bool(stack)
            wanted += 1
        stack.append((x, low))
    return least, found


def prominences(rows: DataFrame, peaks: DataFrame, keys: list[str], place: str, value: str, chunk: int = 8192, name: str = "prominence") -> DataFrame:
    """peaks with prominence: how far a peak stands over the higher of its two bases. A base is the least value between the
    peak and the next higher one on that side, or the recording's end.

    rows: (keys, place, value) with places 0, 1, 2, ... in each recording; peaks: (keys, place, value, ...). Chunks of rows
    are gone through on both sides of their peaks. A base that isn't closed in its chunk is looked for among the chunks' greatest
    and least values, and closed in the one chunk that holds a higher value: only few peaks leave a chunk, those that are the
    highest up to its edge.
    """
    at = F.floor(F.col(place) / chunk).cast("long").alias("_c")
    values = rows.groupBy(*keys, at).agg(F.array_sort(F.collect_list(F.struct(F.col(place).cast("long").alias("i"), F.col(value).cast("double").alias("v")))).alias("_x"))
    values = values.select(*keys, "_c", F.col("_x")[0]["i"].alias("_first"), F.col("_x.v").alias("_v"))
    tops = peaks.groupBy(*[F.col(k).alias(k) for k in keys], at).agg(F.array_sort(F.collect_list(F.struct(F.col(place).cast("long").alias("i"), F.col(value).cast("double").alias("h")))).alias("_tops"))

    @F.pandas_udf("left array<double>, left_closed array<boolean>, right array<double>, right_closed array<boolean>")
    def inside(values: pd.Series, places: pd.Series, first: pd.Series) -> pd.DataFrame:
        out = []
        for v, i, a in zip(values, places, first, strict=True):
            left = lowest_till_higher(v, i - a)
            right = lowest_till_higher(v[::-1], (len(v) - 1 - (i - a))[::-1])
            out.append((*left, right[0][::-1], right[1][::-1]))
        return pd.DataFrame(out, columns=["left", "left_closed", "right", "right_closed"])

    found = values.join(tops, [*keys, "_c"]).withColumn("_s", inside("_v", "_tops.i", "_first"))
    each = F.arrays_zip(F.col("_tops.i").alias("i"), F.col("_tops.h").alias("h"), F.col("_s.left").alias("l"), F.col("_s.left_closed").alias("lc"), F.col("_s.right").alias("r"), F.col("_s.right_closed").alias("rc"))
    sides = found.select(*keys, "_c", F.explode(each).alias("_z"))
    side = lambda sign, base, closed: F.struct(F.lit(sign).alias("side"), F.col(f"_z.{base}").alias("base"), F.col(f"_z.{closed}").alias("closed"))
    sides = sides.select(*keys, "_c", F.col("_z.i").alias("_i"), F.col("_z.h").alias("_h"), F.explode(F.array(side(-1, "l", "lc"), side(1, "r", "rc"))).alias("_y")).select(*keys, "_c", "_i", "_h", "_y.*")

    @F.pandas_udf("array<struct<i: long, h: double, side: int, base: double, to: long>>")
    def across(opened: pd.Series, chunks: pd.Series) -> pd.Series:
        """Each open side of a key: the chunk that closes it (-1: none), and the least on the way."""
        out = []
        for sides_, told in zip(opened, chunks, strict=True):
            number, top, low = (np.array([t[n] for t in told]) for n in ("_c", "most", "least"))
            rows_ = []
            for s in sides_:
                base, k = s["base"], int(np.searchsorted(number, s["_c"])) + s["side"]
                while 0 <= k < len(number) and top[k] <= s["_h"]:
                    base, k = min(base, low[k]), k + s["side"]
                rows_.append({"i": s["_i"], "h": s["_h"], "side": s["side"], "base": base, "to": int(number[k]) if 0 <= k < len(number) else -1})
            out.append(rows_)
        return pd.Series(out)

    extremes = values.select(*keys, F.struct("_c", F.array_max("_v").alias("most"), F.array_min("_v").alias("least")).alias("_e")).groupBy(*keys).agg(F.array_sort(F.collect_list("_e")).alias("_chunks"))
    opened = sides.filter("NOT closed").groupBy(*keys).agg(F.collect_list(F.struct("_i", "_h", "side", "base", "_c")).alias("_open")).join(extremes, keys)
    lone = opened.filter(F.size("_chunks") == 1).select(*keys, F.explode("_open").alias("_o")).select(*keys, F.col("_o._i").alias("_i"), "_o.base")
    moved = opened.filter(F.size("_chunks") > 1).select(*keys, F.explode(across("_open", "_chunks")).alias("_o")).select(*keys, F.col("_o.i").alias("_i"), F.col("_o.h").alias("_h"), "_o.side", "_o.base", F.col("_o.to").alias("_c"))

    @F.pandas_udf("array<double>")
    def closing(values: pd.Series, asked: pd.Series) -> pd.Series:
        """Of values between a chunk's edge and its first higher value, the least."""
        out = []
        for v, own in zip(values, asked, strict=True):
            bases = []
            for s in own:
                turned = v if s["side"] > 0 else v[::-1]
                upto = int((turned > s["_h"]).argmax())
                bases.append(min(s["base"], turned[:upto].min()) if upto else s["base"])
            out.append(bases)
        return pd.Series(out)

    asked = moved.filter("_c >= 0").groupBy(*keys, "_c").agg(F.collect_list(F.struct("_i", "_h", "side", "base")).alias("_asked"))
    closed = values.join(asked, [*keys, "_c"]).select(*keys, F.explode(F.arrays_zip(F.col("_asked._i").alias("i"), closing("_v", "_asked").alias("b"))).alias("_o")).select(*keys, F.col("_o.i").alias("_i"), F.col("_o.b").alias("base"))
    bases = reduce(DataFrame.unionByName, [sides.filter("closed").select(*keys, "_i", "base"), lone, moved.filter("_c < 0").select(*keys, "_i", "base"), closed])
    higher = bases.groupBy(*keys, "_i").agg(F.max("base").alias("_base"))
    return peaks.withColumn("_i", F.col(place).cast("long")).join(higher, [*keys, "_i"]).select(*peaks.columns, (F.col(value) - F.col("_base")).alias(name))
