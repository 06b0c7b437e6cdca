"""Structured Streaming variants of three batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_rate(events: DataFrame, ts: str, width: str, late: str, seconds: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, start, n, rate): events in tumbling windows, final once the watermark has passed (append mode)."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width), *(keys or [])).agg(F.count("*").alias("n"))
    return counted.select(*(keys or []), F.col("window.start").alias("start"), "n", (F.col("n") / F.lit(seconds)).alias("rate"))


def live_segments(events: DataFrame, ts: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """(keys, start, end, n): runs of events; a gap of `gap` or more ends one (the batch operator splits beyond it only)."""
    found = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"), F.max(ts).alias("end"))
    return found.select(*keys, F.col("session_window.start").alias("start"), "end", "n")


def live_refractory(events: DataFrame, key: str, ts: str, seconds: float, late: str, idle: float | None = None) -> DataFrame:
    """(key, ts): each key's first event, and then each that is `seconds` or more after the last one kept.

    Within a batch events are taken in the order of time; one that comes after a later one was kept is dropped, as are those
    behind the watermark. A key's state is its last kept time and its last event; it goes once the watermark is `idle`
    seconds (at least, and by default, `seconds`) past that event, when it can't hold back any further one. So state is in
    proportion to the keys of late, not to all there ever were, and a restart finds it in the checkpoint.
    """
    wait = int(1000 * max(seconds, idle or 0))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, newest = state.get if state.exists else (None, None)
        kept = []
        for t in sorted(t for f in frames for t in f["_us"]):
            if last is None or t - last >= seconds * 1e6:
                kept.append(t)
                last = t
            newest = t if newest is None else max(newest, t)
        if last is not None:
            state.update((int(last), int(newest)))
            state.setTimeoutTimestamp(max(int(newest) // 1000 + wait, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"key": [key[0]] * len(kept), "us": kept})

    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark(ts, late).filter(F.col(ts).isNotNull()).select(F.col(key), F.col(ts), F.unix_micros(ts).alias("_us"))
    out = rows.groupBy(key).applyInPandasWithState(step, f"key {kind}, us long", "last long, newest long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("key").alias(key), F.timestamp_micros("us").alias(ts))
