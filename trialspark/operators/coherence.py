"""Cross-channel coherence and phase: one transform for each channel and segment, then relational sums over pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.operators.intervals import in_all
from trialspark.operators.signals import hann
from trialspark.operators.windows import frequency_bins, moving_average, savgol


def segment_spectra(segments: DataFrame, keys: list[str], fs: float, low: float, high: float) -> DataFrame:
    """(keys, seg, k, freq, re, im) of segments (keys, seg, x): Hann window, mean removed, frequencies low to high."""

    @F.pandas_udf("array<struct<k: int, freq: double, re: double, im: double>>")
    def transform(x: pd.Series) -> pd.Series:
        out = []
        for v in x:
            v = np.asarray(v, dtype=float)
            s = np.fft.rfft((v - v.mean()) * hann(len(v)))
            f = np.arange(len(s)) * fs / len(v)
            out.append([{"k": int(k), "freq": float(f[k]), "re": float(s[k].real), "im": float(s[k].imag)} for k in np.flatnonzero((f >= low) & (f <= high))])
        return pd.Series(out)

    return segments.select(*keys, "seg", F.explode(transform("x")).alias("_z")).select(*keys, "seg", "_z.*")


def coherence(a: DataFrame, b: DataFrame, session: list[str], a_ch: str, b_ch: str) -> DataFrame:
    """(session, a_ch, b_ch, k, freq, coh, phase) over the segments that both sides have.

    a and b are segment_spectra() of two groups of channels: a segment meets its own number of the other group alone.
    coh = |sum conj(X) Y|**2 / (sum |X|**2 sum |Y|**2); phase is the angle of sum conj(X) Y. A pair without power has none.
    """
    left = a.select(*session, a_ch, "seg", "k", "freq", F.col("re").alias("ar"), F.col("im").alias("ai"))
    right = b.select(*session, b_ch, "seg", "k", F.col("re").alias("br"), F.col("im").alias("bi"))
    c = lambda x: F.col(x)
    s = left.join(right, [*session, "seg", "k"]).groupBy(*session, a_ch, b_ch, "k", "freq").agg(
        F.sum(c("ar") * c("br") + c("ai") * c("bi")).alias("re"),
        F.sum(c("ar") * c("bi") - c("ai") * c("br")).alias("im"),
        F.sum(c("ar") * c("ar") + c("ai") * c("ai")).alias("pa"),
        F.sum(c("br") * c("br") + c("bi") * c("bi")).alias("pb"),
    )
    power = c("pa") * c("pb")
    return s.select(*session, a_ch, b_ch, "k", "freq", F.when(power > 0, (c("re") * c("re") + c("im") * c("im")) / power).alias("coh"), F.when(power > 0, F.atan2("im", "re")).alias("phase"))


def session_means(coh: DataFrame, session: str, pair: list[str]) -> DataFrame:
    """(session, k, freq, n, mean, sd, sem) over the pairs that every session has; sd is the population's."""
    full = in_all(coh, pair, session)
    out = full.groupBy(session, "k", "freq").agg(F.count("coh").alias("n"), F.avg("coh").alias("mean"), F.stddev_pop("coh").alias("sd"))
    return out.withColumn("sem", F.col("sd") / F.sqrt("n"))


def smoothed(df: DataFrame, keys: list[str], freq: str, value: str, method: str = "none", width: float = 2.0, first: float = 0.0, bins: int = 200) -> DataFrame:
    """Spectra by frequency with a smooth column: frequency_bin (rows become bins of `width`), moving_average and savgol
    over `width` rows, or none. A width under 1 leaves the values as they are."""
    if method == "none" or width < 1:
        return df.withColumn("smooth", F.col(value))
    if method == "frequency_bin":
        return frequency_bins(df, keys, freq, value, first, width, bins).withColumnRenamed("value", "smooth")
    if method == "moving_average":
        return moving_average(df, keys, [freq], value, int(width))
    if method == "savgol":
        return savgol(df, keys, [freq], value, int(width), min(3, int(width) - 1))
    raise ValueError(f"no such smoothing: {method}")


def with_places(pairs: DataFrame, channels: DataFrame, a: str, b: str, channel: str = "channel") -> DataFrame:
    """pairs with the places of both channels (a_x, a_y, b_x, b_y) and their distance; channels: (channel, x, y), a row each.

    A pair with a channel that has no place keeps nulls.
    """
    side = lambda name, prefix: channels.select(F.col(channel).alias(name), F.col("x").alias(f"{prefix}_x"), F.col("y").alias(f"{prefix}_y"))
    out = pairs.join(side(a, "a"), a, "left").join(side(b, "b"), b, "left")
    return out.withColumn("distance", F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")))
