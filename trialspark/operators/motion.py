"""Velocity of a tracked position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.intervals import interpolated
from trialspark.operators.windows import gaussian_smooth, median_filter, savgol


def _smoothed(track: DataFrame, keys: list[str], order: list[str], columns: list[str], method: str, width: int) -> DataFrame:
    out = track
    for c in columns:
        if method == "savgol":
            out = savgol(out, keys, order, c, width, 3, name=f"_{c}")
        elif method == "median":
            out = median_filter(out, keys, order, c, width if width % 2 else width + 1, name=f"_{c}")
        elif method == "gaussian":
            if "_i" not in out.columns:
                out = out.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
            out = gaussian_smooth(out, keys, "_i", c, width / 6, name=f"_{c}")
        else:
            out = out.withColumn(f"_{c}", F.col(c).cast("double"))
    return out.drop(*columns).withColumnsRenamed({f"_{c}": c for c in columns})


def velocity(track: DataFrame, keys: list[str], t: str, x: str, y: str, method: str = "simple", width: int = 11, most: float = 530.0, resmooth: bool = True) -> DataFrame:
    """(keys, t, raw, v): distance by time between neighbours of the smoothed track (simple, savgol, median, gaussian).

    A step without time counts as 1e-8. Speeds over `most` become 0; then the speed itself is smoothed (Savitzky-Golay). raw
    is the speed before that. The first row of a track has none and is left out.
    """
    s = _smoothed(track.select(*keys, F.col(t).alias("_t"), x, y), keys, ["_t"], [x, y], method, width)
    w = Window.partitionBy(*keys).orderBy("_t")
    dt = F.col("_t") - F.lag("_t").over(w)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    speed = F.hypot(dx, dy) / F.when(dt == 0, F.lit(1e-8)).otherwise(dt)
    out = s.withColumn("raw", speed).filter("raw IS NOT NULL").withColumn("v", F.when(F.col("raw") > most, 0.0).otherwise(F.col("raw")))
    if resmooth:
        out = savgol(out, keys, ["_t"], "v", width, 3, name="v")
    return out.select(*keys, F.col("_t").alias(t), "raw", "v")


def velocity_by_derivative(track: DataFrame, keys: list[str], t: str, x: str, y: str, width: int = 11, most: float = 530.0) -> DataFrame:
    """(keys, t, vx, vy, v): derivative of the fitted polynomials by the mean step; speeds over `most` are filled in linearly."""
    w = Window.partitionBy(*keys)
    step = (F.max(t).over(w) - F.min(t).over(w)) / (F.count("*").over(w) - 1)
    d = track.select(*keys, F.col(t).alias("_t"), x, y, F.nullif(step, F.lit(0.0)).alias("_dt"))
    for c, name in ((x, "vx"), (y, "vy")):
        d = savgol(d, keys, ["_t"], c, width, 3, derivative=1, name=name)
    d = d.withColumns({"vx": F.col("vx") / F.col("_dt"), "vy": F.col("vy") / F.col("_dt")}).withColumn("_v", F.hypot("vx", "vy"))
    good = d.filter((F.col("_v") <= most) & F.col("_v").isNotNull())
    filled = interpolated(d.select(*keys, F.col("_t").alias("_grid")), good, keys, "_grid", "_t", "_v", "v").withColumnRenamed("_grid", "_t")
    return d.join(filled, [*keys, "_t"]).select(*keys, F.col("_t").alias(t), "vx", "vy", "v")
