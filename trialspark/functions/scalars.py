"""Column functions: dates in names, numbers in text, angles, arrays of times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """A timestamp, with or without zone, as integer microseconds."""
    return F.unix_micros(ts.cast("timestamp"))


def date_range(first: Column, last: Column) -> Column:
    """array<string>: each day as yyMMdd, both ends included; first and last are yyMMdd strings."""
    days = F.sequence(F.to_date(first, "yyMMdd"), F.to_date(last, "yyMMdd"), F.expr("interval 1 day"))
    return F.transform(days, lambda d: F.date_format(d, "yyMMdd"))


def name_time(name: Column) -> Column:
    """The time that a file name holds as yyyy-MM-dd_HH-mm-ss, or null."""
    return F.try_to_timestamp(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd_HH-mm-ss"))


def time_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmm")


def signed_decimals(text: Column) -> Column:
    """array<double>: all numbers with an optional sign and fraction."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([-+]?\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))


def number_range(text: Column) -> Column:
    """struct<low, high> of a..b, nulls if it is none."""
    at = lambda k: F.regexp_extract(text, r"^\s*([-+]?\d+(?:\.\d+)?)\s*\.\.\s*([-+]?\d+(?:\.\d+)?)\s*$", k).try_cast("double")
    return F.struct(at(1).alias("low"), at(2).alias("high"))


def number_list(text: Column) -> Column:
    """array<double> of [a, b, c]; empty for []."""
    inner = F.trim(F.regexp_replace(text, r"[\[\]]", ""))
    return F.when(inner == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(inner, r"\s*,\s*"), lambda x: x.try_cast("double")))


def pair_list(text: Column) -> Column:
    """array<struct<a, b>> of a:b,c:d."""
    parts = F.split(F.regexp_replace(text, r"\s", ""), ",")
    return F.transform(parts, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).try_cast("double").alias("a"), F.split_part(x, F.lit(":"), F.lit(2)).try_cast("double").alias("b")))


def normal_key(text: Column) -> Column:
    """Lower case, runs of white space as one underscore."""
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", "_")


def percent(text: Column) -> Column:
    return F.regexp_extract(text, r"([-+]?\d+(?:\.\d+)?)\s*%", 1).try_cast("double")


def seconds_of(text: Column) -> Column:
    """1.0 of '1.0s' or '1.0'."""
    return F.regexp_replace(F.trim(text), "s$", "").try_cast("double")


def flag(text: Column) -> Column:
    """boolean of true/yes/on/1 and false/no/off/0 in any case; null for other texts."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "yes", "on", "1"), True).when(t.isin("false", "no", "off", "0"), False)


def time_or_text(text: Column) -> Column:
    """struct<time, text>: the time that a text gives, else the text itself."""
    at = F.try_to_timestamp(F.trim(text))
    return F.struct(at.alias("time"), F.when(at.isNull(), text).alias("text"))


def duration(text: Column, default: float, override: Column | None = None) -> Column:
    """Seconds: the override where there is one, else what the text says, else the default."""
    told = F.coalesce(seconds_of(text), F.lit(default))
    return told if override is None else F.coalesce(override.cast("double"), told)


def unit_key(shank: Column, sorting: Column, unit: Column) -> Column:
    return F.concat_ws("_", shank, sorting, F.concat(F.lit("unit"), unit.cast("string")))


def short_unit(key: Column) -> Column:
    """shankX_unitY out of a longer name; the name itself if it has neither."""
    found = F.concat_ws("_", F.regexp_extract(key, r"(shank\d+).*?(unit\d+)", 1), F.regexp_extract(key, r"(shank\d+).*?(unit\d+)", 2))
    return F.when(found == "_", key).otherwise(found)


def visual_angle(size: Column, distance: Column) -> Column:
    """Degrees that half a size takes at a distance."""
    return F.degrees(F.atan(size / 2 / distance))


def pixels_per_degree(pixels: Column, width: Column, distance: Column) -> Column:
    return 2 * distance * F.tan(F.radians(F.lit(0.5))) * pixels / width


def dot_place(dot: Column, columns: int) -> Column:
    """struct<row, col> of a dot counted from 1 along rows."""
    return F.struct(F.floor((dot - 1) / columns).cast("int").alias("row"), F.pmod(dot - 1, F.lit(columns)).cast("int").alias("col"))


def drift_direction(theta: Column) -> Column:
    """1 where cos(theta) is 0 or more (within rounding), else -1."""
    return F.when(F.round(F.cos(F.radians(theta)), 12) >= 0, 1).otherwise(-1)


def log_power(x: Column) -> Column:
    return F.log10(x + F.lit(1e-10))


def steps(times: Column) -> Column:
    """array: differences between neighbours of an array."""
    return F.zip_with(F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, 1, F.greatest(F.size(times) - 1, F.lit(0))), lambda b, a: b - a)


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def array_var(a: Column) -> Column:
    """Population variance of an array; null if it is empty."""
    m = array_mean(a)
    return array_mean(F.transform(a, lambda x: (x - m) * (x - m)))


def millis(times: Column) -> Column:
    """array: seconds as milliseconds."""
    return F.transform(times, lambda x: x * 1000)


def before_and_after(times: Column, at: Column | float = 0.0) -> Column:
    """struct<before, after>: times under a moment and those from it on, relative to it."""
    at = at if isinstance(at, Column) else F.lit(at)
    moved = F.transform(times, lambda x: x - at)
    return F.struct(F.filter(moved, lambda x: x < 0).alias("before"), F.filter(moved, lambda x: x >= 0).alias("after"))
