"""How queries are registered, and what the driver tables stand for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.functions.scalars import micros

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HOUR = 3_600_000_000
DAY = 24 * HOUR


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, as the SQL side rounds them; minus zero is zero."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def query(sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame under its name, with its SQL if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, us, user_id, event_type, value), us in integer microseconds."""
    return table(spark, sf_dir, "events").select("event_id", micros(F.col("ts")).alias("us"), "user_id", "event_type", "value")


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as trials: (user_id, trial, on, quarter of the day, weekday)."""
    quarter = F.floor(F.col("us") % DAY / (6 * HOUR)).cast("int")
    weekday = ((F.floor(F.col("us") / DAY) + 4) % 7).cast("int")
    return events(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("trial"), F.col("us").alias("on"), quarter.alias("quarter"), weekday.alias("weekday"))


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All other events as spikes: (user_id, us)."""
    return events(spark, sf_dir).filter("event_type <> 'purchase'").select("user_id", "us")


EV = """ev AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value FROM events),
trials AS (SELECT user_id, event_id AS trial, us AS onset, CAST((us % 86400000000) // 21600000000 AS INTEGER) AS quarter, CAST((us // 86400000000 + 4) % 7 AS INTEGER) AS weekday FROM ev WHERE event_type = 'purchase'),
spikes AS (SELECT user_id, us FROM ev WHERE event_type <> 'purchase'),
hits AS (SELECT t.*, s.us - t.onset AS rel FROM trials t JOIN spikes s ON s.user_id = t.user_id AND s.us >= t.onset - 86400000000 AND s.us < t.onset + 86400000000)"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a digital line: (user_id, us, event_id, state), state 1 where the value is over 20."""
    return events(spark, sf_dir).select("user_id", "us", "event_id", (F.col("value") > 20).cast("int").alias("state"))


LEVELS = "ev AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value FROM events), din AS (SELECT user_id, us, event_id, CAST(value > 20 AS INTEGER) AS state FROM ev)"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as responses: unit (supplier), theta (8 orientations), sf (line number), tf (return flag), rate (quantity)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("unit"), (F.col("l_partkey") % 8 * 22.5).cast("double").alias("theta"), F.col("l_linenumber").alias("sf"), F.col("l_returnflag").alias("tf"), F.col("l_quantity").alias("rate"), "l_orderkey", "l_partkey")


RESP = "resp AS (SELECT l_suppkey AS unit, CAST(l_partkey % 8 AS DOUBLE) * 22.5 AS theta, l_linenumber AS sf, l_returnflag AS tf, l_quantity AS rate, l_orderkey, l_partkey FROM lineitem)"
MEANS = RESP + ", means AS (SELECT unit, theta, avg(rate) AS mean FROM resp GROUP BY unit, theta)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as traces: (channel: dimension, sample: vec_id, value)."""
    return table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("channel", "value"), F.col("vec_id").alias("sample")).select("channel", "sample", F.col("value").cast("double").alias("value"))


SAMPLES = "samples AS (SELECT CAST(k AS INTEGER) AS channel, vec_id AS sample, CAST(embedding[k + 1] AS DOUBLE) AS value FROM embeddings, range(64) r(k))"


def row_index(df: DataFrame, keys: list[str], order: list[str], name: str = "i") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
