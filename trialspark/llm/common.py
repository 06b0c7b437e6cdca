"""Shared pieces of the training-data operators: tables, scratch storage, skew-safe joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold more than one in HOT_SHARE of all counted rows are joined by broadcast: there are at most HOT_SHARE of them.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share; it goes when the session's JVM ends.

    The folder is spark.checkpoint.dir, or what setCheckpointDir was given. Where neither is set, a temporary folder will do
    only if the driver's process runs all tasks (as in tests): executors elsewhere would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later reads don't depend on the executors that made it."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that written() gave, once all that is made of them is written itself: nothing may read them any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(t._scratch)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def join_counted(big: DataFrame, small: DataFrame, keys: list[str], n: str) -> DataFrame:
    """big JOIN small USING (keys), where small has each key once and its column n says how many rows of big have it.

    A key that holds over 1/HOT_SHARE of the rows would fill one task of a shuffled join. There are fewer than
    HOT_SHARE such keys whatever the input, so they are broadcast; all other keys are shuffled. No row is lost.
    """
    total = small.agg(F.sum(n)).first()[0] or 0
    hot = small.filter(F.col(n) * HOT_SHARE > total)
    cold = small.filter(F.col(n) * HOT_SHARE <= total)
    return big.join(F.broadcast(hot), keys).unionByName(big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def bounded_broadcast(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` (narrow) rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def least_hashed(df: DataFrame, n: int, total: int, *columns: str) -> DataFrame:
    """About the n rows of df (of `total`) with the least hashes of these columns; all rows if there are no more than n.

    Rows far over the expected cut are left out by tasks before the sort, so that what tasks send to be merged is a small
    multiple of n, however many tasks there are. Now and then this yields a little under n.
    """
    h = F.xxhash64(*columns, F.lit("sample"))
    if total <= n:
        return df
    cut = min(1 << 20, int((1 << 20) * (1.2 * n + 200) / total) + 1)
    return df.filter(F.pmod(h, F.lit(1 << 20)) < cut).orderBy(F.pmod(h, F.lit(1 << 20)), h, *columns).limit(n)


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text): the whole row as a struct, so that no column of the input can clash with one of ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
