"""Connected components of an edge table by alternating stars, each round a Spark job whose result is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import join_counted, release, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large star (each node sends its larger neighbours to its least one) or small star (its smaller ones)."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = edges.unionByName(turned) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
    joined = join_counted(near, least, ["a"], "n")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) longs -> (node, root): the smallest node that each node of an edge reaches; roots themselves are included.

    Large and small stars in turn until the edges stay the same, which takes rounds in the order of the logarithm of the
    longest path. Neighbour lists are never gathered: a hub's rows are joined with its least neighbour, hot hubs apart.
    Edges with a null end, and loops, are ignored.
    """
    edges = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        large = written(_star(edges, large=True), "large-star")
        small = written(_star(large, large=False), "small-star")
        release(edges, large)
        edges = small
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
