"""Connected components by alternating large and small stars; every step is a shuffle of edges, none a collect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import discard, stored


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b")))


def _done(e: DataFrame) -> bool:
    """Whether each node has one edge, to a node that has none of its own."""
    several = e.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
    chained = e.select(F.col("b").alias("a")).join(e.select("a"), "a", "left_semi")
    return several.unionByName(chained).isEmpty()


def stars(edges: DataFrame) -> DataFrame:
    """(a, b): each node that has an edge and is not its component's least, with that least node. edges: (a, b), any
    order, loops allowed. Each step is stored, so a lost executor costs one step."""
    spark = edges.sparkSession
    e = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e, "stars")
    while not _done(e):
        new = stored(_small(_large(e).distinct()).distinct(), "stars")
        discard(spark, e)
        e = new
    return e
