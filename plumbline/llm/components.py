"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node that can be reached.

    Alternating star contraction: each node's larger, then smaller, neighbours are hung on its
    smallest one, until every edge is a spoke of a star. Each round moves the edges once a step and
    is written to the shared folder, in as many files as it has half millions of rows; the number of rounds
    grows with the logarithm of the longest path. It ends when every node hangs on one that hangs on none.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    whole = Window.partitionBy("u")
    rows = now.count()
    while rows:
        ends = now.select(F.col("b").alias("u"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionAll(now.select("a", F.lit(0), F.lit(1)))
        odd = ends.groupBy("u").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs + holds > 1 and hangs > 0")
        if odd.isEmpty():
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = (both.withColumn("m", F.least(F.min("v").over(whole), F.col("u"))).where("v > u")
                 .select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct())
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v")).withColumn("m", F.min("v").over(whole))
        small = down.select(F.col("m").alias("a"), F.col("v").alias("b")).unionAll(down.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a < b").distinct()
        last, now = now, written(small.coalesce(8 + rows // 500_000), "edges")
        dropped(last)
        rows = now.count()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
