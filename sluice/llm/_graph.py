"""Connected components of an edge table by alternating stars, on DataFrames only.

Large star hangs each node's larger neighbours under the smallest node next to it, small star its
smaller ones; the two repeat until the edges stay as they are, which takes about log(n) rounds.
Minima are summed up before they are shuffled, and each join has a written table on either side,
so Spark can split a hub's rows (adaptive skew join) or broadcast what it finds small enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the smallest node reachable) for each node that has an edge.

    Edges with a null end and loops count for nothing; repeated edges count once; no edges give no rows.
    """
    now = scratch.table(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select("u", "u").distinct())
        before = mark
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).union(now.select("u", "v"))
        least = scratch.table(both.groupBy("x").agg(F.least("x", F.min("y")).alias("m")))
        large = scratch.table(both.join(least, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct())
        low = scratch.table(large.groupBy("v").agg(F.min("u").alias("m")))
        small = large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u"))).distinct()
        after = scratch.table(small)
        for old in (now, least, large, low):
            scratch.drop(old)
        now = after
