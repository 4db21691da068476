"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlake.llm.runtime import Workspace


def connected(edges: DataFrame, space: Workspace) -> DataFrame:
    """node, root (the smallest node reachable) for all nodes of edges (a long, b long); self-loops and repeats do no harm.

    Alternates two steps until nothing changes: every node hands all its larger neighbours to the
    smallest node it knows (large star), then all its smaller ones (small star). Each step is a
    minimum with map-side combination and a join, its result is written to the shared folder,
    and the number of rounds grows with the logarithm of the longest chain.
    """
    pairs, mark, first = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), None, True
    while True:
        both = pairs.union(pairs.select("b", "a"))
        # written first, so that the join below deals out both sides itself and a hub's rows can be split
        least = space.keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least", narrow=True)
        large = space.keep(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large", narrow=True)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new, now = space.noted(small, "small", narrow=True, rows=F.count(F.lit(1)), mark=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        space.drop(least, large, *(() if first else (pairs,)))
        pairs, first = new, False
        if now == mark:
            break
        mark = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select("b", "b").distinct())
