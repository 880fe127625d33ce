"""Connected components of a link table, by joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, discard


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node of ``links`` (longs ``a`` and ``b``).

    Each round hangs the larger neighbours of a node to its smallest neighbour, then the smaller ones; both are a
    minimum per node joined back to the links, so a node with very many links is never gathered.  Links
    shrink to stars in a number of rounds that grows with the logarithm of the longest chain.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # now every link leads from a larger node u to a smaller one
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        older, edges = edges, cut_lineage(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            down.select("u", F.col("m").alias("v"))).distinct())
        discard(older)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
