"""Connected components of a link table, for groups of any size and shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porespark.plans.lineage import cut, release


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links`` ``(a, b)``; component is its smallest node.

    Alternates two steps until nothing changes: every larger neighbour of a node
    is linked to the smallest node near it, then every node's smaller neighbours
    are.  The link table never grows by more than a constant, a star of any size
    needs two rounds and a chain a logarithmic number.  Both steps aggregate the
    minimum per node before anything is joined, so a node with very many links
    is combined on the map side.  Each round is stored and the last one freed.
    """
    edges = cut(links.filter(F.col("a") != F.col("b"))
                .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.filter(F.col("v") > F.col("u")).join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").filter(F.col("u") != F.col("v")).distinct())
        step = cut(small)
        release(edges)
        edges = step
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
