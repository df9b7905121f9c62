"""Connected components by alternating stars, every round cut off in the shared folder."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldnote.session import cut_lineage


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) to (node, component): the smallest node reachable, for every node that
    lies in a pair with another one.  Takes a logarithmic number of rounds; only the count of
    the edges and a sum of their hashes come to the driver."""
    edges = cut_lineage(pairs.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(below, "u")
        small = joined.select("v", "m").unionByName(joined.select(F.col("u").alias("v"), "m")).filter("v != m")
        edges = cut_lineage(small.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
