"""Connected components over links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node, root for every node with a link to another; root is the component's smallest node.

    Every round rewires each node to the smallest neighbour known; rounds grow
    with the logarithm of the longest chain. Nothing but a count and a checksum
    reaches the driver. No links: no rows.
    """
    a, b = F.col(left), F.col(right)
    edges = cut(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small)
        del small
        release(edges.sparkSession)
        now = _state(edges)
        if now == state:
            break
        state = now
    own = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return own.unionByName(own.select(F.col("root").alias("node"), "root").distinct())
