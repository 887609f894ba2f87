"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import settle


def _signature(links: DataFrame) -> tuple[int, int]:
    r = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r.n, r.x or 0


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) of every node that a link names.

    Each round hangs all neighbours of a node under the smallest one, which halves long chains, so the rounds grow with
    the logarithm of the longest path. Minima are summed in parts and joined back, so a hub is no single task.
    """
    u, v = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    edges = settle(links.select(u.alias("u"), v.alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while (now := _signature(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            edges.join(low, "u").filter("m < u").select("u", F.col("m").alias("v"))
        )
        large = settle(large.filter("u <> v").distinct(), "large_star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = settle(small.filter("u <> v").distinct(), "small_star")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(roots.join(edges.select(F.col("u").alias("node")), "node", "left_anti").select("node", F.col("node").alias("component")))
