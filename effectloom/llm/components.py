"""Connected components of links, kept in tables from start to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def stars(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root): every linked node with the smallest node it reaches.

    Large-star and small-star rounds alternate; each round points nodes at smaller
    neighbours, so long chains halve, and it is written to the shared folder.
    Minima are pre-aggregated and joined back (skewed nodes are split by the
    join), so no task gathers all neighbours of a node.  Roots have no row.
    """
    def least(edges: DataFrame, node: str, other: str) -> DataFrame:
        low = edges.groupBy(F.col(node).alias("u")).agg(F.min(other).alias("m"))
        return low.select("u", F.least("u", "m").alias("m"))

    now = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # larger neighbours of a node move to the smallest of all its neighbours
        large = both.filter("b > a").join(least(both, "a", "b").withColumnRenamed("u", "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # smaller neighbours and the node itself move to the smallest of them
        low = least(large, "a", "b")
        small = large.join(low.withColumnRenamed("u", "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = staged(small.filter("a <> b").distinct(), "links")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = new
