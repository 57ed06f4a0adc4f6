"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def connected_components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node that links reach) of every node of links (a, b: long).

    Each round points all of a node's larger neighbours, then all of its smaller
    ones, to the smallest node it sees; rounds end when nothing changes. A node's
    neighbours are never gathered: its minimum is pre-aggregated and joined back,
    so a node with very many links is split like any skewed join.
    """
    stars = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    seen = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(least, "u")
        before, stars = stars, cut(hooked.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct())
        drop(before)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).union(stars.select("v", "v").distinct().toDF("node", "label"))
        seen = now
