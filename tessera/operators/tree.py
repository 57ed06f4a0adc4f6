"""Component trees as adjacency lists (key, parent): level sums, leaves, derived mixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_parents(tree: DataFrame, root: str) -> DataFrame:
    """tree (key, parent) with the root in place of parents that it has no row of."""
    rows = tree.select(F.col("key").alias("_key")).distinct()
    parent = F.when(F.col("key") == root, None).otherwise(F.coalesce("_key", F.lit(root)))
    return tree.join(rows, tree["parent"] == rows["_key"], "left").withColumn("parent", parent).drop("_key")


def rollup(leaves: DataFrame, tree: DataFrame, amount: str, depth: int, root: str = "root") -> DataFrame:
    """key, parent, amount of every node of the tree, from the amounts of its leaves (key, amount).

    Level by level from below: each level is one aggregation by parent, combined before the shuffle. What has no
    parent in the tree, or isn't in it at all, belongs to the root, so that nothing is lost."""
    whole = with_parents(tree.select("key", "parent"), root)
    at = lambda rows: rows.join(whole, "key", "left").withColumn("parent", F.when(F.col("key") != root, F.coalesce("parent", F.lit(root))))
    level = at(leaves.groupBy("key").agg(F.sum(amount).alias(amount)))
    out = level
    for _ in range(depth):
        level = at(level.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.sum(amount).alias(amount)))
        out = out.unionByName(level)
    return out.groupBy("key", "parent").agg(F.sum(amount).alias(amount))


def leaves(tree: DataFrame, present: DataFrame) -> DataFrame:
    """Present nodes that are no present node's parent."""
    here = tree.join(present, "key", "left_semi")
    inner = here.filter("parent is not null").select(F.col("parent").alias("key")).distinct()
    return here.join(inner, "key", "left_anti")


def derived_mix(df: DataFrame, cell: list[str], part: str, amount: str, without: list[str]) -> DataFrame:
    """Per cell: everything, everything but some parts, and those parts alone."""
    out = F.col(part).isin(without)
    return df.groupBy(*cell).agg(F.sum(amount).alias("recombined"), F.sum(F.when(~out, F.col(amount)).otherwise(0)).alias("minus_one"), F.sum(F.when(out, F.col(amount)).otherwise(0)).alias("acapella"))


def in_catalogue_order(parts: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """parts with place: the catalogue's (key, place) one, 999 for an unknown part; sort by it and by the key."""
    return parts.join(catalogue.select(key, F.col("place").alias("_place")), key, "left").withColumn("place", F.coalesce("_place", F.lit(999))).drop("_place")
