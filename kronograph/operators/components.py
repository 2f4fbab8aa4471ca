"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronograph.sources.shared import Written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge.

    Each step re-links a node's neighbours to the least of them, so the number
    of steps grows with the logarithm of the longest path. Every step is a
    partial aggregation and one join, written to the shared folder; a node may
    have any share of the edges, as the join's large side is split when skewed.
    Loops and nulls are left out; repeated edges count once.
    """
    pairs = edges.select(F.least(src, dst).alias("v"), F.greatest(src, dst).alias("u")).filter("u <> v").distinct()
    now = Written(pairs, "star")
    while True:
        both = now.read().select("u", "v").unionByName(now.read().select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours go to the least of the neighbourhood
        least = Written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        linked = both.join(least.read(), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = Written(linked, "large")
        least.drop()
        # small star: smaller neighbours, and the node itself, go to the least of them
        low = Written(large.read().groupBy("u").agg(F.min("v").alias("m")), "low")
        kept = large.read().join(low.read(), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        after = Written(kept.unionByName(low.read().select("u", F.col("m").alias("v"))).distinct(), "star")
        same = _digest(now.read()) == _digest(after.read())
        large.drop()
        low.drop()
        now.drop()
        now = after
        if same:
            break
    stars = now.read()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _digest(pairs: DataFrame) -> tuple:
    """Number and checksum of the distinct pairs."""
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
