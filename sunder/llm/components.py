"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunder.llm.common import dropped, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (a, b) joins to another; root is the smallest node of its component.

    Nodes are longs. Edges may repeat and run either way; one with a null end or equal ends is ignored.
    Each round is two aggregations with map-side combination and two joins, whose large partitions the planner can
    split, so that a hub isn't one task's work; a round's edges are written, so that a lost executor costs a part of a
    round. The count of rounds grows with the logarithm of the longest path.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    before = None
    while (state := now.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()) != before and state[0]:
        before, last = state, now
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        nearest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(nearest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = written(moved.union(nearest.select("hi", "m")).distinct(), "edges")
        dropped(last)
    members = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return members.union(members.select("root", "root").distinct())
