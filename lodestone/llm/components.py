"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, root): root is the smallest node of node's component, for every node of `edges` that isn't the root.

    edges: columns a, b of one orderable type; loops, repeats and either direction are fine, rows with a null are no
    edges. The steps of each round are written out, so lineage stays short and nothing but a checksum comes to the
    driver. A component of n nodes takes O(log^2 n) rounds.
    """
    now = work.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = checksum(now)
    while seen[0]:
        both = now.union(now.select("b", "a"))
        # tables of their own, so that Spark can split the joins at a node with very many neighbours
        least = work.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = work.table(large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        nearest = work.table(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(nearest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after = work.table(small.where("a <> b").distinct())
        for done in (least, large, nearest):
            work.drop(done)
        work.drop(now)
        now, before, seen = after, seen, checksum(after)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
