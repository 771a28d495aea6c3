"""Connected components of a table of edges by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscope.llm.common import checkpointed

MAX_ROUNDS = 100  # the number of rounds grows with the logarithm of a component's size


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest vertex among u and its neighbours v."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected(links: DataFrame) -> DataFrame:
    """(v, component) for every vertex of the edges (a, b): its component's smallest vertex.
    Each round is a grouped minimum and a join on the edges, written to the checkpoint folder;
    a vertex with many neighbours is aggregated in tasks before it is gathered."""
    edges = checkpointed(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        # large star: every larger neighbour is joined to the smallest one
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours and the vertex itself are joined to the smallest one
        least = _least(large)
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = checkpointed(small.where("u != v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v"), F.col("v").alias("component")).distinct())
