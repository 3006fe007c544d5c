"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdocs.session import stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    Each round hangs the larger neighbours of a node below its least neighbour, then all others, so the
    depth of every tree halves or better. Least neighbours come from partial aggregates, so a hub node
    is never gathered; its edges are split by the adaptive skew join. Each round is written to the shared
    folder. Null ends, loops and repeated edges are ignored. Raises if `rounds` is not enough.
    """
    edge = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        .filter("u <> v")
        .distinct()
    )
    edge = stage(edge)
    before = _state(edge)
    for _ in range(rounds):
        near = edge.select(F.col("v").alias("x"), F.col("v").alias("y")).union(
            edge.select(F.col("u").alias("x"), F.col("v").alias("y"))
        )
        least = near.groupBy("x").agg(F.min("y").alias("m"))
        large = (
            edge.join(least, F.col("v") == F.col("x")).select("u", F.col("m").alias("v")).distinct()
        )
        large = stage(large)
        root = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(root, F.col("u") == F.col("x"))
        moved = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edge = stage(moved.union(root.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct())
        after = _state(edge)
        if after == before:
            roots = edge.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        before = after
    raise RuntimeError(f"components not settled after {rounds} rounds")
