"""Connected components of an edge table as a distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import forget, written


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Hang each node's neighbours on the smallest of them: all larger ones, or (both=False) the smaller ones.

    edges have a > b. Minima are aggregated before the join, so a hub costs one row.
    """
    if both:  # every neighbour larger than the node moves to the node's smallest neighbour
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        moved = edges.join(low, F.col("b") == F.col("n")).select("a", F.col("m").alias("b"))
    else:  # the node and its smaller neighbours move to the smallest of these
        low = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        joined = edges.join(low, F.col("a") == F.col("n"))
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Input: columns a and b of one orderable type; loops and nulls are left out, repeats and direction
    do not matter. Large-star and small-star rounds, each written to the shared folder, end when
    nothing changes; their number grows with the logarithm of the longest chain.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state, seen = written(edges, "edges"), None
    for _ in range(rounds):
        following = written(_star(_star(state, True), False), "edges")
        forget(state)
        state = following
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
