"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a join and an aggregation over the stored edges; nothing but two numbers
for the stop test reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the node's smallest neighbour."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"] or 0


def connected_components(edges: DataFrame, scratch: C.Scratch) -> DataFrame:
    """``node, component`` (smallest node) for every node of the edges ``a, b`` (longs, a <> b), as a stored table."""
    current = scratch.table(_small_star(_large_star(edges)), "components")
    state = _state(current)
    while True:
        following = scratch.table(_small_star(_large_star(current)), "components")
        scratch.drop(current)
        current, before, state = following, state, _state(following)
        if state == before:
            break
    # a star now: each node points to its component's smallest node, which has no row of its own
    out = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    stored = scratch.table(out.union(roots), "component-labels")
    scratch.drop(current)
    return stored
