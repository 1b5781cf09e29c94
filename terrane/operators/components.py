"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.session import checkpointed


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and an order-free checksum of them."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """Return ``(node, component)`` for every node that has an edge to another node.

    ``component`` is the smallest node reachable, the node itself included. Self loops, repeated
    edges and nulls do not matter: edges with a null end are ignored, and a node with self loops
    only is not returned. An empty edge table gives an empty result.

    Each round is two equi-joins of an edge table with its own per-node minimum, so no
    neighbour list is ever collected: a hub with a third of all edges is a skewed join, which
    adaptive execution splits. Rounds grow with the logarithm of the component size, not with
    the diameter. Lineage is cut by a checkpoint after each round.
    """
    a, b = F.greatest(F.col(u), F.col(v)).alias("a"), F.least(F.col(u), F.col(v)).alias("b")
    current = checkpointed(edges.where(F.col(u) != F.col(v)).select(a, b).distinct())
    seen = _state(current)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # Large star: each neighbour above a node is hung on the smallest node around it.
        both = current.select("a", "b").union(current.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours are hung on the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        key = least.select(F.col("a").alias("k"), "m")
        moved = large.join(key, large.a == key.k).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = checkpointed(moved.union(least.select("a", F.col("m").alias("b"))).distinct())
        before, seen = seen, _state(current)
        if seen == before:
            break
    else:
        raise RuntimeError(f"connected components did not settle within {max_rounds} rounds")
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.union(roots)
