"""Connected components of an undirected graph, as alternating star operations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import checkpointed

#: The number of rounds is logarithmic in a component's diameter; more of them are a defect.
MOST_ROUNDS = 60
#: A node with more than this part of all edges is a hub; there are fewer than `HUBS`.
HUBS = 1024
#: Edges up to which the minima of all nodes are broadcast (16 bytes each).
BROADCAST_EDGES = 1 << 18
#: Edges in a task. A graph has no more partitions than that asks for: those of a small one would be nearly all empty, and each costs files and a task in every step of every round.
TASK_EDGES = 1 << 17


def _held(edges: DataFrame, total: int) -> DataFrame:
    """`edges` in as many partitions as `total` edges ask for; those of one partition meet without a shuffle."""
    return edges.coalesce(max(1, math.ceil(total / TASK_EDGES)))


def _with_least(edges: DataFrame, key: str, other: str, total: int) -> DataFrame:
    """`edges` with the least `other` end of those that share `key`.

    Minima are combined before their shuffle. Those of a small graph are broadcast, and
    of a large one those of hubs, fewer than `HUBS` rows, so that a hub's edges stay
    where they are; the others' are joined.
    """
    least = edges.groupBy(key).agg(F.min(other).alias("least"), F.count("*").alias("n"))
    if total <= BROADCAST_EDGES:
        return edges.select("a", "b").join(F.broadcast(least.select(key, "least")), key).select("a", "b", "least")
    hub = F.col("n") * HUBS > total
    hubs = least.where(hub).select(F.col(key).alias("hub"), F.col("least").alias("of_hub"))
    marked = edges.join(F.broadcast(hubs), F.col(key) == F.col("hub"), "left")
    others = marked.where("hub is null").select("a", "b").join(least.where(~hub).select(key, "least"), key)
    return marked.where("hub is not null").select("a", "b", F.col("of_hub").alias("least")).unionByName(others)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    joined = _with_least(both, "a", "b", 2 * total).where("b > a")
    return joined.select(F.least("a", "least").alias("a"), "b").where("a <> b")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. Edges have a < b."""
    joined = _with_least(edges, "b", "a", total)
    least = F.col("least").alias("a")
    return joined.select(F.inline(F.array(F.struct(least, F.col("a").alias("b")), F.struct(least, "b")))).where("a <> b")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b), component being the least node.

    Loops and rows with a null end are ignored; a node with loops only gives no
    row, nor does an empty table; repeated edges count once. A hub with a third of all edges
    is many tasks' work, once there are more than `TASK_EDGES`. Every round is written to the shared checkpoint folder.
    """
    stars = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    total, before = stars.count(), None
    stars = _held(stars, total)
    for _ in range(MOST_ROUNDS):
        # Stars are the fixed point: every node has one link, to a node without one.
        stars = _held(checkpointed(_held(_small_star(_large_star(stars, total).distinct(), total).distinct(), total)), total)
        state = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if state == before:
            return stars.select(F.col("b").alias("node"), F.col("a").alias("component")).union(stars.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        before, total = state, state["n"]
    raise RuntimeError(f"components have not converged in {MOST_ROUNDS} rounds")
