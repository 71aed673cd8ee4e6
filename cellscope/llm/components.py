"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two aggregations with a join on the node; edges only ever move towards smaller labels, so
the number of rounds grows with the logarithm of a component's diameter. Nodes with a large share of all
edges are joined by broadcast, so that a component of any size is spread over tasks. Every round is written
to the shared folder and the one before it deleted: lineage stays short, a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard
from ._common import hub_join, stored


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Link every larger neighbour of a node to the smallest label around the node."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return hub_join(both.filter("v > u"), least, "u", n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Takes edges with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = hub_join(edges, least, "u", n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    """Two numbers that stay the same when a round has changed nothing; the first is the number of edges."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """Return ``node, root`` for every node of ``edges(u, v)``; root is the component's smallest node.

    Null ends and loops take no part; repeated edges count once; no edges give an empty table. The
    type of u and v is free as long as it can be ordered.
    """
    now = stored(
        edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    state = _state(now)
    while state[0]:
        middle = stored(_large_star(now, state[0]), "edges")
        discard(now)
        now = stored(_small_star(middle, state[0]), "edges")
        discard(middle)
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
