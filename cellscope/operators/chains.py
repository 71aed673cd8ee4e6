"""Pointer doubling: results along chains, rings and forests in as many rounds as the logarithm of their length.

Tables have a row per ``node``, a column of any type that can be compared, and say which node follows it. A
round lets every node look twice as far as the round before and is written to the shared folder; the round before
it is then deleted, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, durable


def hub_join(left: DataFrame, right: DataFrame, on: str | list[str], total: int) -> DataFrame:
    """``left`` joined with ``right``, which has one row per key and in ``n`` how often ``left`` has it out of ``total``.

    Keys with over a thousandth of all rows (a hundred rows at least) are at most a thousand: these rows of ``right`` are broadcast, so
    that no task gets a hot key whole. The other keys meet by shuffle. ``n`` is left out.
    """
    hot = F.col("n") > max(100, total // 1000)
    keys = [on] if isinstance(on, str) else on
    hubs, rest = F.broadcast(right.filter(hot).drop("n")), right.filter(~hot).drop("n")
    return left.join(hubs, keys).unionByName(left.join(hubs.select(*keys), keys, "left_anti").join(rest.hint("merge"), keys))


def along(links: DataFrame, folds: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """``links(node, next, values...)`` with each value folded from the node to the end of its chain.

    ``next`` is null at a chain's end, and no two nodes have the same next. A fold is associative: it takes a value and
    that of what follows. Chains that never end are an error.
    """
    now, rounds = durable(links.select("node", "next", *folds)), 0
    most = now.count().bit_length() + 1
    while not now.filter("next is not null").isEmpty():
        if rounds > most:
            raise ValueError("some chains have no end")
        ahead = now.select(F.col("node").alias("next"), F.col("next").alias("next2"), *[F.col(c).alias(f"{c}__2") for c in folds])
        # Nodes that have reached the end stay out of the join, or all of them would meet in one task.
        folded = [f(F.col(c), F.col(f"{c}__2")).alias(c) for c, f in folds.items()]
        onward = now.filter("next is not null").join(ahead.hint("merge"), "next", "left").select("node", F.col("next2").alias("next"), *folded)
        after = durable(onward.unionByName(now.filter("next is null")))
        discard(now)
        now, rounds = after, rounds + 1
    return now.drop("next")


def ring_leaders(links: DataFrame) -> DataFrame:
    """``node, leader`` of rings ``links(node, next)``: the smallest node of its ring. Every node has a next.

    A node holds the least of the nodes ahead of it; once a round changes nothing, that is the least of all.
    """
    now = durable(links.select("node", "next", F.col("node").alias("leader")))
    while True:
        ahead = now.select(F.col("node").alias("next"), F.col("next").alias("next2"), F.col("leader").alias("other"))
        met = now.join(ahead.hint("merge"), "next")
        after = durable(met.select("node", F.col("next2").alias("next"), F.least("leader", "other").alias("leader"), (F.col("other") < F.col("leader")).alias("moved")))
        discard(now)
        now = after
        if now.filter("moved").isEmpty():
            return now.select("node", "leader")


def upstream_sums(tree: DataFrame) -> DataFrame:
    """``node, total``: the sum of ``w`` over a node and all nodes above it, from ``tree(node, down, w)``.

    ``down`` is the node that this one drains into, null at an outlet. After k rounds a node holds the sum of all nodes
    less than 2^k steps above it; those exactly 2^k steps above add theirs. Nodes that run in a circle are an error.
    """
    now, rounds = durable(tree.select("node", "down", "w")), 0
    n = now.count()
    while not now.filter("down is not null").isEmpty():
        if rounds > n.bit_length():
            raise ValueError("the directions run in a circle")
        moving = now.filter("down is not null")
        gained = moving.groupBy(F.col("down").alias("node")).agg(F.sum("w").alias("more"), F.count("*").alias("n"))
        # ``met`` has a row for each node that others drain into at this distance: its gain, and where it drains itself.
        met = durable(gained.join(now.select("node", F.col("down").alias("further")).hint("merge"), "node"))
        onward = hub_join(moving.select("node", "down"), met.select(F.col("node").alias("down"), "further", "n"), "down", n).select("node", "further")
        added = now.select("node", "w").join(met.select("node", "more").hint("merge"), "node", "left").select("node", (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
        after = durable(added.join(onward.filter("further is not null").hint("merge"), "node", "left").select("node", F.col("further").alias("down"), "w"))
        discard(now)
        discard(met)
        now, rounds = after, rounds + 1
    return now.select("node", F.col("w").alias("total"))
