"""Graph operators on edge tables: building, degrees, components, bridges, betweenness, closeness, clustering."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..session import discard, durable
from . import chains, tables
from .chains import hub_join

BROADCAST_EDGES = 5_000_000  # 60 bytes each on a worker


def undirected(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``a, b, w`` with a < b: loops dropped, the least weight of parallel edges, never under 0.1."""
    w = F.greatest(F.lit(0.1), F.col(weight)) if weight else F.lit(1.0)
    return edges.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(w).alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def degrees(edges: DataFrame) -> DataFrame:
    """``node, degree, centrality``: the number of neighbours, and its share of all other nodes."""
    d = both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    n = d.count()
    return d.withColumn("centrality", F.col("degree") / F.lit(float(max(1, n - 1))))


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


CHUNK = 1_000_000  # edges that a task joins at a time, some 100 bytes each


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every node but the least of each group that edges u, v hold together: the node, and that least one."""
    names, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = codes[: len(u)], codes[len(u) :]
    least = np.arange(len(names))
    while len(a):
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while (least[least] != least).any():
            least = least[least]
        apart = least[a] != least[b]
        a, b = a[apart], b[apart]
    moved = np.flatnonzero(least != np.arange(len(names)))
    return names[moved], names[least[moved]]


def _joined_nearby(edges: DataFrame) -> DataFrame:
    """Edges ``u > v`` of whole numbers as stars of what each part of a task's edges holds together.

    Edges are cut in ranges by their ends, which puts those that follow each other along a street in one task, and a hub's in several. What is
    connected stays so, and no node is lost; there are at most as many edges as nodes in each part.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def joined() -> pa.RecordBatch:
            u, v = _stars(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= CHUNK:
                yield joined()
                held, n = [], 0
        if held:
            yield joined()

    kind = edges.schema["u"].dataType.simpleString()
    return edges.repartitionByRange("v", "u").mapInArrow(stars, f"u {kind}, v {kind}")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of every node of ``edges(a, b)``, by alternating large-star and small-star rounds.

    Nodes that aren't whole numbers are numbered in their order; edges that lie in one task are joined there first. Edges only ever move towards smaller labels, so the rounds grow with the logarithm of a component's
    diameter. Hubs are joined by broadcast, so that a component of any size is spread over tasks. Null ends and loops take no
    part; repeated edges count once.
    """
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    known = ends.filter("a is not null and b is not null and a <> b")
    if not isinstance(known.schema["u"].dataType, (T.LongType, T.IntegerType)):
        known = durable(known.distinct())
        nodes = known.select(F.col("u").alias("node")).unionByName(known.select(F.col("v").alias("node"))).distinct()
        ids = durable(tables.sequential_ids(nodes, ["node"], "id").select("node", F.col("id").cast("long").alias("id")))
        of = lambda n, i: ids.select(F.col("node").alias(n), F.col("id").alias(i)).hint("merge")
        coded = components(known.join(of("u", "a"), "u").join(of("v", "b"), "v").select("a", "b")).withColumnRenamed("node", "id")
        return coded.join(of("node", "id"), "id").select("node", F.col("component").alias("least")).join(of("component", "least"), "least").select("node", "component").hint("merge")
    now = durable(_joined_nearby(known).distinct())
    state = _state(now)
    while state[0]:
        middle = durable(_large_star(now, state[0]))
        discard(now)
        now = durable(_small_star(middle, state[0]))
        discard(middle)
        before, state = state, _state(now)
        if state == before:
            break
    tops = now.select(F.col("v").alias("node")).distinct()
    # No size on disk shows what a broadcast of the labels would take.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.withColumn("component", F.col("node"))).hint("merge")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b``: edges that join each component as a tree, and ``node``: one root of each tree.

    Every round each group of nodes picks, in an order by hash, its first edge to another group; groups that
    picks join become one. There are half as many groups or fewer after each round.
    """
    live = durable(edges.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"), F.struct(F.xxhash64("a", "b").alias("h"), "a", "b").alias("e")))
    nodes = live.select(F.col("u").alias("node")).unionByName(live.select(F.col("v").alias("node"))).distinct()
    trees, hooked = live.select("e.a", "e.b").limit(0), nodes.limit(0)
    n = live.count()
    while n:
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v"), "e"))
        pick = durable(both.groupBy("u").agg(F.min(F.struct("e", "v")).alias("m"), F.count("*").alias("n")).select("u", "m.e", F.col("m.v").alias("up"), "n"))
        trees = trees.unionByName(pick.select("e.a", "e.b").distinct())
        # Picks follow one order, so the only circles are two groups that picked the same edge: the smaller is their root.
        back = pick.select(F.col("u").alias("up"), F.col("up").alias("back"), "n")
        rooted = hub_join(pick.select("u", "up"), back, "up", 2 * n).select("u", F.when((F.col("back") == F.col("u")) & (F.col("u") < F.col("up")), F.col("u")).otherwise(F.col("up")).alias("up"))
        group = durable(rooted)
        hooked = hooked.unionByName(group.filter("u <> up").select(F.col("u").alias("node")))
        groups = group.count()
        while True:
            sizes = group.groupBy("up").agg(F.count("*").alias("n"))
            above = group.select(F.col("u").alias("up"), F.col("up").alias("top")).join(sizes, "up")
            jumped = durable(hub_join(group, above, "up", groups).select("u", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            still = jumped.filter("moved").isEmpty()
            group = jumped.select("u", "up")
            if still:
                break
        degree = group.join(pick.select("u", "n"), "u")
        left = hub_join(live, degree, "u", 2 * n).select(F.col("up").alias("a"), "v", "e")
        other = degree.select(F.col("u").alias("v"), F.col("up").alias("b"), "n")
        between = hub_join(left, other, "v", 2 * n).filter("a <> b").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("e").alias("e"))
        live = durable(between)
        n = live.count()
    return trees, nodes.join(hooked, "node", "left_anti")


def _tour(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, next, u, first``: the trees' edges, each in both directions, in the order of one walk around each tree.

    ``node`` is the arc (from, to) with to = u, and ``next`` the arc that leaves u for its neighbour after from, null where the walk
    ends at the root. ``first`` holds for one of the arcs into u. A node's neighbours are ordered in
    slices of some ten thousand, so that a hub isn't ordered in one task.
    """
    arcs = tree.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(tree.select(F.col("b").alias("u"), F.col("a").alias("v")))
    arcs = durable(arcs)
    most = arcs.groupBy("u").count().agg(F.max("count")).first()[0] or 0
    own = arcs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(1 + most // 50_000)))
    order = Window.partitionBy("u", "s").orderBy("v")
    within = own.withColumns({"after": F.lead("v").over(order), "n": F.row_number().over(order)})
    heads = own.groupBy("u", "s").agg(F.min("v").alias("head"))
    around = Window.partitionBy("u").orderBy("s")
    heads = heads.withColumns({"then": F.lead("head").over(around), "start": F.first("head").over(around), "slice": F.row_number().over(around)})
    met = within.join(heads, ["u", "s"]).join(roots.select(F.col("node").alias("u"), F.lit(True).alias("root")), "u", "left")
    following = F.coalesce("after", "then", F.when(F.col("root").isNull(), F.col("start")))
    arc = lambda a, b: F.struct(a.alias("from"), b.alias("to"))
    return met.select(arc(F.col("v"), F.col("u")).alias("node"), F.when(following.isNotNull(), arc(F.col("u"), following)).alias("next"), "u", ((F.col("n") == 1) & (F.col("slice") == 1)).alias("first"))


def _cuts(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which of the edges u, v, parallel ones included, are bridges among them: a walk in depth, and how far back each node's branch reaches."""
    names, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    m, n = len(u), len(names)
    order = np.argsort(codes, kind="stable")
    to, by = codes[(order + m) % (2 * m)].tolist(), (order % m).tolist()
    ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=n))])
    at, end = ends[:-1].tolist(), ends[1:].tolist()
    seen, low, cut, met = [-1] * n, [0] * n, np.zeros(m, bool), 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        path, via = [root], [-1]
        seen[root] = low[root] = met
        met += 1
        while path:
            x = path[-1]
            i = at[x]
            if i < end[x]:
                at[x] = i + 1
                y = to[i]
                if by[i] == via[-1]:
                    continue
                if seen[y] < 0:
                    seen[y] = low[y] = met
                    met += 1
                    path.append(y)
                    via.append(by[i])
                elif seen[y] < low[x]:
                    low[x] = seen[y]
                continue
            path.pop()
            edge = via.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[x])
                cut[edge] = low[x] > seen[path[-1]]
    return cut


def _nearby_cuts(edges: DataFrame) -> DataFrame:
    """``a, b, ea, eb`` of edges that are bridges of what a task holds, at most ``CHUNK`` at a time; for all others, with null in ``ea``, each node and the least of its block."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def told() -> pa.RecordBatch:
            a, b, ea, eb = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(4))
            cut = _cuts(a, b)
            node, least = _stars(a[~cut], b[~cut])
            gap = pa.nulls(len(node), pa.from_numpy_dtype(a.dtype))
            columns = [np.concatenate([a[cut], node]), np.concatenate([b[cut], least]), pa.concat_arrays([pa.array(ea[cut]), gap]), pa.concat_arrays([pa.array(eb[cut]), gap])]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "ea", "eb"])

        for b in batches:
            while b.num_rows:
                part = b.slice(0, CHUNK - n)
                held, n, b = [*held, part], n + part.num_rows, b.slice(part.num_rows)  # noqa: PLW2901
                if n == CHUNK:
                    yield told()
                    held, n = [], 0
        if held:
            yield told()

    kind = edges.schema["a"].dataType.simpleString()
    return edges.mapInArrow(split, ", ".join(f"{x} {kind}" for x in ("a", "b", "ea", "eb")))


def bridges(edges: DataFrame) -> DataFrame:
    """``a, b``: edges whose loss parts their component.

    With whole numbers for nodes, a task first looks at its own edges: what is no bridge among them is none at all, and the nodes that such
    edges hold together become one. Edges are cut in ranges by their ends, which puts a street's in one task. This goes on while
    a quarter of the edges goes each time; at most ``CHUNK`` that are left lie in one task and are decided there, more by walks around a forest.
    """
    given = edges.filter("a <> b").select("a", "b").distinct()
    if not isinstance(given.schema["a"].dataType, (T.LongType, T.IntegerType)):
        return _walked_bridges(given)
    now = durable(given.select("a", "b", F.col("a").alias("ea"), F.col("b").alias("eb")))
    n, before = now.count(), None
    while n > CHUNK and (before is None or n <= before * 3 // 4):
        parts = max(now.sparkSession.sparkContext.defaultParallelism, 4 * n // CHUNK + 1)
        found = durable(_nearby_cuts(now.repartitionByRange(parts, "a", "b")))
        discard(now)
        blocks = components(found.filter("ea is null").select("a", "b"))
        of = lambda c: blocks.select(F.col("node").alias(c), F.col("component").alias(f"{c}_block")).hint("merge")  # noqa: E731, B023
        a, b = (F.coalesce(f"{c}_block", c) for c in ("a", "b"))
        left = found.filter("ea is not null").join(of("a"), "a", "left").join(of("b"), "b", "left")
        now = durable(left.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "ea", "eb"))
        discard(found)
        n, before = now.count(), n
    if n <= CHUNK:
        last = durable(_nearby_cuts(now.coalesce(1)))
        discard(now)
        return last.filter("ea is not null").select(F.col("ea").alias("a"), F.col("eb").alias("b"))
    # Where two edges join the same blocks, neither is a bridge.
    lone = durable(now.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("ea").alias("ea"), F.first("eb").alias("eb")))
    walked = _walked_bridges(lone.select("a", "b"))
    return lone.filter("n = 1").join(walked.hint("merge"), ["a", "b"]).select(F.col("ea").alias("a"), F.col("eb").alias("b"))


def _walked_bridges(edges: DataFrame) -> DataFrame:
    """Bridges of any number of edges of any type, each given once.

    Every edge outside a spanning forest gets 128 bits by hash, and every node the XOR of its edges' bits. Over
    one side of a tree edge each outside edge within that side counts twice and goes; what is left are the outside edges
    that lead across, and only a bridge has none. Sides are stretches of a walk around the tree, whose XOR comes
    from the walk's ends by pointer doubling. Components of any size are spread over tasks.
    """
    tree, roots = spanning_forest(edges)
    tree = durable(tree)
    outside = edges.filter("a <> b").select("a", "b").join(tree, ["a", "b"], "left_anti")
    marks = outside.select(F.explode(F.array("a", "b")).alias("u"), F.xxhash64("a", "b", F.lit(1)).alias("x"), F.xxhash64("a", "b", F.lit(2)).alias("y"))
    marks = marks.groupBy("u").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    entered = lambda c: F.when(F.col("first"), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("long").alias(c)
    walk = _tour(tree, roots)
    # Only the first arc into a node carries its mark, so the join meets one row a node.
    marked = walk.filter("first").join(marks, "u", "left").unionByName(walk.filter("not first"), allowMissingColumns=True).select("node", "next", entered("x"), entered("y"))
    summed = chains.along(marked, {"x": lambda a, b: a.bitwiseXOR(b), "y": lambda a, b: a.bitwiseXOR(b)})
    sides = summed.groupBy(F.least("node.from", "node.to").alias("a"), F.greatest("node.from", "node.to").alias("b")).agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    return sides.filter("x = 0 and y = 0").select("a", "b")


def _path_sums(steps: DataFrame, start: DataFrame) -> DataFrame:
    """``source, node, v``: the sum of ``start(source, node, v)`` over all paths along ``steps(source, node, to)`` that end in a node.

    Steps of a source make no circle. A round moves every value one step on; what has met on a node moves on as one sum.
    """
    moving = durable(start.select("source", "node", "v"))
    parts = [moving]
    while True:
        moving = durable(moving.join(steps, ["source", "node"]).groupBy("source", F.col("to").alias("node")).agg(F.sum("v").alias("v")))
        if moving.isEmpty():
            break
        parts.append(moving)
        if len(parts) == 16:
            parts = [durable(_summed(parts))]
    return durable(_summed(parts))


def _summed(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("source", "node").agg(F.sum("v").alias("v"))


def _joined_flows(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``a, b, v``: how much of all shortest paths from ``sources(node)`` runs over each edge, by joins alone.

    With p(v) shortest paths to v from a source, and q(v) the sum of 1 / p(u) over all ways on from v to any u, a step from
    v to w of the shortest paths carries p(v) q(w). Both are sums over paths of the steps, one forward, one backward, for all sources at once.
    """
    far = reachable_within(edges, sources, float("inf"))
    ahead = far.select("source", F.col("node").alias("b"), F.col("cost").alias("there"))
    legs = far.join(both_ways(edges).withColumnRenamed("a", "node"), "node").join(ahead, ["source", "b"])
    on_way = F.abs(F.col("cost") + F.col("w") - F.col("there")) <= 1e-9 * (F.lit(1.0) + F.col("there"))
    steps = durable(legs.filter(on_way).select("source", "node", F.col("b").alias("to")))
    paths = _path_sums(steps, sources.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("v")))
    back = steps.select("source", F.col("to").alias("node"), F.col("node").alias("to"))
    onward = _path_sums(back, paths.select("source", "node", (F.lit(1.0) / F.col("v")).alias("v")))
    flow = steps.join(paths.withColumnRenamed("v", "p"), ["source", "node"]).join(onward.select("source", F.col("node").alias("to"), F.col("v").alias("q")), ["source", "to"])
    return flow.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b"), (F.col("p") * F.col("q")).alias("v"))


def betweenness(edges: DataFrame, sources: int | None = None, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """``a, b, betweenness`` of edges, weighted and normalised by the number of node pairs.

    Searches run from every node, or from ``sources`` nodes chosen by hash and scaled up. Up to ``broadcast_edges``
    the edges travel as a broadcast of flat arrays (60 bytes an edge) and searches are dealt over tasks. Larger graphs stay in tables:
    the searches of all sources advance together, by joins, a round for each step of the longest shortest path.
    """
    spark = edges.sparkSession
    if edges.count() > broadcast_edges:
        ends = both_ways(edges).select(F.col("a").alias("node")).distinct()
        n = ends.count()
        few = sources is not None and sources < n
        chosen = durable(ends.orderBy(F.xxhash64("node"), "node").limit(sources)) if few else ends
        summed = _joined_flows(edges, chosen).groupBy("a", "b").agg((F.sum("v") / max(1, n * (n - 1)) * (n / sources if few else 1.0)).alias("betweenness"))
        return edges.select("a", "b").join(summed, ["a", "b"], "left").na.fill(0.0)
    rows = edges.select("a", "b", "w").toPandas()
    codes, names = pd.factorize(pd.concat([rows["a"], rows["b"]]))
    m, n = len(rows), len(names)
    order = np.argsort(codes, kind="stable")
    first = np.searchsorted(codes[order], np.arange(n + 1))
    other = np.concatenate([codes[m:], codes[:m]])[order]
    shared = spark.sparkContext.broadcast((np.asarray(names), codes.reshape(2, m), first, other, order % max(m, 1), rows["w"].to_numpy(float)))
    nodes = both_ways(edges).select(F.col("a").alias("node")).distinct()
    if sources is not None and sources < n:
        nodes = nodes.orderBy(F.xxhash64("node"), "node").limit(sources)
    scale = 1.0 / max(1, n * (n - 1)) * (n / sources if sources is not None and sources < n else 1.0)
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, ends, first, other, edge, weight = shared.value
        place = {name: i for i, name in enumerate(names.tolist())}
        total = np.zeros(len(weight))
        for batch in batches:
            for s in batch["node"]:
                _add_flows(place[s], first, other, edge, weight, total)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"a": names[ends[0, used]], "b": names[ends[1, used]], "v": total[used]})

    flows = nodes.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, f"a {kind}, b {kind}, v double")
    summed = flows.groupBy("a", "b").agg((F.sum("v") * scale).alias("betweenness"))
    return edges.select("a", "b").join(summed, ["a", "b"], "left").na.fill(0.0)


def _add_flows(source: int, first: np.ndarray, other: np.ndarray, edge: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
    """Add one source's dependencies to its edges: shortest paths forward, shares backward."""
    dist, paths, before, done = {source: 0.0}, {source: 1.0}, {source: []}, []
    heap, closed = [(0.0, source)], set()
    while heap:
        d, v = heapq.heappop(heap)
        if v in closed:
            continue
        closed.add(v)
        done.append(v)
        around = slice(first[v], first[v + 1])
        for w, e in zip(other[around].tolist(), edge[around].tolist(), strict=True):
            far = d + weight[e]
            known = dist.get(w)
            if known is None or far < known - 1e-12:
                dist[w], paths[w], before[w] = far, paths[v], [(v, e)]
                heapq.heappush(heap, (far, w))
            elif abs(far - known) <= 1e-12 and w not in closed:
                paths[w] += paths[v]
                before[w].append((v, e))
    share = dict.fromkeys(done, 0.0)
    for w in reversed(done):
        for v, e in before[w]:
            part = paths[v] / paths[w] * (1.0 + share[w])
            share[v] += part
            total[e] += part


METRES_PER_DEGREE = 6371000.0 * math.pi / 180


def _cluster_cell(metres: float) -> tuple[float, Callable[[Column], Column]]:
    """Height of a row of cells in degrees, and the width of the cells of a row: no two points of a cell are ``metres`` apart."""
    high = metres / 1.5 / METRES_PER_DEGREE
    nearest = lambda row: F.when(row >= 0, row).otherwise(-row - 1) * F.lit(high)  # noqa: E731  the row's least latitude, where cells are widest
    return high, lambda row: F.lit(high) / F.greatest(F.lit(1e-6), F.cos(F.radians(nearest(row))))


def _reached_cells(points: DataFrame, metres: float) -> DataFrame:
    """``points`` with ``row, col`` of every cell that a circle of ``metres`` around them may touch."""
    high, wide = _cluster_cell(metres)
    reach = metres / METRES_PER_DEGREE * 1.000001
    out = points.withColumn("row", F.explode(F.sequence(F.floor((F.col("lat") - reach) / high), F.floor((F.col("lat") + reach) / high))))
    far = F.lit(reach) / F.greatest(F.lit(1e-6), F.cos(F.radians(F.least(F.lit(90.0), F.abs("lat") + reach))))
    return out.withColumn("col", F.explode(F.sequence(F.floor((F.col("lon") - far) / wide(F.col("row"))), F.floor((F.col("lon") + far) / wide(F.col("row"))))))


def greedy_clusters(points: DataFrame, metres: float, by: str) -> DataFrame:
    """``by, seq, cluster``: in the order of ``seq`` a point joins the first cluster within reach of its first point, or starts one."""
    named = _named(points, by)
    places = cluster_places(points, metres, by).withColumnRenamed(by, "g")
    return named.join(places.hint("merge"), ["g", "lat", "lon"]).select(F.col("named").alias(by), "seq", "cluster")


def _named(points: DataFrame, by: str) -> DataFrame:
    """``named, g, seq, lat, lon`` of points that have a place; a null group is a group."""
    group = F.coalesce(F.col(by).cast("string"), F.lit("\0"))
    return points.filter("lat is not null and lon is not null").select(F.col(by).alias("named"), group.alias("g"), "seq", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))


def cluster_places(points: DataFrame, metres: float, by: str) -> DataFrame:
    """``by, lat, lon, cluster`` of the places of ``greedy_clusters``, the group as text.

    Points of a group that share a place share their cluster, so their first stands for them. It starts a cluster if no
    earlier one that does is within reach. That is decided by rounds, for all groups
    at once: in each grid cell, whose points are all within reach of each other, the earliest open point starts a cluster if
    no earlier open point around it is within reach; whatever it reaches is settled. Then every place finds the
    earliest start around it. A round costs as much as there are open places. Equal ``seq`` go by place;
    points without a place take no part; reach ends at the date line.
    """
    high, wide = _cluster_cell(metres)
    row = F.floor(F.col("lat") / high)
    first_here = _named(points, by).groupBy("g", "lat", "lon").agg(F.min("seq").alias("seq")).withColumn("seq", F.struct("seq", "lat", "lon"))
    keyed = durable(first_here.withColumn("home_row", row).withColumn("home_col", F.floor(F.col("lon") / wide(F.col("home_row")))))
    far = lambda a, b: geo.haversine(F.col(f"{a}lat"), F.col(f"{a}lon"), F.col(f"{b}lat"), F.col(f"{b}lon"), 6371000.0)
    open_, starts = durable(keyed), None
    while not open_.isEmpty():
        first = open_.groupBy("g", F.col("home_row").alias("row"), F.col("home_col").alias("col")).agg(F.min(F.struct("seq", "lat", "lon")).alias("c")).select("g", "row", "col", F.col("c.seq").alias("start"), F.col("c.lat").alias("clat"), F.col("c.lon").alias("clon"))
        near = durable(_reached_cells(open_.select("g", "seq", "lat", "lon"), metres).hint("merge").join(first, ["g", "row", "col"]).filter(far("", "c") <= metres).select("g", "seq", "start", "clat", "clon"))
        blocked = near.filter(F.col("seq") < F.col("start")).select("g", "start").distinct()
        new = durable(near.filter(F.col("seq") == F.col("start")).select("g", "start", "clat", "clon").join(blocked, ["g", "start"], "left_anti"))
        settled = near.join(new.select("g", "start"), ["g", "start"], "left_semi").select("g", "seq").distinct()
        after = durable(open_.join(settled, ["g", "seq"], "left_anti"))
        discard(open_)
        discard(near)
        open_, starts = after, new if starts is None else starts.unionByName(new)
    if starts is None:
        return keyed.select(F.col("g").alias(by), "lat", "lon", F.lit(0).cast("long").alias("cluster"))
    numbered = tables.sequential_ids(starts, ["g", "start"], "place")
    lowest = numbered.groupBy("g").agg(F.min("place").alias("low"))
    numbered = numbered.join(lowest, "g").select("g", "start", "clat", "clon", (F.col("place") - F.col("low")).cast("long").alias("cluster"))
    homes = numbered.withColumn("row", F.floor(F.col("clat") / high)).withColumn("col", F.floor(F.col("clon") / wide(F.col("row"))))
    met = _reached_cells(keyed.select("g", "lat", "lon"), metres).hint("merge").join(homes, ["g", "row", "col"]).filter(far("", "c") <= metres)
    return met.groupBy(F.col("g").alias(by), "lat", "lon").agg(F.min("cluster").alias("cluster"))


def reachable_within(edges: DataFrame, sources: DataFrame, limit: float) -> DataFrame:
    """``source, node, cost``: nodes within a cost of each source, by relaxation until nothing changes (an isochrone).

    Each round joins only what the round before has improved; costs are positive, so there is an end.
    """
    step = durable(both_ways(edges).withColumnRenamed("a", "node"))
    best = durable(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("cost")))
    edge = best
    while not edge.isEmpty():
        new = edge.join(step, "node").select("source", F.col("b").alias("node"), (F.col("cost") + F.col("w")).alias("cost")).filter(F.col("cost") <= limit)
        both = best.withColumn("old", F.lit(1)).unionByName(new.withColumn("old", F.lit(0)))
        merged = durable(both.groupBy("source", "node").agg(F.min("cost").alias("cost"), F.min_by("old", F.struct("cost", -F.col("old"))).alias("old")))
        best, edge = merged.select("source", "node", "cost"), merged.filter("old = 0").select("source", "node", "cost")
    return best


def ranked(df: DataFrame, column: str, key: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(column), key)))


def closeness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``node, closeness`` of the source nodes: nodes reached over their total distance, scaled by the share reached.

    Every source costs a table of all nodes that it reaches; name the sources to bound that.
    """
    n = both_ways(edges).select("a").distinct().count()
    far = reachable_within(edges, sources, float("inf"))
    g = far.groupBy(F.col("source").alias("node")).agg((F.count("*") - 1).alias("m"), F.sum("cost").alias("total"))
    value = F.when(F.col("total") > 0, F.col("m") / F.col("total") * (F.col("m") / F.lit(float(max(1, n - 1))))).otherwise(0.0)
    return g.select("node", value.alias("closeness"))


def without_isolates(edges: DataFrame, least_nodes: int) -> DataFrame:
    """The edges of components that have at least so many nodes."""
    labels = components(edges)
    large = labels.groupBy("component").count().filter(F.col("count") >= least_nodes).select("component")
    return edges.join(labels.join(large.hint("merge"), "component", "left_semi").select(F.col("node").alias("a")).hint("merge"), "a", "left_semi")
