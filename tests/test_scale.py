"""Operators that work by rounds over whole graphs and fields, against plain sequential ones."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellscope.operators import areas, chains, graph, growth, nearest, raster


def plain_bridges(edges):
    near, order, low, out = {}, {}, {}, set()
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for root in near:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack = [(root, None, iter(near[root]))]
        while stack:
            node, up, rest = stack[-1]
            for other in rest:
                if other == up:
                    continue
                if other in order:
                    low[node] = min(low[node], order[other])
                else:
                    order[other] = low[other] = len(order)
                    stack.append((other, node, iter(near[other])))
                    break
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[node])
                    if low[node] > order[stack[-1][0]]:
                        out.add((min(stack[-1][0], node), max(stack[-1][0], node)))
    return out


def test_bridges_of_one_large_component(spark):
    r, n = random.Random(5), 4000
    edges = {(r.randrange(max(0, i - 6), i), i) for i in range(1, n)} | {(i, min(n - 1, i + 1 + r.randrange(3))) for i in range(n - 1) if r.random() < 0.15}
    edges |= {(0, n + i) for i in range(600)} | {(n + 2 * i, n + 2 * i + 1) for i in range(60)}  # a hub, some of whose leaves are tied in pairs
    df = spark.createDataFrame([(a, b) for a, b in edges if a != b], "a long, b long")
    found = {tuple(x) for x in graph.bridges(graph.undirected(df)).collect()}
    assert found == plain_bridges(edges) and len(found) > 1000
    tree, roots = graph.spanning_forest(graph.undirected(df))
    assert tree.count() == n + 599 and roots.count() == 1


def test_bridges_are_few_jobs_and_hold_in_parts(spark, monkeypatch):
    r, n = random.Random(8), 3000
    rings = {(k, k + 1) if k % 12 < 11 else (k - 11, k) for k in range(1200)} | {(1200 + t, 1201 + t) for t in range(99)}
    rings |= {(12 * t + k, 1200 + t) for t in range(100) for k in ((0, 6) if t % 3 == 0 else (0,))} | {(40, 1000)}
    mixed = {(r.randrange(max(0, i - 6), i), i) for i in range(1, n)} | {(i, i + 1 + r.randrange(3)) for i in range(n - 4) if r.random() < 0.4}
    below = {(a - 1500, b - 1500) for a, b in mixed if b < 1000}
    walked, walks = [], graph._walked_bridges
    monkeypatch.setattr(graph, "_walked_bridges", lambda e: walked.append(e) or walks(e))
    # A long road, and two rings that two edges tie, which lie apart until each ring is one node.
    road = {(i, i + 1) for i in range(20, 600)} | {(9, 20), (0, 5000), (1, 5001)} | {(k + i, k + i + 1) for k in (0, 5000) for i in range(9)} | {(0, 9), (5000, 5009)}
    # All in one part, a round of parts before it, and walks around what is left.
    for name, edges, chunk in (("rings", rings, 1_000_000), ("below", below, 1_000_000), ("parts", rings, 1000), ("walks", road, 250)):
        want = plain_bridges(edges)
        assert 20 < len(want) < len(edges) - 20
        monkeypatch.setattr(graph, "CHUNK", chunk)
        df = graph.undirected(spark.createDataFrame(list(edges), "a long, b long"))
        spark.sparkContext.setJobGroup(f"bridges {name}", "")
        found = [tuple(x) for x in graph.bridges(df).collect()]
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"bridges {name}"))
        assert len(found) == len(want) and set(found) == want
        assert chunk < 1_000_000 or 0 < jobs < 20
        assert len(walked) == (name == "walks")


def test_bridges_of_nothing_and_of_strings(spark):
    empty = spark.createDataFrame([], "a long, b long, w double")
    assert graph.bridges(empty).count() == 0 and graph.components(empty).count() == 0
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "d", 1.0)], "a string, b string, w double")
    assert [tuple(x) for x in graph.bridges(df).collect()] == [("c", "d")]


def test_upstream_sums_of_a_forest(spark):
    r, n = random.Random(2), 3000
    down = [None if i % 1000 == 0 else i - 1 if i % 3 else r.randrange(i - i % 1000, i) for i in range(n)]
    total = [i + 1 for i in range(n)]
    for i in range(n - 1, -1, -1):
        if down[i] is not None:
            total[down[i]] += total[i]
    df = spark.createDataFrame([(i, down[i], i + 1) for i in range(n)], "node long, down long, w long")
    assert {x["node"]: x["total"] for x in chains.upstream_sums(df).collect()} == dict(enumerate(total))
    with pytest.raises(ValueError, match="circle"):
        chains.upstream_sums(spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, None, 1)], df.schema))


def test_flow_along_a_long_path_takes_few_tables(spark, monkeypatch):
    n, written = 10_000, []
    monkeypatch.setattr(chains, "durable", lambda df: written.append(1) or durable(df))
    durable = raster.durable
    path = spark.range(n).select(F.lit(0).alias("row"), F.col("id").cast("int").alias("col"), F.lit(0).alias("dr"), F.lit(1).alias("dc"))  # the last cell points out of the raster
    acc = raster.flow_accumulation(path)
    assert acc.filter("cells <> col + 1").count() == 0 and acc.count() == n
    assert len(written) <= 2 * n.bit_length() + 2


def test_chains_and_rings(spark):
    r = random.Random(3)
    ids = list(range(400))
    r.shuffle(ids)
    rings = [ids[:1], ids[1:3], ids[3:150], ids[150:]]
    links = spark.createDataFrame([(ring[i], ring[(i + 1) % len(ring)]) for ring in rings for i in range(len(ring))], "node long, next long")
    assert {x["node"]: x["leader"] for x in chains.ring_leaders(links).collect()} == {n: min(ring) for ring in rings for n in ring}
    cut = links.withColumn("next", F.when(~F.col("node").isin([ring[-1] for ring in rings]), F.col("next"))).withColumn("n", F.lit(1))
    assert {x["node"]: x["n"] for x in chains.along(cut, {"n": lambda a, b: a + b}).collect()} == {n: len(ring) - i for ring in rings for i, n in enumerate(ring)}
    with pytest.raises(ValueError, match="no end"):
        chains.along(links.withColumn("n", F.lit(1)), {"n": lambda a, b: a + b})


def test_nearest_on_skewed_places(spark):
    rng = np.random.default_rng(0)
    near = lambda n: np.concatenate([rng.normal(22, 0.001, (n // 2, 2)), rng.normal(-60, 0.0005, (n // 4, 2)) + [0, 120], np.repeat([[10.0, 179.9999]], n // 8, 0), rng.uniform(-80, 80, (n // 8, 2)) * [1, 2.2]])
    points, targets = near(1600), near(2400)
    df = lambda a: spark.createDataFrame(pd.DataFrame({"k": range(len(a)), "lat": a[:, 0], "lon": a[:, 1]}))
    got = nearest.nearest_k(df(points), df(targets), 3).toPandas().sort_values(["k", "rank"])
    d = nearest.haversine(points[:, 0][:, None], points[:, 1][:, None], targets[:, 0][None], targets[:, 1][None])
    best = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert got["d"].to_numpy().reshape(-1, 3) == pytest.approx(np.take_along_axis(d, best, 1), abs=1e-9)
    assert (got["t"].to_numpy().reshape(-1, 3) == best).mean() > 0.999
    # Far fewer distances are computed than there are pairs.
    leaves = nearest.Leaves(*(lambda b: (b, b, np.ones(len(b), int)))(nearest.unit_vectors(targets[:, 0], targets[:, 1])))
    at, _ = leaves.candidates(nearest.unit_vectors(points[:64, 0], points[:64, 1]), 1)
    assert len(at) < 64 * 20
    assert nearest.nearest_k(df(points), df(targets).limit(0), 1).count() == 0
    few = nearest.nearest_k(df(points[:5]), df(targets[:2]).withColumn("lat", F.when(F.col("k") == 0, F.col("lat"))), 3)
    assert sorted(tuple(x)[:3] for x in few.collect()) == [(i, 1, 0) for i in range(5)]


def test_growth_by_demand(spark):
    masks = [np.zeros((6, 6), int)]
    for gain in (3, 4, 8):
        after = masks[-1].copy()
        after.ravel()[np.flatnonzero(after.ravel() == 0)[:gain]] = 1
        masks.append(after)
    rows = [(2010 + 3 * t, y, x, float(m[y, x])) for t, m in enumerate(masks) for y in range(6) for x in range(6)]
    df = spark.createDataFrame(rows, "year int, row int, col int, v double")
    assert raster.markov_demand(df).first()[0] == 5
    assert raster.markov_demand(df.filter("year < 2015")).first()[0] == 3 and raster.markov_demand(df.filter("year < 2017")).first()[0] == 4  # 3.5 to the even number
    assert raster.markov_demand(df.filter("year < 2011")).first()[0] == 0 and raster.markov_demand(df.limit(0)).first()[0] == 0
    lone = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (0, 5, 0.0)], "row int, col int, v double")
    p = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.8), (0, 5, 0.84)], "row int, col int, p double")
    turned = lambda w: {(r["row"], r["col"]) for r in raster.ca_step(lone, p, 1, w).filter("v = 1").collect()}
    assert turned(0.5) == {(0, 0), (0, 1)} and turned(0.0) == {(0, 0), (0, 5)}  # a cell without urban neighbours can turn


def test_hindcast_of_a_rule_that_holds(spark):
    cells = [(y, x, x < 4, x < 8, x < 12, float(x)) for y in range(12) for x in range(16)]
    df = spark.createDataFrame(cells, "row int, col int, first boolean, middle boolean, last boolean, east double")
    got = growth.hindcast(df, ["east"], steps=1, trees=10, depth=3).first()
    assert got["demand"] == 48 and 0.0 <= got["merit"] <= 1.0 and got["kappa"] <= 1.0


def test_components_of_long_paths_take_few_tables(spark, monkeypatch):
    n, written, plain = 20_000, [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df, *a: written.append(1) or plain(df, *a))
    path = spark.range(n).filter("id % 10000 < 9999").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = graph.components(path)
    assert found.filter("component <> floor(node / 10000) * 10000").isEmpty() and found.count() == n and len(written) <= 7
    named = path.select(*[F.struct(F.lit("x").alias("kind"), F.col(c).alias("k")).alias(c) for c in ("a", "b")])
    found = graph.components(named)
    assert found.filter("component.k <> floor(node.k / 10000) * 10000").isEmpty() and found.count() == n and len(written) <= 16


def test_rings_are_joined_without_broadcast(spark, monkeypatch):
    plans = []
    for module in (raster, areas, chains):
        monkeypatch.setattr(module, "durable", lambda df, *a, plain=module.durable: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, *a))
    cells = spark.range(60).select((F.col("id") / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col")).filter("(row * 5 + col * 3) % 7 > 1")
    found = raster.outlines(cells, 8)
    assert found.agg(F.sum("area")).first()[0] == cells.count()
    ways = spark.range(24).select(F.col("id").alias("k"), F.array("id", F.floor(F.col("id") / 6) * 6 + (F.col("id") + 1) % 6).alias("refs"))
    rings = areas.rings(ways.select(F.floor(F.col("k") / 6).alias("relation"), F.col("k").alias("way"), F.lit("outer").alias("role")), ways)
    assert {r["relation"]: len(r["refs"]) for r in rings.collect()} == {i: 7 for i in range(4)}
    plans += [d._jdf.queryExecution().executedPlan().toString() for d in (found, rings)]
    assert len(plans) > 12 and not any("BroadcastHashJoin" in p for p in plans)
