"""Joins by distance on tables in which many points share a place, at sizes that no estimate shows."""

from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellscope.functions import streets
from cellscope.operators import graph, grid, growth, nearest, network, raster, sight, siting, spatial_joins
from cellscope.plans import q_field, q_network


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def crowded(spark):
    """Ninety points at thirty places."""
    rng = np.random.default_rng(3)
    at = np.repeat(rng.uniform([22.5, 75.6], [22.54, 75.64], (30, 2)), 3, 0)
    p = pd.DataFrame({"k": range(len(at)), "lat": at[:, 0], "lon": at[:, 1], "tag": range(len(at))})
    return p, spark.createDataFrame(p)


def test_points_near_segments_without_broadcast(spark, crowded):
    p, df = crowded
    s = pd.DataFrame([(i, a, b, a + 0.003, b + 0.002) for i, (a, b) in enumerate(p[["lat", "lon"]].to_numpy()[:12] + 0.0004)] * 2, columns=["k", "lat1", "lon1", "lat2", "lon2"])
    found = spatial_joins.near_segments(df, spark.createDataFrame(s), 150.0)
    kx = np.cos(np.radians(p.lat.to_numpy()))[:, None] * 111_320.0
    ax, ay = (s.lon1.to_numpy() - p.lon.to_numpy()[:, None]) * kx, (s.lat1.to_numpy() - p.lat.to_numpy()[:, None]) * 111_320.0
    dx, dy = (s.lon2 - s.lon1).to_numpy() * kx, (s.lat2 - s.lat1).to_numpy() * 111_320.0
    t = np.clip(-(ax * dx + ay * dy) / (dx * dx + dy * dy), 0, 1)
    near = (np.hypot(ax + t * dx, ay + t * dy) <= 150.0).any(1)
    assert found.columns == df.columns and sorted(r["k"] for r in found.collect()) == np.flatnonzero(near).tolist() and 0 < near.sum() < len(p)
    assert "BroadcastHashJoin" not in plan(found)


def test_disc_counts_without_broadcast(spark, crowded):
    _, df = crowded
    named = df.select(F.concat_ws(":", F.lit("c"), "k").alias("k"), "lat", "lon")
    kinds = df.withColumn("tag", F.col("k") % 2)
    found = grid.disc_counts(named, kinds, "tag")
    rows = grid.indexed(df, 8).withColumn("across", F.lit(36 / 4**8 * 111_320.0) * F.cos(F.radians(F.bround("lat", 0)))).toPandas()
    step = 36 / 4**8 * 111_320.0
    want = {}
    for a in rows.itertuples():
        inside = ((rows.row - a.row) * step) ** 2 + ((rows.col - a.col) * a.across) ** 2 <= 400.0**2
        for tag, n in (rows.k[inside] % 2).value_counts().items():
            want[f"c:{a.k}", tag] = n
    assert {(r["k"], r["tag"]): r["cnt"] for r in found.collect()} == want and max(want.values()) > 3
    assert "BroadcastHashJoin" not in plan(found)


def test_clusters_of_crowded_places_by_few_rows(spark, crowded, monkeypatch):
    p, df = crowded
    p = pd.concat([p, p.assign(k=p.k + len(p))], ignore_index=True)
    written, plain = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda d: written.append(plain(d)) or written[-1])
    many = spark.createDataFrame(p).select(F.lit("x").alias("kind"), (F.col("k") * 37 % 181).alias("seq"), "lat", "lon")
    found = {r["seq"]: r["cluster"] for r in graph.greedy_clusters(many, 900.0, "kind").collect()}
    starts, want = [], {}
    for r in p.assign(seq=p.k * 37 % 181).sort_values("seq").itertuples():
        far = [nearest.haversine(a, b, r.lat, r.lon) * 1000 for a, b in starts]
        want[r.seq] = next((i for i, d in enumerate(far) if d <= 900.0), len(starts))
        if want[r.seq] == len(starts):
            starts.append((r.lat, r.lon))
    assert found == want and len(starts) > 3
    assert spark.read.parquet(written[0].stored_at).count() == 30  # places, not points


def test_ponds_with_equal_keys(spark):
    rows = [(7, 22.5, 75.6, 90, 1.0), (7, 22.6, 75.7, 50, 1.0), (8, 22.5, 75.6, 40, 2.0), (9, 22.6001, 75.7, 60, 0.5)]
    got = siting.retention_ponds(spark.createDataFrame(rows, "k long, lat double, lon double, accum int, depth double"), 100.0).collect()
    assert [(r["k"], r["lat"], r["cells"]) for r in got] == [(7, 22.5, 2), (9, 22.6001, 2)]


def test_pairs_are_of_places(spark, crowded):
    p, df = crowded
    d = nearest.haversine(p.lat.to_numpy()[:, None], p.lon.to_numpy()[:, None], p.lat.to_numpy()[None], p.lon.to_numpy()[None])
    pairs = spatial_joins.place_pairs(df, df, 1.0)
    assert pairs.count() == (d[::3, ::3] <= 1.0).sum() and "BroadcastHashJoin" not in plan(pairs)
    assert {(r["k"], r["t"]) for r in spatial_joins.within(df, df, 1.0).collect()} == set(zip(*map(np.ndarray.tolist, np.nonzero(d <= 1.0)), strict=True))
    first = sight.nearest_within(df, df.filter("k % 3 > 0"), 1.0)
    assert {r["k"]: r["t"] for r in first.collect()} == {k: k // 3 * 3 + 1 for k in range(len(p))} and "BroadcastHashJoin" not in plan(first)


def test_parallel_pairs_of_lines_on_one_course(spark, crowded):
    p, _ = crowded
    s = p.assign(lat1=p.lat, lon1=p.lon, lat2=p.lat + 0.001 * (p.k // 3 % 4 + 1), lon2=p.lon + 0.002)[["k", "lat1", "lon1", "lat2", "lon2"]]
    found = spatial_joins.parallel_pairs(spark.createDataFrame(s), 50.0, 1500.0, 20.0)
    rows = {(r["a"], r["b"]): r["metres"] for r in found.collect()}
    lat, lon = (s.lat1 + s.lat2).to_numpy() / 2, (s.lon1 + s.lon2).to_numpy() / 2
    metres = nearest.haversine(lat[:, None], lon[:, None], lat[None], lon[None]) * 1000
    r1, r2, d = np.radians(s.lat1.to_numpy()), np.radians(s.lat2.to_numpy()), np.radians((s.lon2 - s.lon1).to_numpy())
    way = np.degrees(np.arctan2(np.sin(d) * np.cos(r2), np.cos(r1) * np.sin(r2) - np.sin(r1) * np.cos(r2) * np.cos(d))) % 180
    turn = np.abs(way[:, None] - way[None])
    near = (metres >= 50) & (metres <= 1500) & (np.minimum(turn, 180 - turn) <= 20) & (s.k.to_numpy()[:, None] < s.k.to_numpy()[None])
    assert set(rows) == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True)) and rows
    assert rows == pytest.approx({ab: metres[ab] for ab in rows}) and found.count() == len(rows) and "BroadcastHashJoin" not in plan(found)


def test_parallel_pairs_are_not_shuffled(spark):
    rng = np.random.default_rng(9)
    at = rng.uniform([22.5, 75.6], [22.56, 75.66], (40, 2)).repeat(np.where(np.arange(40) < 2, 150, 2), 0)  # two courses of several lists
    s = pd.DataFrame({"k": rng.permutation(len(at)), "lat1": at[:, 0], "lon1": at[:, 1], "lat2": at[:, 0] + 0.002, "lon2": at[:, 1] + 0.001})
    found = spatial_joins.parallel_pairs(spark.createDataFrame(s), 0.0, 1800.0, 30.0, (4, 3))
    above, *rest = plan(found).split("SortMergeJoin")  # before it runs, when there is one plan
    lat, lon = (s.lat1 + s.lat2).to_numpy() / 2, (s.lon1 + s.lon2).to_numpy() / 2
    metres = nearest.haversine(lat[:, None], lon[:, None], lat[None], lon[None]) * 1000
    a, b = np.nonzero((metres <= 1800) & (s.k.to_numpy()[:, None] < s.k.to_numpy()[None]))
    rows = {(r["a"], r["b"]): r["metres"] for r in found.collect()}
    assert rows == pytest.approx({(int(s.k[i]), int(s.k[j])): metres[i, j] for i, j in zip(a, b, strict=True)}, abs=1e-3) and found.count() == len(a)
    assert above.count("Generate") == 2 and "round" not in above.split("Generate")[0] + above.split("Generate")[1]  # figures are rounded once for two courses
    assert "ASIN" in rest[0] and not any("ASIN" in x.split("\n", 1)[1] for x in rest)  # distances belong to the last join: no pair is shuffled


def test_zones_round_the_binary_value(spark, tmp_path):
    # Places 75.6 + 150 / 10000 = 75.615 and so on: their hundredfold is a half or just beside it, whatever their decimals say.
    keys = [k for k in range(4000) if k * 6007 % 100 == 50] * 3
    pd.DataFrame({"c_custkey": keys}).to_parquet(tmp_path / "customer.parquet")
    got = {(r["lat"], r["lon"]): r["n"] for r in q_network.drain_upgrades(spark, str(tmp_path)).collect()}
    want = Counter((np.rint((22.5 + k * 7919 % 4000 / 10000) * 100) / 100, np.rint((75.6 + k * 6007 % 4000 / 10000) * 100) / 100) for k in keys)
    assert got == {z: n for z, n in want.items() if n >= 3}


def test_bands_are_joined_once_for_each_pixel(spark, tmp_path):
    n = 3000
    line = pd.DataFrame({"l_orderkey": [1517 * i + 5 for i in range(n)], "l_linenumber": [i % 5 for i in range(n)], "l_quantity": np.arange(n) % 50 * 1.0})
    line.to_parquet(tmp_path / "lineitem.parquet")
    pixel = next(k for k in range(1, 2000) if k % 37 == 5 and k * 3 % 41 == 5)
    pd.DataFrame({"c_custkey": [pixel + 1517 * i for i in range(50)]}).to_parquet(tmp_path / "customer.parquet")
    df = q_field.pixel_bands(spark, str(tmp_path))
    own = lambda i: line[line.l_linenumber == i].l_quantity.max()
    assert [tuple(r)[1:] for r in df.collect()] == [tuple(own(i) for i in range(1, 5))] * 50
    above = plan(df).split("Join")[0]
    assert "Aggregate" not in above  # nothing is left to aggregate after the join


def test_neighbours_of_cells_are_not_broadcast(spark):
    r = spark.range(36).select((F.col("id") / 6).cast("int").alias("row"), (F.col("id") % 6).cast("int").alias("col"), (F.col("id") * 7 % 11).cast("double").alias("v"))
    assert "BroadcastHashJoin" not in plan(raster.flow_direction(r, 0.0))


def test_pairs_are_drawn_out_after_the_last_join(spark, crowded):
    p, _ = crowded
    df = spark.createDataFrame(p[["k", "lat", "lon"]])
    above = plan(spatial_joins.within(df, df, 1.0)).split("SortMergeJoin")[0]
    assert above.count("Generate") == 2 and "Exchange" not in above.split("Generate")[0]  # lists are shuffled, pairs are not


def test_crowds_at_one_place_share_a_disc(spark):
    events = spark.createDataFrame([(k, 22.0, 75.0, 400 + k) for k in range(300)], "k long, lat double, lon double, people int")
    rows = [(t, 22.0 + t % 4 * 1e-4, 75.0, 0.5 + t % 7) for t in range(200)]
    found = sight.crowd_spread(events, spark.createDataFrame(rows, "t long, lat double, lon double, area double"))
    reach = {r["k"]: r["r"] for r in events.select("k", streets.crowd_radius(F.col("people")).alias("r")).collect()}
    metres = {i: float(nearest.haversine(np.array(22.0), np.array(75.0), np.array(22.0 + i * 1e-4), np.array(75.0))) * 1000 for i in range(4)}
    for e in found.collect():
        left, n = 400.0 + e["k"], 0
        for d, t, area in sorted((metres[t % 4], t, area) for t, _, _, area in rows):
            if d <= reach[e["k"]]:
                left, n = left - min(left * (1 - d / reach[e["k"]]) * 0.3, area * 6), n + 1
        assert e["segments"] == n > 0 and e["placed"] == pytest.approx(400.0 + e["k"] - left, abs=1e-6)
    assert found.count() == 300 and plan(found).count("collect_list(named_struct(t") <= 2  # once for a place of segments, not for an event


def test_two_places_of_a_radius_graph_meet_once(spark, crowded):
    p, df = crowded
    d = nearest.haversine(*(p[c].to_numpy()[:, None] for c in ("lat", "lon")), *(p[c].to_numpy()[None] for c in ("lat", "lon")))
    near = (d <= 1.0) & (p.k.to_numpy()[:, None] < p.k.to_numpy()[None])
    found = network.radius_graph(df, 1.0, 6)
    assert sorted((r["a"], r["b"]) for r in found.collect()) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))
    assert "round" not in plan(found).split("SortMergeJoin")[0]


def test_crowded_places_meet_in_short_lists_over_all_tasks(spark):
    p = pd.DataFrame({"k": range(2400), "lat": 22.5 + np.arange(2400) % 3 * 1e-4, "lon": 75.6})
    df = spark.createDataFrame(p)
    lists = spatial_joins._lists(df, "ks", ["lat", "lon"])
    assert sorted(k for r in lists.collect() for k in r["ks"]) == list(range(2400)) and max(len(r["ks"]) for r in lists.collect()) < 200
    found = network.radius_graph(df, 0.015, 6)  # the first and last place are too far apart
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.count() == 3 * 800 * 799 // 2 + 2 * 800 * 800 and found.filter("a >= b").isEmpty()


def test_metapaths_are_not_shuffled(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b)) for a, b in zip(rng.integers(0, 40, 150), rng.integers(0, 12, 150), strict=True)] + [(1, None), (None, 3)]
    found = network.metapaths(spark.createDataFrame(rows, "thing long, street long"))
    of = {t: {s for x, s in rows if x == t and s is not None} for t in range(40)}
    assert sorted(map(tuple, found.collect())) == [(a, b) for a in range(40) for b in range(a + 1, 40) if of[a] & of[b]]
    assert "Exchange" not in plan(found).split("SortMergeJoin")[0]


def test_metapaths_of_streets_with_several_lists(spark):
    rng = np.random.default_rng(7)
    rows = [(int(a), int(b)) for a, b in zip(rng.integers(0, 300, 900), rng.integers(0, 5, 900), strict=True)]
    found = network.metapaths(spark.createDataFrame(rows, "thing long, street long"))
    above, below = plan(found).split("SortMergeJoin")  # before it runs, when there is one plan
    sides = below.split("Exchange hashpartitioning(street")
    of = {t: {s for x, s in rows if x == t} for t in range(300)}
    assert sorted(map(tuple, found.collect())) == [(a, b) for a in range(300) for b in range(a + 1, 300) if of[a] & of[b]]
    assert above.count("Generate") == 2 and len(sides) == 3 and "aggregate(" in sides[0] and "aggregate(" not in sides[2]  # lists are shuffled, marks and pairs are not


def test_parallel_roads_of_many_lines_on_one_course(spark, tmp_path):
    rng = np.random.default_rng(4)
    k = np.concatenate([np.arange(400) * 8, np.arange(400) * 8 + 2])  # the second half is of another class
    pd.DataFrame({"o_orderkey": k, "o_custkey": rng.choice([0, 4, 7, 4000, 4004], len(k)) + rng.integers(0, 2, len(k)) * 1000}).to_parquet(tmp_path / "orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    df = q_network.parallel_roads(spark, str(tmp_path))
    found = sorted(map(tuple, df.collect()))
    assert found == sorted(con.execute(q_network.QUERIES["parallel_roads"][1]).fetchall()) and len(found) > 1000
    above = plan(df).split("SortMergeJoin")[0]
    assert above.count("Generate") == 2 and "Exchange" not in above and "round" not in above  # courses meet, lists are drawn out last


def test_dual_pairs_are_not_shuffled(spark):
    rng = np.random.default_rng(2)
    edges = [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(rng.integers(0, 9, 60), rng.integers(0, 9, 60), strict=True))] + [(60, None, 3), (61, 3, None), (62, None, None)]
    found = growth.dual(spark.createDataFrame(edges, "k long, u long, v long"))
    ends = [{u, v} - {None} for _, u, v in edges]
    assert sorted(map(tuple, found.collect())) == [(a, b) for a in range(63) for b in range(a + 1, 63) if ends[a] & ends[b]]
    assert "Exchange" not in plan(found).split("SortMergeJoin")[0]
