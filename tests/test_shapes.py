"""Areas, outlines, tessellations, vector tiles, clusters and flows of graphs, against plain readings."""

import random
import time
from math import asin, cos, radians, sin, sqrt

import numpy as np
import pandas as pd
import pytest

from cellscope.operators import areas, graph, raster, siting, tessellation, vector_tiles


def test_rings_of_relations(spark):
    nodes = spark.createDataFrame([(i, float(i % 10), float(i // 10)) for i in range(100)], "k long, lat double, lon double")
    ways = [(1, [0, 1, 2]), (2, [12, 2]), (3, [12, 11, 10, 0]), (4, [20, 21, 31, 20]), (5, [40, 41]), (6, [41, 42]), (7, [50, 51]), (8, [51, 52]), (9, [52, 50]), (10, [50, 60]), (11, [70, 71]), (12, [71, 70]), (13, [80, 81, 91]), (14, [80, 90, 91]), (15, [3]), (16, [44, 45, 44])]
    members = {100: [(1, "outer"), (2, ""), (3, None), (4, "inner")], 101: [(5, "outer"), (6, "outer")], 102: [(7, "outer"), (8, "outer"), (9, "outer"), (10, "outer")], 103: [(11, "outer"), (12, "outer")], 104: [(13, "outer"), (14, "outer"), (14, "outer"), (4, "outer"), (99, "outer")], 105: [(15, "outer"), (16, "outer")]}
    rel = spark.createDataFrame([(k, [{"way": w, "role": r} for w, r in m], {"type": "multipolygon"} if k != 104 else {"type": "boundary", "a": "b"}) for k, m in members.items()] + [(106, [{"way": 4, "role": "outer"}], {"type": "route"}), (107, [{"way": 4, "role": "outer"}], None)], "k long, members array<struct<way: long, role: string>>, tags map<string, string>")
    w = spark.createDataFrame(ways, "k long, refs array<long>")
    flat = spark.createDataFrame([(k, a, r) for k, m in members.items() for a, r in m], "relation long, way long, role string")
    found = {(r["relation"], r["role"], r["ring"]): r["refs"] for r in areas.rings(flat, w).collect()}
    assert found == {(100, "outer", "1"): [0, 1, 2, 12, 11, 10, 0], (100, "inner", "4"): [20, 21, 31, 20], (104, "outer", "4"): [20, 21, 31, 20], (104, "outer", "13"): [80, 81, 91, 90, 80]}
    centres = {r["k"]: (r["lat"], r["lon"], r["tags"]) for r in areas.area_centres(nodes, w, rel).collect()}
    assert centres == {100: (1.0, 0.5, {"type": "multipolygon"}), 104: (0.5, 5.5, {"type": "boundary", "a": "b"})}
    assert areas.rings(flat.limit(0), w).count() == 0


def test_many_long_rings(spark):
    r, ways, members, want = random.Random(1), [], [], {}
    for k in range(12):
        n = r.randrange(3, 90)
        ids = [k * 1000 + i for i in range(n)]
        cuts = sorted(r.sample(range(n), r.randrange(2, min(n, 20) + 1)))
        for i, a in enumerate(cuts):
            b = cuts[(i + 1) % len(cuts)]
            part = [ids[j % n] for j in range(a, b + 1 if b > a else b + n + 1)]
            ways.append((len(ways), part if r.random() < 0.5 else part[::-1]))
            members.append((k, len(ways) - 1, "outer"))
        want[k] = set(ids)
    r.shuffle(ways)
    got = areas.rings(spark.createDataFrame(members, "relation long, way long, role string"), spark.createDataFrame(ways, "k long, refs array<long>")).collect()
    assert {x["relation"]: set(x["refs"]) for x in got} == want and len(got) == 12
    for x in got:
        refs = x["refs"]
        assert refs[0] == refs[-1] and len(refs) == len(want[x["relation"]]) + 1
        n = len(refs) - 1
        assert all((b - a) % n in (1, n - 1) for a, b in zip([i % 1000 for i in refs], [i % 1000 for i in refs[1:]], strict=False))


def test_outlines_add_up(spark):
    r = random.Random(6)
    mask = {(y, x) for y in range(30) for x in range(30) if r.random() < 0.6}
    mask |= {(y, x) for y in range(40, 47) for x in range(7)} - {(42, 2), (43, 3), (44, 5)}  # holes, two of them corner to corner
    df = spark.createDataFrame([(*k, 1) for k in mask], "row int, col int, n int")
    rings = raster.outlines(df, 100).collect()
    label = {}
    for start in sorted(mask):
        if start in label:
            continue
        stack = [start]
        label[start] = start
        while stack:
            y, x = stack.pop()
            for k in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if k in mask and k not in label:
                    label[k] = start
                    stack.append(k)
    cells = {}
    for k, v in label.items():
        cells[v[0] * 100 + v[1]] = cells.get(v[0] * 100 + v[1], 0) + 1
    area, outer = {}, {}
    for x in rings:
        p = [(q["row"], q["col"]) for q in x["points"]]
        shoelace = sum(p[i - 1][1] * p[i][0] - p[i][1] * p[i - 1][0] for i in range(len(p))) / 2
        assert shoelace == x["area"] and x["hole"] == (shoelace < 0) and all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(p, p[1:], strict=False))
        area[x["region"]] = area.get(x["region"], 0) + x["area"]
        outer[x["region"]] = outer.get(x["region"], 0) + (not x["hole"])
    assert area == cells and set(outer.values()) == {1}
    assert {x["region"] for x in raster.outlines(df, 100, 20).collect()} == {k for k, n in cells.items() if n >= 20}


def test_triangles_have_empty_circles(spark):
    rng = np.random.default_rng(1)
    grid = np.stack(np.meshgrid(np.arange(14) / 13, np.arange(14) / 13), -1).reshape(-1, 2)
    p = np.concatenate([rng.random((350, 2)), rng.normal(0.5, 0.01, (350, 2)), grid, [[0.5, 0.5]] * 5])
    df = spark.createDataFrame(pd.DataFrame({"k": range(len(p)), "x": p[:, 0], "y": p[:, 1]}))
    made = tessellation.triangles(df, 40).cache()
    tri = np.array(sorted(tuple(r) for r in made.collect()))
    assert len({tuple(t) for t in tri.tolist()}) == len(tri) and (tri[:, 0] < tri[:, 1]).all() and (tri[:, 1] < tri[:, 2]).all()
    x, y = p[tri, 0], p[tri, 1]
    doubled = np.abs((x[:, 1] - x[:, 0]) * (y[:, 2] - y[:, 0]) - (y[:, 1] - y[:, 0]) * (x[:, 2] - x[:, 0]))
    assert doubled.sum() / 2 == pytest.approx(1.0, abs=1e-6)  # they cover the square once
    real = doubled > 1e-7
    cx, cy, r2 = tessellation.circles(x[real], y[real])
    assert not ((p[None, :, 0] - cx[:, None]) ** 2 + (p[None, :, 1] - cy[:, None]) ** 2 < r2[:, None] * (1 - 1e-6) - 1e-9).any()
    cells = tessellation.voronoi(df, made, (0.0, 0.0, 1.0, 1.0)).collect()
    assert len(cells) == len(np.unique(p, axis=0)) and sum(c["area"] for c in cells) == pytest.approx(1.0, abs=1e-6)
    # A cell holds what is nearer to its point than to any other: random places fall to cells in proportion.
    q = rng.random((4000, 2))
    near = ((q[:, None, :] - p[None]) ** 2).sum(axis=2).argmin(axis=1)
    share = {c["k"]: c["area"] for c in cells}
    large = sorted(share, key=share.get)[-20:]
    assert all(abs((near == k).mean() - share[k]) < 0.005 for k in large)
    assert tessellation.triangles(df.limit(2)).count() == 0


def test_vector_tiles(spark):
    r = random.Random(2)
    shape = lambda lon, lat, size, n: [{"x": lon + size * cos(6.2832 * i / n) * (1 + 0.001 * r.random()), "y": lat + size * sin(6.2832 * i / n)} for i in range(n)]
    rows = [(i, shape(75.6 + r.random(), 22.5 + r.random(), 0.004, 60), "home" if i % 2 else None, i / 4 if i % 3 else None, i % 5) for i in range(40)]
    rows += [(100, shape(75.9, 22.9, 0.3, 200), "large", 1.0, 1), (101, None, "x", 1.0, 1), (102, [{"x": 75.9, "y": 22.9}] * 2, "x", 1.0, 1)]
    df = spark.createDataFrame(rows, "k long, ring array<struct<x: double, y: double>>, class string, height double, floors int")
    found = vector_tiles.tiles(df, ["class", "height", "floors"], range(10, 14)).collect()
    by_zoom, ring_area = {}, lambda ring: sum(ring[i - 1][0] * ring[i][1] - ring[i][0] * ring[i - 1][1] for i in range(len(ring))) / 2
    for t in found:
        (layer,) = vector_tiles.decoded(bytes(t["tile"]))
        assert layer["name"] == "building" and layer["extent"] == 4096 and len(layer["features"]) == t["features"]
        for f in layer["features"]:
            assert all(-1 <= v <= 4097 for p in f["ring"] for v in p) and ring_area(f["ring"]) > 0
            assert f["properties"].get("class") in {None, "home", "large"} and f["properties"]["floors"] in range(5)
            z = by_zoom.setdefault(t["z"], [0.0, 0, 0])
            z[0] += ring_area(f["ring"]) / 4**t["z"] / 4096**2
            z[1] += len(f["ring"])
    # Shapes keep their area at every zoom, and lose corners towards the lower ones.
    plain = sum(abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(w, w[1:] + w[:1], strict=True))) / 2 for w in ([vector_tiles.world(p["x"], p["y"]) for p in x[1]] for x in rows if x[1] and len(x[1]) > 2))
    assert all(v[0] == pytest.approx(plain, rel=0.03) for v in by_zoom.values())
    assert by_zoom[10][1] < by_zoom[11][1] < by_zoom[12][1] < by_zoom[13][1]
    assert vector_tiles.tiles(df.limit(0), []).count() == 0
    line = [(0.0, 0.0), (1.0, 0.001), (2.0, 0.0), (2.0, 2.0), (1.0, 5.0), (0.0, 2.0)]
    assert vector_tiles.simplified(line, 0.01) == [p for p in line if p != (1.0, 0.001)]
    assert vector_tiles.clipped([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], (1.0, 1.0, 2.0, 9.0)) and not vector_tiles.clipped([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], (5.0, 5.0, 6.0, 6.0))


def test_greedy_clusters_equal_a_fold(spark):
    r = random.Random(8)
    dense = [("d", i, 22.5 + r.gauss(0, 0.004), 75.6 + r.gauss(0, 0.004)) for i in range(1500)]
    line = [("l", i, 60.0, 10.0 + i * 0.004) for i in range(40)]  # in order along a street: each waits for the one before
    rest = [(None, i, r.uniform(-60, 60), r.uniform(-170, 170)) for i in range(50)] + [("e", 7, None, 1.0)]
    rows = dense + line + rest
    got = {(x["kind"], x["seq"]): x["cluster"] for x in graph.greedy_clusters(spark.createDataFrame(rows, "kind string, seq long, lat double, lon double"), 300.0, "kind").collect()}
    far = lambda p, q: 12742000.0 * asin(sqrt(min(1.0, sin(radians(q[0] - p[0]) / 2) ** 2 + cos(radians(p[0])) * cos(radians(q[0])) * sin(radians(q[1] - p[1]) / 2) ** 2)))
    want, centres = {}, {}
    for kind, seq, lat, lon in rows:
        if lat is None:
            continue
        own = centres.setdefault(kind, [])
        at = next((i for i, p in enumerate(own) if far(p, (lat, lon)) <= 300.0), None)
        if at is None:
            at = len(own)
            own.append((lat, lon))
        want[kind, seq] = at
    assert got == want


def test_betweenness_by_joins_equals_the_broadcast(spark):
    r = random.Random(3)
    e = graph.undirected(spark.createDataFrame([(i, r.randrange(i), float(r.randrange(1, 4))) for i in range(1, 60)] + [(r.randrange(60), r.randrange(60), 1.0) for _ in range(25)], "a long, b long, w double"), "w")
    for sources in (None, 9):
        flat, joined = ({(x["a"], x["b"]): x["betweenness"] for x in graph.betweenness(e, sources, limit).collect()} for limit in (10**6, 0))
        assert joined == pytest.approx(flat, rel=1e-9, abs=1e-12) and max(joined.values()) > 0.1


def test_sites_equal_a_sequential_pass(spark):
    r = random.Random(5)
    far = lambda p, q: 12742000.0 * asin(sqrt(min(1.0, sin(radians(q[1] - p[1]) / 2) ** 2 + cos(radians(p[1])) * cos(radians(q[1])) * sin(radians(q[2] - p[2]) / 2) ** 2)))
    rows = [(i, 24.6 + r.random() / 50, 77.3 + r.random() / 50, r.randrange(20, 90), r.randrange(1, 9) / 4) for i in range(300)]
    ponds, used = [], set()
    own = [p for p in rows if p[3] > 30]
    for p in own:
        if p[0] in used:
            continue
        near = [q for q in own if q[0] >= p[0] and q[0] not in used and (q is p or far(p, q) < 500)]
        used |= {q[0] for q in near}
        best = max(near, key=lambda q: (q[3], -q[0]))
        ponds.append((best[0], best[3] * 8100 / 1e6, best[4] * 8100 * len(near), len(near)))
    df = spark.createDataFrame(rows, "k long, lat double, lon double, accum int, depth double")
    got = [(x["k"], pytest.approx(x["catchment_km2"]), pytest.approx(x["volume_m3"]), x["cells"]) for x in siting.retention_ponds(df, 90.0).collect()]
    assert sorted(ponds, key=lambda x: (-x[1], x[0]))[:15] == got
    chosen = []
    for p in sorted((p for p in rows if p[4] > 0.5), key=lambda p: (-p[4], p[0])):
        if all(far(p, q) >= 300 for q in chosen):
            chosen.append(p)
    assert [x["k"] for x in siting.pumping_stations(df, top=20).collect()] == [p[0] for p in chosen][:20]
    assert siting.pumping_stations(df.limit(0)).count() == 0 and siting.retention_ponds(df.limit(0), 90.0).count() == 0


def test_aligned_keeps_sums(spark):
    r = random.Random(7)
    cells = [(y, x, r.random()) for y in range(9) for x in range(7)]
    df = spark.createDataFrame(cells, "row int, col int, v double")
    got = {(x["row"], x["col"]): x["v"] for x in raster.aligned(df, (10.0, 50.0, 2.0, 3.0), (10.0, 50.0, 0.7, 0.9), 30, 20).collect()}
    assert len(got) == 600 and sum(got.values()) * 0.63 == pytest.approx(sum(v for _, _, v in cells) * 6)
    same = {(x["row"], x["col"]): x["v"] for x in raster.aligned(df, (10.0, 50.0, 2.0, 3.0), (10.0, 50.0, 2.0, 3.0), 9, 7).collect()}
    assert same == pytest.approx({(y, x): v for y, x, v in cells})
    assert {x["v"] for x in raster.aligned(df.limit(0), (0.0, 1.0, 1.0, 1.0), (0.0, 1.0, 1.0, 1.0), 2, 2).collect()} == {0.0}
    assert {x["v"] for x in raster.aligned(df, (10.0, 50.0, 2.0, 3.0), (500.0, 50.0, 1.0, 1.0), 2, 2).collect()} == {0.0}


def test_vector_tiles_keep_kinds_of_values_and_hold_many_features(spark):
    row = lambda k, n, flag: (k, [(0.1, 0.1), (0.2, 0.1), (0.2, 0.2)], n, flag)
    df = spark.createDataFrame([row(1, 1, True), row(2, None, None), row(3, 1, False)], "k long, ring array<struct<x: double, y: double>>, n int, flag boolean")
    (tile,) = vector_tiles.tiles(df, ["n", "flag"], range(10, 11)).filter("features = 3").limit(1).collect()
    (layer,) = vector_tiles.decoded(bytes(tile["tile"]))
    own = [f["properties"] for f in layer["features"]]
    assert own == [{"n": 1, "flag": 1}, {}, {"n": 1, "flag": 0}] and type(own[0]["n"]) is int
    made, shape = vector_tiles.Layer("building", ["n"]), vector_tiles.geometry([(0, 0), (4000, 0), (4000, 4000)])
    start = time.perf_counter()
    for i in range(200_000):
        made.add(shape, [vector_tiles.value(i % 100)])
    assert len(made.encoded()) > 200_000 * len(shape) and time.perf_counter() - start < 20  # copying the tile for each feature takes minutes
