"""Functions and operators of the engine on small fixtures with known results."""

import gzip
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellscope.functions import buildings, estate, geo, models, num, streets, sun, text
from cellscope.operators import classify, flood, graph, grid, growth, quality, raster, scores, sight, spatial_joins, tables
from cellscope.plans import q_estate, q_filter, q_text
from cellscope.sources import readers, sinks
from cellscope.streaming import ingest


def one(spark, **cols):
    r = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    return r[0] if len(cols) == 1 else r


def test_cell_codes(spark):
    lit = F.lit
    assert one(spark, a=geo.encode(lit(22.7196), lit(75.8577))) == "3MC-88P-JL2J"
    back = one(spark, a=geo.decode(lit("3mc-88p-jl2j")))
    assert abs(back["lat"] - 22.7196) < 1e-4 and abs(back["lon"] - 75.8577) < 1e-4
    assert [one(spark, a=geo.format_code(lit(c))) for c in ("3MC", "3MC88", "3MC88PJL2J")] == ["3MC", "3MC-88", "3MC-88P-JL2J"]
    for bad in (geo.encode(lit(1.0), lit(75.0)), geo.decode(lit("3MA")).getField("lat")):
        with pytest.raises(Exception, match="cell code|outside"):
            one(spark, a=bad)


def test_cells_for_bbox(spark):
    assert grid.cells_for_bbox(spark, 22.5, 75.6, 22.9, 76.0, 6).count() == 2209
    assert grid.cells_for_bbox(spark, 22.5, 75.6, 22.9, 76.0, 7).count() == 33489
    with pytest.raises(ValueError, match="more than"):
        grid.cells_for_bbox(spark, 22.5, 75.6, 22.9, 76.0, 7, max_cells=10)


def test_rounding_and_norm(spark):
    lit = F.lit
    assert [one(spark, a=num.half_up_int(lit(v))) for v in (-2.5, 2.5, 2.4)] == [-2, 3, 2]
    assert one(spark, a=num.norm_log(lit(0.0), 80.0), b=num.norm_log(lit(80.0), 80.0), c=num.norm_log(lit(1e9), 80.0)) == (0, 100, 100)
    assert one(spark, a=num.clamp(lit(None).cast("double"), 0.0, 1.0)) is None
    assert one(spark, a=num.trend(F.array(lit(1.0), lit(3.0), lit(5.0)))) == (2.0, 1.0, 1.0)
    assert one(spark, a=num.trend(F.array(lit(1.0), lit(3.0)))) is None
    assert one(spark, a=num.last_valid(F.array(lit(1), lit(None), lit(3), lit(None)))) == 3


def test_models(spark):
    lit = F.lit
    assert one(spark, a=models.lst_celsius(lit(0)), b=models.lst_celsius(lit(15000))) == (None, pytest.approx(26.85))
    assert one(spark, a=models.runoff_mm(lit(100.0), lit(80.0))) == pytest.approx((100 - 12.7) ** 2 / (100 - 12.7 + 63.5))
    assert one(spark, a=models.horizon(lit(50.0), lit(None).cast("double"), lit(100.0), "year_2")) == math.floor((50 * 0.2 + 100 * 0.6) / 0.8 + 0.5)
    assert [one(spark, a=models.level_of_service(lit(v))) for v in (0.35, 0.36, 1.0, 1.01)] == ["A", "B", "E", "F"]
    assert [one(spark, a=num.piecewise(lit(v), models.PM25, 500)) for v in (30.0, 45.0, 600.0)] == [50, 76, 500]
    assert one(spark, a=models.access_class(lit(10), lit(True))) == "Restricted"
    assert one(spark, a=models.transit_access(lit(None).cast("double"), lit(0)), b=models.transit_access(lit(5.0), lit(4))) == (8, 100)


def test_classifier_knows_every_rule(spark):
    rules = classify.rule_rows()
    assert sum(len(v) for v in classify.RULES.values()) == 135
    data = [(i, {k: "house" if v == "*" else v}) for i, (_, _, k, v) in enumerate(rules)] + [(9000, {"amenity": ""}), (9001, {"nothing": "x"})]
    found = {(r["k"], r["feature"]) for r in classify.classify(spark.createDataFrame(data, "k long, tags map<string,string>")).collect()}
    assert {(i, f) for i, (_, f, _, _) in enumerate(rules)} <= found
    assert not [k for k, _ in found if k >= 9000]


def test_disc_reaches_300_but_not_600_metres(spark):
    lat, lon = 22.72, 75.86
    points = spark.createDataFrame([(1, lat, lon, 7), (2, lat + 300 / 111320, lon, 7), (3, lat + 600 / 111320, lon, 7)], "k long, lat double, lon double, tag int")
    cells = spark.createDataFrame([("c", lat, lon)], "k string, lat double, lon double")
    assert grid.disc_counts(cells, points, "tag").collect()[0]["cnt"] == 2


BUILT = (
    "building_density", "vertical_development", "fsi_intensity", "height_diversity", "type_mix", "material_quality", "development_potential", "redevelopment_index", "urban_compactness", "modernization",
)


@pytest.mark.parametrize("lat", [4.3, 22.7, 37.2])
def test_disc_is_as_wide_as_its_latitude(spark, lat):
    """Bins by brute force: centres within the radius, longitude as long as at the cell's rounded latitude."""
    import math
    import random

    r, step = random.Random(1), 36 / 4**8
    points = [(i, lat + r.uniform(-0.02, 0.02), 75.0 + r.uniform(-0.02, 0.02), i % 3) for i in range(3000)]
    cells = [(f"c{i}", lat + r.uniform(-0.01, 0.01), 75.0 + r.uniform(-0.01, 0.01)) for i in range(20)]
    at = lambda la, lo: (math.floor((la - 2.5) / step), math.floor((lo - 63.5) / step))
    expect = {}
    for k, la, lo in cells:
        row, col = at(la, lo)
        for _, pla, plo, tag in points:
            y, x = at(pla, plo)
            dy, dx = (y - row) * step * 111_320, (x - col) * step * 111_320 * math.cos(math.radians(round(la)))
            if dy * dy + dx * dx <= 700**2:
                expect[k, tag] = expect.get((k, tag), 0) + 1
    found = grid.disc_counts(spark.createDataFrame(cells, "k string, lat double, lon double"), spark.createDataFrame(points, "k long, lat double, lon double, tag int"), "tag", radius_m=700.0)
    assert {(x["k"], x["tag"]): x["cnt"] for x in found.collect()} == expect


def test_ranking(spark):
    s = spark.createDataFrame([("a", 100, 50), ("b", None, 30), ("c", None, None)], "k string, green int, safety int")
    r = {x["k"]: x["score"] for x in scores.rank(s, {"green": 2.0, "safety": 1.0}).collect()}
    assert r == {"a": pytest.approx(250 / 3), "b": 30.0, "c": 0.0}
    assert len(scores.CATALOG) == 45
    assert {s for w in scores.CATALOG.values() for s in w} <= set(scores.WEIGHTED) | set(scores.LIVABILITY) | {"livability", "population_proxy", "religious_diversity", "flood_risk"} | set(BUILT)


def test_religious_diversity(spark):
    m = F.create_map(F.lit("a"), F.lit(2).cast("long"), F.lit("b"), F.lit(2).cast("long"))
    assert one(spark, a=scores.religious_diversity(m)) == 80
    assert one(spark, a=scores.religious_diversity(F.create_map(F.lit("a"), F.lit(3).cast("long")))) == 10


def test_nearest_is_exact_when_targets_are_far(spark):
    p = spark.createDataFrame([(1, 22.0, 75.0), (2, 30.0, 90.0)], "k long, lat double, lon double")
    t = spark.createDataFrame([(10, 22.001, 75.0), (11, 10.0, 70.0)], "k long, lat double, lon double")
    found = {(r["k"], r["rank"]): r["t"] for r in spatial_joins.nearest_k(p, t, 2).collect()}
    assert found == {(1, 1): 10, (1, 2): 11, (2, 1): 10, (2, 2): 11}
    assert spatial_joins.nearest_k(p, t.limit(0), 1).count() == 0


def test_polygon_functions(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0))])
    assert one(spark, a=geo.shoelace(ring), b=geo.ring_contains(F.lit(1.0), F.lit(1.0), ring), c=geo.ring_contains(F.lit(5.0), F.lit(1.0), ring)) == (12.0, True, False)


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a long, b long, w double")


def test_graph(spark):
    e = edges(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (7, 8)])
    assert {(r["a"], r["b"]) for r in graph.bridges(e).collect()} == {(3, 4), (4, 5), (7, 8)}
    assert {r["node"]: r["component"] for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7}
    path = {(r["a"], r["b"]): r["betweenness"] for r in graph.betweenness(edges(spark, [(1, 2), (2, 3)])).collect()}
    assert path == {(1, 2): pytest.approx(4 / 6), (2, 3): pytest.approx(4 / 6)}
    long = graph.components(edges(spark, [(i, i + 1) for i in range(60)]))
    assert {r["component"] for r in long.collect()} == {0}
    reach = graph.reachable_within(e, spark.createDataFrame([(1,)], "node long"), 2.0)
    assert {r["node"]: r["cost"] for r in reach.collect()} == {1: 0.0, 2: 1.0, 3: 1.0, 4: 2.0}


def test_greedy_clusters_follow_the_order(spark):
    p = spark.createDataFrame([("x", 1, 22.0, 75.0), ("x", 2, 22.002, 75.0), ("x", 3, 22.004, 75.0), ("y", 1, 22.0, 75.0)], "kind string, seq long, lat double, lon double")
    found = {(r["kind"], r["seq"]): r["cluster"] for r in graph.greedy_clusters(p, 300.0, "kind").collect()}
    assert found == {("x", 1): 0, ("x", 2): 0, ("x", 3): 1, ("y", 1): 0}


def grid_of(spark, rows):
    return spark.createDataFrame([(r, c, float(v)) for r, row in enumerate(rows) for c, v in enumerate(row)], "row int, col int, v double")


def test_raster(spark):
    ramp = grid_of(spark, [[3, 2, 1], [3, 2, 1], [3, 2, 1]])
    assert {round(r["slope"], 6) for r in raster.slope(ramp, 1.0).collect()} == {45.0}
    flow = {(r["row"], r["col"]): (r["dr"], r["dc"]) for r in raster.flow_direction(ramp, 0.0).collect()}
    assert flow[1, 0] == (0, 1) and flow[1, 2] == (None, None)
    acc = {(r["row"], r["col"]): r["cells"] for r in raster.flow_accumulation(raster.flow_direction(ramp, 0.0)).collect()}
    assert acc[1, 2] == 3 and acc[1, 0] == 1
    pit = grid_of(spark, [[5, 5, 5], [5, 1, 5], [5, 5, 5]])
    assert [(r["row"], r["col"]) for r in raster.local_minima(pit).collect()] == [(1, 1)]
    frac = {(r["row"], r["col"]): r["frac"] for r in raster.neighbour_fraction(grid_of(spark, [[0, 0, 0], [0, 1, 0], [0, 0, 0]])).collect()}
    assert frac[0, 0] == 0.125 and frac[1, 1] == 0.0


def test_order_statistics(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)], "g string, v double")
    s = tables.positional_stats(df, "g", "v").first()
    assert (s["upper_median"], s["p90"], s["n"]) == (3.0, 4.0, 4)
    assert tables.nearest_rank(df, "g", "v", 0.5).first()["v"] == 3.0
    shares = tables.largest_remainder(spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "k int, w double"), "k", "w", 100)
    assert {r["k"]: r["share"] for r in shares.collect()} == {1: 34, 2: 33, 3: 33}


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, a=text.minutes_of(lit("25:30:00")), b=text.minutes_of(lit("x"))) == (1530.0, None)
    assert one(spark, a=text.csv_safe(lit(" =1")), b=text.csv_safe(lit("a"))) == ("' =1", "a")
    assert one(spark, a=text.json_object(lit('say {"a": 1} now')), b=text.json_object(lit("no {json"))) == ('{"a": 1}', None)
    assert one(spark, a=text.number_with_unit(lit("3.5 m")), b=text.number_with_unit(lit("wide"))) == (3.5, None)
    weights = {e["score"]: e["w"] for e in one(spark, a=text.lexicon_weights(lit("quiet and green, safe for kids")))}
    assert weights["green"] == 1.0 and weights["flood_risk"] == -0.3
    assert one(spark, a=text.lexicon_weights(lit("nothing"))) == []
    assert one(spark, a=text.first_match(lit("an EV charger"), text.ROUTES, "best_residential")) == "ev"


def test_quality(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, None, 50.0), (3, "b", None)], "id long, kind string, v double")
    bad = quality.violations(df, "id", [quality.required("kind"), quality.one_of("kind", ["a"]), quality.in_range("v", 0, 10)])
    assert {(r["id"], r["column"], r["rule"]) for r in bad.collect()} == {(2, "kind", "required"), (2, "v", "in_range"), (3, "kind", "one_of")}
    tile = spark.createDataFrame([(1, 2), (3, 400)], "a int, b int")
    assert quality.tile_report(tile, ["a", "b"], 2).first() == (True, False, True)


def test_sources_and_sinks(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "e.json").write_text(json.dumps({"elements": [{"type": "node", "id": 1, "lat": 1.5, "lon": 2.5, "tags": {"a": "b"}}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}}, {"type": "node", "id": 3}]}))
    assert [(r["k"], r["lat"]) for r in readers.map_elements(spark, f"{d}/e.json").orderBy("k").collect()] == [(1, 1.5), (2, 3.0)]
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [75.0, 22.0]}, "properties": {"kind": "x"}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": []}, "properties": {}}]}))
    assert [(r["lat"], r["properties"]["kind"]) for r in readers.geojson_points(spark, f"{d}/g.json").collect()] == [(22.0, "x")]
    with gzip.open(tmp_path / "f.csv.gz", "wt") as f:
        f.write('latitude,longitude,area_in_meters,confidence,geometry,full_plus_code\n22.5,75.5,10,0.9,"POLYGON((0 0, 1 0, 1 1, 0 0))",P\n22.5,75.5,10,0.1,"POLYGON((0 0, 1 0, 1 1, 0 0))",Q\n')
    ring = readers.footprints_csv(spark, f"{d}/f.csv.gz", 22, 75, 23, 76).collect()
    assert len(ring) == 1 and ring[0]["ring"][1]["x"] == 1.0
    (tmp_path / "stops.txt").write_text("﻿stop_id,stop_lat\na,1.5\nb,x\n")
    stops = readers.timetable(spark, d, "stops", "stop_id string,stop_lat double,stop_lon double").collect()
    assert [(r["stop_id"], r["stop_lat"], r["stop_lon"]) for r in stops] == [("a", 1.5, None), ("b", None, None)]
    assert readers.timetable(spark, d, "trips", "trip_id string").count() == 0
    (tmp_path / "m.osm").write_text('<osm><node id="1" lat="1.0" lon="2.0"><tag k="a" v="b"/></node><node id="2" lat="3.0" lon="4.0"/><way id="9"><nd ref="1"/><nd ref="2"/><tag k="highway" v="path"/></way></osm>')
    centre = readers.way_centres(readers.map_xml(spark, f"{d}/m.osm", "node"), readers.map_xml(spark, f"{d}/m.osm", "way")).first()
    assert (centre["lat"], centre["lon"], centre["tags"]) == (2.0, 3.0, {"highway": "path"})
    (tmp_path / "v.json").write_text('{"warnings": [{"id": 1}, {"id": 2}]}')
    assert readers.envelope(spark, f"{d}/v.json").count() == 2
    s = spark.createDataFrame([("3MC88", 1), ("3MD88", 2)], "k string, v int")
    sinks.write_shards(s, f"{d}/shards", "r1", 3)
    sinks.write_shards(s.limit(1), f"{d}/shards", "r2", 3)
    assert readers.score_shards(spark, f"{d}/shards", "r1", ["3MC"]).count() == 1
    sinks.write_shards(s.filter("v = 2"), f"{d}/shards", "r1", 3)
    assert [r["k"] for r in spark.read.parquet(f"{d}/shards").filter("region = 'r1'").collect()] == ["3MD88"]  # nothing is left of the first run
    assert [r["k"] for r in spark.read.parquet(f"{d}/shards").filter("region = 'r2'").collect()] == ["3MC88"]
    m = spark.createDataFrame([("r1", 6)], "name string, level int")
    sinks.upsert_manifest(spark, f"{d}/manifest", m)
    again = sinks.upsert_manifest(spark, f"{d}/manifest", m.withColumn("level", F.lit(7)).unionByName(spark.createDataFrame([("r2", 6)], m.schema)))
    assert sorted(map(tuple, again.collect())) == [("r1", 7), ("r2", 6)]
    assert spark.read.json(f"{d}/manifest/v00000001").count() == 1  # the version before is still there
    (tmp_path / "manifest" / "v00000003").mkdir()  # one that was never finished doesn't count
    assert sinks.upsert_manifest(spark, f"{d}/manifest", m.limit(0)).count() == 2
    sinks.append_csv(spark.createDataFrame([("=x", ["a", "b"])], "t string, l array<string>"), f"{d}/out")
    assert spark.read.option("header", True).csv(f"{d}/out").first() == ("'=x", "a; b")


def test_ingest_adds_nothing_twice(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "1.json").write_text('{"id": "a", "v": 1}\n{"id": "b", "v": 2}\n')

    def run():
        stream = spark.readStream.schema("id string, v int").json(str(feed))
        ingest.ingest(stream, ["id"], f"{tmp_path}/history", f"{tmp_path}/latest", f"{tmp_path}/cp")

    run()
    (feed / "2.json").write_text('{"id": "b", "v": 3}\n{"id": "c", "v": 4}\n')
    run()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/history").collect()) == ["a", "b", "c"]
    assert sorted(r["id"] for r in spark.read.json(f"{tmp_path}/latest").collect()) == ["b", "c"]


def test_keyed_ingest_forgets_by_timer(spark, tmp_path):
    feed, day = tmp_path / "feed", 86_400_000
    feed.mkdir()

    def run(name, *rows):
        if name:
            (feed / name).write_text("".join(f'{{"id": {i}, "n": {n}, "ts": {t}}}\n' for i, n, t in rows))
        stream = spark.readStream.schema("id string, n int, ts string").json(str(feed)).withColumn("ts", F.to_timestamp("ts"))
        query = ingest.ingest_keyed(stream, ["id"], "ts", day, "0 seconds", ["n"], f"{tmp_path}/history", f"{tmp_path}/cp")
        return [p for p in query.recentProgress]

    def history():
        return sorted(r["n"] for r in spark.read.parquet(f"{tmp_path}/history").collect())

    run("1.json", ('"a"', 2, '"2024-01-01 00:00:00"'), ('"a"', 1, '"2024-01-01 00:00:00"'), ('"b"', 3, '"2024-01-01 10:00:00"'), ("null", 4, '"2024-01-01 09:00:00"'), ('"z"', 9, "null"))
    assert history() == [1, 3, 4]
    run("2.json", ('"a"', 5, '"2024-01-01 12:00:00"'), ('"b"', 6, '"2024-01-01 11:00:00"'), ("null", 7, '"2024-01-01 13:00:00"'))
    assert history() == [1, 3, 4]
    # A day and more on: all old keys are forgotten, and only the rows of this run are read.
    last = run("3.json", ('"c"', 10, '"2024-01-09 00:00:00"'))
    assert sum(p["numInputRows"] for p in last) == 1
    assert last[-1]["stateOperators"][0]["numRowsTotal"] < 8
    run("4.json", ('"a"', 11, '"2024-01-09 01:00:00"'), ('"c"', 12, '"2024-01-09 02:00:00"'), ('"b"', 13, '"2024-01-03 00:00:00"'))
    assert history() == [1, 3, 4, 10, 11]
    # The last batches run again after a failure.
    commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    for own in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        own.unlink(missing_ok=True)
    run(None)
    assert history() == [1, 3, 4, 10, 11]


def test_keyed_ingest_holds_many_keys_in_few_states(spark, tmp_path):
    hour, r = 3_600_000, random.Random(7)
    keep, late, want, last, top = 30 * hour, hour, [], {}, None
    for week in range(3):
        nan = float("nan")
        rows = [(r.choice([None, *range(1500)]), r.choice([None, -0.0, 0.0, nan, 1.5]), (1 + week * 40 + r.randrange(60)) * hour + r.randrange(9), 10_000 * week + i) for i in range(4000)]
        mark = -1 if top is None else top - late
        met = {}
        for a, b, ms, n in rows:
            if ms > max(mark, 0):
                met.setdefault((a, "nan" if b != b else b), []).append((ms, n))
        for k, seen in met.items():
            if k not in last or last[k] + keep <= mark:
                want.append(min(seen)[1])
            last[k] = max(last.get(k, 0), *[ms for ms, _ in seen])
        top = max(top or 0, *[ms for _, _, ms, _ in rows])
        spark.createDataFrame(rows, "a long, b double, ms long, n long").write.mode("append").parquet(f"{tmp_path}/feed")
        feed = spark.readStream.schema("a long, b double, ms long, n long").parquet(f"{tmp_path}/feed").withColumn("ts", F.timestamp_millis("ms"))
        progress = ingest.ingest_keyed(feed, ["a", "b"], "ts", keep, "1 hour", ["n"], f"{tmp_path}/history", f"{tmp_path}/cp").recentProgress
        # A value and a timer for each bucket of keys, not for each of some 3,700 keys.
        assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 3 * ingest.BUCKETS
    assert sorted(x["n"] for x in spark.read.parquet(f"{tmp_path}/history").collect()) == sorted(want)
    assert len(want) > len(last)


def test_viewshed_brute_force(spark):
    n, radius = 14, 5
    v = {(y, x): float((y * 31 + x * 17) % 23) for y in range(n) for x in range(n)}
    r = spark.createDataFrame([(y, x, h) for (y, x), h in v.items()], "row int, col int, v double")
    eyes = {1: (7, 7), 2: (0, 3), 3: (50, 50)}
    o = spark.createDataFrame([(k, *p) for k, p in eyes.items()], "k int, row int, col int")
    want = set()
    for k, (oy, ox) in eyes.items():
        if (oy, ox) not in v:
            continue
        for (y, x), h in v.items():
            far = math.hypot(y - oy, x - ox)
            if far > radius:
                continue
            steps, eye = math.ceil(far), v[oy, ox] + 1.7
            ray = [(v[math.floor(oy + (y - oy) * s / steps + 0.5), math.floor(ox + (x - ox) * s / steps + 0.5)] - eye) / (far * s / steps * 9) for s in range(1, steps)]
            if far == 0 or (h - eye) / (far * 9) >= max(ray, default=-math.inf) - 1e-6:
                want.add((k, y, x))
    assert {tuple(r) for r in sight.viewshed(r, o, radius).collect()} == want
    assert {tuple(r) for r in sight.viewshed(r, o, 0).collect()} == {(1, 7, 7), (2, 0, 3)}
    assert sight.viewshed(r.limit(0), o, radius).count() == 0


def test_crowds_and_forces(spark):
    lit = F.lit
    assert one(spark, a=streets.force(lit(1000), lit("riot"))) == (167, 101, 42, 26)
    assert [one(spark, a=streets.crowd_radius(lit(n))) for n in (500, 501, 9000)] == [300, 500, 1800]
    e = spark.createDataFrame([(1, 22.5, 75.6, 400)], "k int, lat double, lon double, people int")
    s = spark.createDataFrame([(5, 22.5, 75.6, 1.0), (6, 22.501, 75.6, 1000.0), (7, 23.0, 75.6, 9.0)], "t int, lat double, lon double, area double")
    got = sight.crowd_spread(e, s).first()
    far = 6371000 * math.radians(0.001)
    assert got["segments"] == 2 and got["placed"] == pytest.approx(6 + 394 * (1 - far / 300) * 0.3)


def test_tags_and_directives(spark):
    lit = F.lit
    none = lit(None).cast("string")
    assert [one(spark, a=streets.width(lit(w), lit(n), lit(k))) for w, n, k in (("5 m", "2", "trunk"), ("x", "2", "trunk"), ("0", "0", "steps"), ("-1m", "a", "other"))] == [5, 7, 1.5, 4]
    assert one(spark, a=streets.width(none, none, none)) == 4
    got = one(spark, a=streets.directives(lit("[ACTION] Go a:1 b:'x y' a:2\n[ACTION]\nnone [ACTION] z")))
    assert [(r["type"], dict(r["params"]), dict(r["numbers"])) for r in got] == [("go", {"a": "2", "b": "x y"}, {"a": 2.0})]
    assert one(spark, a=streets.directives(lit("")), b=streets.without_directives(lit("a\n[ACTION] x\nb"))) == ([], "a\nb")
    assert [one(spark, a=streets.context(lit(q))) for q in ("What does it need?", "AQI now", "hello")] == ["planning", "environment", "general"]


def test_sun(spark):
    noon = F.lit(1718884800.0 - 4 * 75.8577 * 60)
    p = one(spark, a=sun.position(F.lit(22.7), F.lit(75.8577), noon, sun.elements(sun.centuries(noon))))
    assert p["altitude"] == pytest.approx(89.2, abs=0.6)
    d = one(spark, a=sun.elements(sun.centuries(noon)))["decl"]
    assert d == pytest.approx(23.43, abs=0.02)
    assert [one(spark, a=sun.day_length(F.lit(x), F.lit(d)))["polar"] for x in (80.0, -80.0, 20.0)] == ["day", "night", None]


def test_ridge_equals_numpy(spark):
    rows = [(float(i % 7 * 10), None if i % 5 == 0 else float(i % 11 * 9), float("nan") if i % 13 == 0 else i % 7 * 3.0 - i % 11 + 0.5) for i in range(60)]
    got = growth.ridge(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y")
    ok = [r for r in rows if r[2] == r[2]]
    x = np.array([[1, r[0] / 100, (50 if r[1] is None else r[1]) / 100] for r in ok])
    y = np.array([r[2] for r in ok])
    w = np.linalg.solve(x.T @ x + np.diag([0, 1, 1]), x.T @ y)
    assert [got["intercept"], *got["weights"].values()] == pytest.approx(w)
    assert got["r2"] == pytest.approx(1 - ((y - x @ w) ** 2).sum() / ((y - y.mean()) ** 2).sum()) and got["n"] == len(ok)
    assert growth.ridge(spark.createDataFrame(rows[:1], "a double, b double, y double"), ["a", "b"], "y") is None


def test_growth(spark):
    cells = [(y, x, x < 3, x < 3 or (x < 6 and y % 2 == 0), float(x), float(y % 2)) for y in range(20) for x in range(10)]
    df = spark.createDataFrame(cells, "row int, col int, was boolean, now boolean, a double, b double")
    p = {(r["row"], r["col"]): r["potential"] for r in growth.transition_potential(df, ["a", "b"], trees=10, depth=4).collect()}
    assert len(p) == 200 and all(p[y, x] == 0 for y in range(20) for x in range(3))
    assert p[4, 4] > 0.8 and p[5, 8] < 0.2
    flat = growth.transition_potential(df.withColumn("now", F.col("was")), ["a", "b"])
    assert {r["potential"] for r in flat.collect()} == {0.0}
    pot = spark.createDataFrame([(y, x, (y * 7 + x * 3) % 11 / 10) for y in range(6) for x in range(6)], "row int, col int, potential double")
    start = {(y, x): 1.0 if (y, x) == (2, 2) else 0.0 for y in range(6) for x in range(6)}
    got = {(r["row"], r["col"]): r["p"] for r in growth.project(spark.createDataFrame([(*k, v) for k, v in start.items()], "row int, col int, v double"), pot, 2, 3).collect()}
    q, state = {(r["row"], r["col"]): r["potential"] for r in pot.collect()}, dict(start)
    want = dict(start)
    for s in range(3):
        near = lambda k: sum(state.get((k[0] + a, k[1] + b), 0) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b) / 8  # noqa: B023, E731
        best = sorted((k for k in state if state[k] == 0 and q[k] > 0), key=lambda k: (-q[k] * (1 + 0.5 * near(k)), k))[:2]
        for k in best:
            want[k] = 1 - s / 3 * 0.6
        state |= dict.fromkeys(best, 1.0)
    want = {k: max(v, q[k] * 0.4) for k, v in want.items()}
    assert got == pytest.approx(want)


def test_sequential_ids_and_dual(spark):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(500)], "a int, b int")
    got = tables.sequential_ids(df, ["a", "b"]).collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["id"])] == sorted((i * 37 % 101, i) for i in range(500))
    assert sorted(r["id"] for r in got) == list(range(500))
    e = spark.createDataFrame([(1, 10, 11), (2, 11, 12), (3, 12, 11), (4, 50, 50)], "k int, u int, v int")
    assert sorted(tuple(r) for r in growth.dual(e).collect()) == [(1, 2), (1, 3), (2, 3)]


def test_footprints(spark):
    pt = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    ring = F.array(pt(0.0, 0.0), pt(4.0, 0.0), pt(4.0, 1.0), pt(0.0, 0.0))
    assert one(spark, a=buildings.orientation(ring)) == pytest.approx(math.degrees(math.atan2(-1, -4)) % 180)
    assert one(spark, a=buildings.orientation(F.slice(ring, 1, 2))) == 0
    assert tuple(one(spark, a=buildings.vertex_mean(ring))) == (2.0, 0.25)
    assert one(spark, a=buildings.dxf_ring(F.slice(ring, 1, 1), "B", F.lit(0))) is None
    assert [one(spark, a=buildings.diversity(F.array(*map(F.lit, v)))) for v in ([5, 5], [5, 0], [0, 0])] == [100, 0, 0]
    assert one(spark, a=buildings.urban_form(F.lit(0), F.lit(2), F.lit(1)), b=buildings.urban_form(F.lit(60), F.lit(2), F.lit(99))) == ("Undeveloped", "Dense Low-Rise")


def test_quake_sources(spark, tmp_path):
    row = lambda *c: "<tr>" + "".join(f"<td class=x> {v} </td>" for v in c) + "</tr>"
    page = "<table id='other'>" + row(*"abcdefghi") + "</table><TABLE class=t id=\"list\"><tr><th>m</th></tr>" + row("4.5", "t1", "22.5", "75.6", "x", "<b>Deep</b>\n region", "loc", "ok", "") + row("?", "t2", "1", "2", "3", "r", "l", "ok", "") + row("1", "short") + "</TABLE>"
    (tmp_path / "a.html").write_text(page)
    got = readers.quake_table(spark, str(tmp_path / "a.html"), "list").collect()
    assert [(r["id"], r["magnitude"], r["depth_km"], r["region"]) for r in got] == [("t1|22.500,75.600", 4.5, 0.0, "Deep region")]
    feed = {"features": [{"id": "q1", "geometry": {"coordinates": [75.6, 22.5, 10.0]}, "properties": {"mag": 5.1, "time": 7, "place": "p"}}, {"id": "q2", "geometry": None, "properties": {"mag": 1.0}}]}
    (tmp_path / "f.json").write_text(json.dumps(feed))
    assert [tuple(r) for r in readers.quake_feed(spark, str(tmp_path / "f.json")).collect()] == [("q1", 5.1, 7, "p", 22.5, 75.6, 10.0)]


def test_paged_and_sensor_sources(spark, tmp_path):
    for page in (1, 2, 3):
        (tmp_path / f"page-{page}.json").write_text(json.dumps({"meta": {"page": page, "limit": 2, "found": 3}, "results": [{"id": page * 10}, {"id": page * 10 + 1}] if page < 3 else [{"id": 99}]}))
    got = readers.paged(spark, str(tmp_path / "page-*.json")).collect()
    assert sorted(json.loads(r["record"])["id"] for r in got) == [10, 11, 20, 21]
    assert readers.paged(spark, str(tmp_path / "page-*.json"), 1).count() == 2
    lines = [{"source": "a", "ts": "2024-01-01T00:00:00", "lat": 1.0, "lon": 2.0, "metrics": {"pm": 3.0, "no": None}}, {"source": "b", "lat": 1.0, "lon": 2.0, "metrics": {}}, {"source": "c", "lon": 2.0, "metrics": {"x": 1.0}}]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert [(r["source"], r["metrics"]) for r in readers.sensor_readings(spark, str(tmp_path / "s.jsonl")).collect()] == [("a", {"pm": 3.0})]


def test_simulation_sources(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<tripinfos><tripinfo id="v1" depart="3.0" duration="60.5" waitingTime="1" timeLoss="2" routeLength="500"/></tripinfos>')
    assert tuple(readers.simulated_trips(spark, str(tmp_path / "t.xml")).first()) == ("v1", 3.0, 60.5, 1.0, 2.0, 500.0)
    (tmp_path / "e.xml").write_text('<meandata><interval begin="0" end="300"><edge id="e1" speed="-1" entered="2.0"/><edge id=":j" speed="3"/></interval><interval begin="300" end="600"><edge id="e1" speed="5" density="1.5"/></interval></meandata>')
    got = sorted(tuple(r) for r in readers.simulated_edges(spark, str(tmp_path / "e.xml")).collect())
    assert got == [(0.0, 300.0, "e1", None, 0.0, 2), (300.0, 600.0, "e1", 5.0, 1.5, 0)]


def test_outlook(spark):
    lit = F.lit
    none = F.create_map().cast("map<string,double>")
    o = one(spark, a=estate.outlook(none))
    assert (o["score"], o["band"], o["confidence"], o["used"], o["lifted"]) == (None, "unknown", "no_data", 0, "")
    few = F.create_map(lit("jobs"), lit(80.0), lit("green"), lit(200.0), lit("made_up"), lit(1.0))
    o = one(spark, a=estate.outlook(few, "live"))
    w = {"jobs": 0.9 * 0.8, "green": 0.6 * 1.4}
    assert o["score"] == math.floor((80 * w["jobs"] + 100 * w["green"]) / sum(w.values()) + 0.5) and (o["confidence"], o["lifted"], o["held"]) == ("low", "green,jobs", "")


def test_flood_zones_empty_evidence(spark):
    cells = spark.createDataFrame([(1, 22.5, 75.6)], "k int, lat double, lon double")
    e = spark.createDataFrame([(1, "water", 22.5, 75.6), (2, "permanent", 22.5, 75.6), (3, "seasonal", 22.5, 75.6)], "t int, kind string, lat double, lon double")
    assert [tuple(r) for r in flood.zones(cells, e.limit(0), 10.0).collect()] == [(1, 0, "low")]
    assert [tuple(r) for r in flood.zones(cells, e, 10.0).collect()] == [(1, 35, "high")]


def test_routed_weights(spark):
    v = {(y, x): float(10 * y + (y * 7 + x * 3) % 5) for y in range(6) for x in range(5)}
    r = spark.createDataFrame([(*k, h) for k, h in v.items()], "row int, col int, v double")
    w = spark.createDataFrame([(y, x, (y + x) / 4) for y, x in v if (y, x) != (3, 3)], "row int, col int, w double")
    down = {(q["row"], q["col"]): (q["row"] + q["dr"], q["col"] + q["dc"]) if q["dr"] is not None else None for q in raster.flow_direction(r, 0.0).collect()}
    want = dict.fromkeys(v, 0.0)
    for (y, x) in v:
        at, seen = (y, x), 0
        while at is not None and seen < 50:
            want[at] += 0.0 if (y, x) == (3, 3) else (y + x) / 4
            at, seen = down[at], seen + 1
    got = {(q["row"], q["col"]): q["cells"] for q in raster.flow_accumulation(raster.flow_direction(r, 0.0), weights=w).collect()}
    assert got == pytest.approx(want)


def test_mask_regions(spark):
    m = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (3, 3), (2, 2)], "row int, col int")
    assert [tuple(r) for r in raster.regions(m, 2, 10).collect()] == [(0, 3, 0, 0, 1, 1)]
    assert raster.regions(m, 1, 10).count() == 3
    assert raster.regions(m.limit(0), 1, 10).count() == 0


def test_closeness_and_isolates(spark):
    raw = [(1, 2, 1.0), (2, 3, 2.0), (1, 3, 5.0), (3, 4, 1.0), (8, 9, 1.0)]
    e = graph.undirected(spark.createDataFrame(raw, "a int, b int, w double"), "w")
    got = {r["node"]: r["closeness"] for r in graph.closeness(e, e.selectExpr("a as node").distinct()).collect()}
    assert got[1] == pytest.approx(3 / (1 + 3 + 4) * 3 / 5) and got[8] == pytest.approx(1 * 1 / 5)
    assert sorted(r["a"] for r in graph.without_isolates(e, 3).collect()) == [1, 1, 2, 3]


def test_upsample_keeps_corners(spark):
    r = spark.createDataFrame([(y, x, float(y * 3 + x)) for y in range(3) for x in range(3)], "row int, col int, v double")
    up = {(q["row"], q["col"]): q["v"] for q in raster.upsample(r, 3, 5).collect()}
    assert len(up) == 25 and (up[0, 0], up[4, 4], up[1, 1], up[0, 1]) == (0.0, 8.0, 2.0, 0.5)


def test_order_statistics_hold_no_group_in_one_task(spark):
    rng = np.random.default_rng(4)
    rows = [("a" if i % 3 else None, float(v) if i % 17 else None) for i, v in enumerate(rng.integers(0, 60, 900))] + [("b", 7.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    found = tables.positional_stats(df, "g", "v")
    of = lambda g: sorted((v for x, v in rows if x == g), key=lambda v: (v is not None, v or 0.0))
    for r in found.collect():
        s = of(r["g"])
        n = len(s)
        assert (r["n"], r["upper_median"], r["p90"], r["p95"]) == (n, s[n // 2], s[min(n - 1, int(n * 0.9))], s[min(n - 1, int(n * 0.95))])
    rank = {r["g"]: r["v"] for r in tables.nearest_rank(df, "g", "v", 0.3).collect()}
    assert rank == {g: of(g)[round(0.3 * (len(of(g)) - 1))] for g in ("a", "b", "c", None)}
    lines = {r["g"]: r["m"] for r in tables.linear_percentiles(df, "g", "v", {"m": 0.37}).collect()}
    assert lines == {g: pytest.approx(np.quantile([v for v in of(g) if v is not None], 0.37)) for g in ("a", "b", None)} | {"c": None}
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (found, tables.nearest_rank(df, "g", "v", 0.3))]
    assert not any("row_number" in p for p in plans)


def test_costly_values_are_worked_out_once_and_in_many_tasks(spark, sf):
    df = spark.createDataFrame([(k, [0.1 * k, 0.2, 0.5]) for k in range(9)], "k long, s array<double>")
    t = df.select(num.trend(F.col("s")).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert t.count("aggregate(") == 2  # one mean, one pass of sums
    q = df.select(text.lexicon_weights(F.col("k").cast("string")).alias("w"))._jdf.queryExecution().analyzed().toString()
    assert q.count("regexp_replace(") == 1
    g = df.select(models.growth_horizons(F.col("k") * 1.0, F.col("k") * 1.0, F.col("k").cast("int"), num.trend(F.col("s")), F.lit(0.5)).alias("g"))
    assert g._jdf.queryExecution().analyzed().toString().count("aggregate(") == 2
    for run in (q_estate.estate_outlooks, q_estate.estate_drivers, q_text.lexicon_weights, q_filter.viewport_cells):
        assert "RepartitionByExpression" in run(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(sequence" not in q_filter.viewport_cells(spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
