"""Networks, neighbours, kinds and records against brute force and worked values."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from cellscope.functions import models, places
from cellscope.operators import network, scores
from cellscope.plans import catalog, q_network


def one(spark, **cols):
    row = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    return row[0] if len(cols) == 1 else tuple(row)


@pytest.mark.parametrize(
    ("x", "digits", "text"),
    [(1.005, 2, "1.00"), (1.125, 2, "1.13"), (-1.125, 2, "-1.13"), (2.5, 0, "3"), (0.5, 0, "1"), (1.45, 1, "1.4"), (8.345, 2, "8.35"), (1e6 + 0.05, 1, "1000000.1"), (0.0, 1, "0.0"), (None, 2, None)],
)
def test_fixed_digits(spark, x, digits, text):
    """Decimals of the exact binary value, ties away from zero."""
    assert one(spark, a=places.fixed_digits(F.lit(x).cast("double"), digits)) == text


def test_kinds_go_by_precedence(spark):
    tags = lambda **t: F.create_map(*[F.lit(x) for kv in t.items() for x in kv]) if t else F.create_map().cast("map<string,string>")
    assert one(spark, a=places.transit_kind(tags(amenity="bus_station", highway="x")), b=places.transit_kind(tags(highway="bus_stop", public_transport="p")), c=places.transit_kind(tags())) == ("bus_station", "bus_stop", "stop")
    assert one(spark, a=places.safety_kind(tags(amenity="police", barrier="lift_gate")), b=places.safety_kind(tags(barrier="lift_gate")), c=places.safety_kind(tags(barrier="gate"))) == ("police", "lift_gate", None)
    assert one(spark, a=places.crowd_category(tags(building="house", religion=" Sikh ")), b=places.crowd_category(tags(amenity="clinic", shop="mall")), c=places.crowd_category(tags(shop="kiosk"))) == ("worship_sikh", "hospital", None)
    assert [one(spark, a=places.is_arterial(F.lit(v))) for v in ("trunk", "trunk_link", "trunk_link_link", "service", None)] == [True, True, False, False, False]


def test_ids_and_ages(spark):
    assert one(spark, a=places.link_identifier(F.lit("http://x?identifier=a-1_b&c")), b=places.link_identifier(F.lit("http://x"))) == ("a-1_b", "http://x")
    assert one(spark, a=places.age_years(F.lit(0), F.lit(31_557_600)), b=places.age_years(F.lit(5), F.lit(0))) == (1.0, 0.0)


def test_growth_record(spark):
    none = F.lit(None).cast("double")
    trend = F.struct(F.lit(0.01).alias("slope"), F.lit(0.0).alias("intercept"), F.lit(0.5).alias("r2"))
    r = one(spark, a=models.growth_horizons(F.lit(50.0), F.lit(70.0), none, trend, F.lit(0.75)))
    assert (r["now"], r["year_2"], r["year_5"], r["year_5_band"], r["bue"], r["den"], r["cap"]) == (59, 60, 79, 13, "level", "up", "none")
    assert one(spark, a=models.growth_horizons(none, none, none, trend, none)) is None


def test_noded_edges_and_pockets(spark):
    p = lambda *c: [(y, x) for y, x in c]
    lines = spark.createDataFrame([(p((1.0, 2.0), (1.0, 2.1), (1.0, 2.2)),), (p((0.9, 2.1), (1.0, 2.1), (1.0, 2.1)),), (p((5.0, 5.0)),)], "points array<struct<lat: double, lon: double>>")
    assert network.noded_edges(lines).count() == 3
    r = random.Random(4)
    edges = {(a, b) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(62)) if a < b}

    def parts(use):
        label = {n: n for e in edges for n in e}
        for _ in label:
            for a, b in use:
                label[a] = label[b] = min(label[a], label[b])
        return label

    whole = parts(edges)
    bridges = {e for e in edges if (lab := parts(edges - {e}))[e[0]] != lab[e[1]]}
    block = parts(edges - bridges)
    assert whole != block
    seals = [block[n] for e in bridges for n in e]
    chosen = {b for b in set(block.values()) if 2 <= sum(v == b for v in block.values()) <= 60 and 1 <= seals.count(b) <= 9}
    nodes, cuts = network.pockets(spark.createDataFrame([(a, b, 1.0) for a, b in edges], "a long, b long, w double"), 2, 60, 9)
    assert {(x["node"], x["block"]) for x in nodes.collect()} == {(n, b) for n, b in block.items() if b in chosen}
    assert {tuple(x) for x in cuts.collect()} == {e for e in bridges if {block[e[0]], block[e[1]]} & chosen}


def test_distance_field(spark):
    r = random.Random(2)
    on = {(r.randrange(12), r.randrange(9)) for _ in range(6)}
    grid = spark.createDataFrame([(y, x, (y, x) in on) for y in range(12) for x in range(9)], "row long, col long, on boolean")
    for x in network.distance_field(grid, "on", 10.0).collect():
        assert x["metres"] == pytest.approx(10 * min(math.hypot(x["row"] - y, x["col"] - c) for y, c in on))
    assert {x["metres"] for x in network.distance_field(grid.withColumn("on", F.lit(False)), "on").collect()} == {1e6}


def test_neighbour_graphs(spark):
    r = random.Random(3)
    pts = [(i, 22.5 + r.random() / 50, 75.6 + r.random() / 50) for i in range(60)] + [(60, 23.5, 75.6)]

    def far(p, q):
        h = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 12742 * math.asin(math.sqrt(h))

    df = spark.createDataFrame(pts, "k long, lat double, lon double")
    expect = {tuple(sorted((p[0], q[0]))) for p in pts for q in sorted((q for q in pts if q != p), key=lambda q: far(p, q))[:3]}
    assert {(x["a"], x["b"]) for x in network.nearest_graph(df, 3).collect()} == expect
    assert {(x["a"], x["b"]) for x in network.radius_graph(df, 0.5).collect()} == {(p[0], q[0]) for p, q in itertools.combinations(pts, 2) if far(p, q) <= 0.5}


def test_road_cell_takes_the_longest_class(spark):
    rows = [(1, "a", 10.0, 5, 2, 0.1, False), (1, "b", 7.0, 9, None, None, None), (1, "b", 7.0, None, 4, 0.3, True), (1, None, 99.0, 1, 1, 0.2, False), (2, None, 3.0, None, None, None, None)]
    df = spark.createDataFrame(rows, "idx long, class string, metres double, risk int, los int, betweenness double, critical boolean")
    got = {x["idx"]: (x["risk"], x["los"], x["betweenness"], x["metres"], x["critical"], x["dominant"]) for x in network.road_cells(df).collect()}
    assert got == {1: (9, 4, 0.3, 123.0, 1, "b"), 2: (0, None, 0.0, 3.0, 0, None)}


def test_viewport_falls_back_to_samples(spark):
    s = scores.viewport_samples(spark, (0.0, 0.0, 5.0, 10.0)).collect()
    assert len(s) == 25 and (s[0]["lat"], s[0]["lon"]) == (0.5, 1.0) and (s[24]["lat"], s[24]["lon"]) == (4.5, 9.0)
    cells = spark.createDataFrame([("a", 1.0, 1.0, 10, None), ("b", 2.0, 2.0, 30, 90), ("c", 9.0, 9.0, 99, 99)], "k string, lat double, lon double, green int, safety int")
    assert [(x["k"], x["score"], x["rank"]) for x in scores.rank_viewport(cells, {"green": 1.0, "safety": 1.0}, (0, 0, 5, 5)).collect()] == [("b", 60.0, 1), ("a", 10.0, 2)]


@pytest.mark.parametrize("name", q_network.QUERIES)
def test_queries_give_rows(spark, name):
    assert not catalog.queries()[name](spark, "/root/testdata/sf0.01").isEmpty()
