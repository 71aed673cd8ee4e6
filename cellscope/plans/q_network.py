"""Queries over networks, neighbours, viewports, kinds and records, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, models, num, places
from ..functions import text as x
from ..operators import graph, grid, network, scores, spatial_joins
from ..session import durable
from . import geography as g
from . import q_space

c = F.col
VIEW = (22.58, 75.72, 22.71, 75.88)  # south, west, north, east of a view within the scored cells
OFF_GRID = (12.9, 77.5, 13.1, 77.7)


def _scored(spark, d):
    cells = grid.cells_for_bbox(spark, *q_space.BOX, 6).select(c("code").alias("k"), "lat", "lon")
    return q_space.composite_scores(spark, d).join(cells, "k")


def viewport_ranking(spark, d):
    """The covered cells in view by a named query."""
    return scores.rank_viewport(_scored(spark, d), scores.CATALOG["student"], VIEW).select("k", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "score", "rank")


def live_viewport(spark, d):
    """No cell is covered in view: five by five samples stand for it, with the features within 400 m of each."""
    seen = _scored(spark, d).filter(c("lat").between(OFF_GRID[0], OFF_GRID[2]) & c("lon").between(OFF_GRID[1], OFF_GRID[3]))
    box = OFF_GRID if seen.isEmpty() else VIEW
    points = scores.viewport_samples(spark, box)
    moved = g.pois(spark, d).select("k", (c("lat") - 9.6).alias("lat"), (c("lon") + 1.8).alias("lon"), "tag")
    near = grid.disc_counts(points, moved, "tag").groupBy("k").agg(F.sum("cnt").alias("n"), F.count("*").alias("kinds"))
    return points.join(near, "k", "left").select("k", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kinds", F.lit(0)).alias("kinds"))


def _asked(spark, d):
    """Questions as weights: the lexicon's where it finds any concept, else those of the query that key words name."""
    q = g.table(spark, d, "conversations").filter("text is not null").groupBy((c("conv_id") * 100 + c("turn")).alias("question")).agg(F.min("text").alias("q"))
    q = durable(q.withColumn("own", x.lexicon_weights(c("q"))))  # patterns are searched once
    lexicon = q.filter(F.size("own") > 0).select("question", F.explode("own").alias("e")).select("question", c("e.score").alias("score_id"), c("e.w").alias("weight"))
    named = F.broadcast(spark.createDataFrame(scores.named_weights(), "query string, score_id string, weight double"))
    keys = q.filter(F.size("own") == 0).select("question", x.first_match(c("q"), x.ROUTES, "best_residential").alias("query")).join(named, "query")
    return lexicon.unionByName(keys.select("question", "score_id", "weight"))


def question_ranking(spark, d):
    """The eight best covered cells in view for each question."""
    seen = _scored(spark, d).filter(c("lat").between(VIEW[0], VIEW[2]) & c("lon").between(VIEW[1], VIEW[3]))
    return scores.question_rows(_asked(spark, d), seen.drop("lat", "lon"))


def _segments(spark, d):
    r = g.roads(spark, d).withColumns({"lat": c("lat2"), "lon": c("lon2"), "metres": geo.haversine(c("lat1"), c("lon1"), c("lat2"), c("lon2"), 6371000.0)})
    r = r.withColumns({
        "risk": F.when(c("k") % 11 != 0, (c("k") * 7) % 100), "los": F.when(c("k") % 13 != 0, c("k") % 6), "betweenness": F.when(c("k") % 9 != 0, (c("k") % 1000) / 1000.0),
        "critical": c("k") % 97 == 0, "class": F.when(c("class") != 5, F.concat(F.lit("c"), c("class").cast("string"))),
    })
    return grid.dense_index(r, *q_space.BOX, q_space.NY, q_space.NX)


def road_cells(spark, d):
    found = network.road_cells(_segments(spark, d))
    return found.select("idx", "risk", "los", F.round("betweenness", 6).alias("betweenness"), F.round("metres", 2).alias("metres"), "critical", "dominant")


def growth_cells(spark, d):
    """A growth record per order line, with a trend of three years and a projection for some."""
    k = c("l_linenumber")
    t = g.table(spark, d, "lineitem").select(
        "l_orderkey", k, F.when(k != 7, models.built_up_expansion(c("l_quantity"), c("l_extendedprice") / 1500, c("l_tax") * 10, (k % 4).cast("double"))).alias("bue"),
        F.when(k < 5, models.densification(c("l_quantity") - 25, c("l_extendedprice") / 1000)).alias("den"), F.when(k % 3 == 0, (c("l_partkey") % 101).cast("int")).alias("cap"),
        F.when(k != 2, num.trend(F.array(c("l_discount") / 10, c("l_tax") / 10, c("l_quantity") / 1000))).alias("trend"), F.when(k % 2 == 0, c("l_discount") * 12).alias("ssp"),
    )
    return t.select("l_orderkey", "l_linenumber", models.growth_horizons(c("bue"), c("den"), c("cap"), c("trend"), c("ssp")).alias("r")).filter("r is not null").select("l_orderkey", "l_linenumber", "r.*")


def heat_rings(spark, d):
    """Night heat of each site against the mean of the eight places around it, read from a table of raster cells."""
    size = 0.03
    cell = lambda lat, lon: [F.floor(lat / size).cast("long").alias("y"), F.floor(lon / size).cast("long").alias("x")]
    r = g.pois(spark, d).groupBy(*cell(c("lat"), c("lon"))).agg(F.max(14_500 + c("k") % 900).alias("raw")).withColumn("night", models.lst_celsius(c("raw")))
    s = g.sites(spark, d)
    own = s.select("k", *cell(c("lat"), c("lon"))).join(r, ["y", "x"]).select("k", c("night").alias("cell"))
    around = s.select("k", F.explode(models.heat_ring(c("lat"), c("lon"))).alias("p")).select("k", *cell(c("p.lat"), c("p.lon"))).join(r, ["y", "x"]).groupBy("k").agg(F.avg("night").alias("around"), F.count("*").alias("n"))
    found = own.join(around, "k", "left")
    return found.select("k", F.round("cell", 6).alias("cell"), F.round("around", 6).alias("around"), F.coalesce("n", F.lit(0)).alias("n"), models.heat_island(c("cell"), c("around")).alias("uhi"))


def _tagged(spark, d):
    """Elements with one to three tags, from parts."""
    n = c("p_partkey")
    pick = lambda values, step: F.element_at(F.array(*map(F.lit, values)), (F.floor(n / step) % len(values) + 1).cast("int"))
    tags = F.map_from_arrays(F.array(*map(F.lit, TAG_VALUES)), F.array(*[pick(v, s) for v, s in TAG_VALUES.values()]))
    return g.table(spark, d, "part").select(n.alias("k"), tags.alias("tags"))


# Values of each tag in turn, and for how many elements each lasts.
TAG_VALUES = {
    "amenity": (("bus_station", "", "police", "marketplace", "clinic", "", "fuel", "fire_station", "place_of_worship", "college"), 1),
    "highway": (("", "bus_stop", "primary_link", "residential"), 3), "public_transport": (("", "platform", "station"), 5), "railway": (("", "level_crossing", "", ""), 7),
    "barrier": (("lift_gate", "", "toll_booth", "gate", ""), 11), "building": (("", "", "", "mosque", "house", ""), 13), "religion": (("", "", "", "", "Islam", "", " jain ", "zen"), 17), "shop": (("", "mall", "kiosk", ""), 19),
}


def element_kinds(spark, d):
    t = c("tags")
    return _tagged(spark, d).select(
        "k", places.transit_kind(t).alias("transit"), places.safety_kind(t).alias("safety"), places.crowd_category(t).alias("crowd"), places.is_arterial(F.try_element_at(t, F.lit("highway"))).alias("arterial")
    )


def noded_streets(spark, d):
    """Streets of three vertices; the middle one is another street's end for some."""
    r = g.roads(spark, d)
    point = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    return network.noded_edges(r.select(F.array(point(c("lat1"), c("lon1")), point(F.floor(c("lat1") * 100) / 100.0, F.floor(c("lon1") * 100) / 100.0), point(c("lat2"), c("lon2"))).alias("points"))).select("a", "b")


def sealable_pockets(spark, d):
    """Towns of twelve streets in a ring, each tied to a long road by one or two streets."""
    k = c("c_custkey")
    town, place = F.floor(k / 12), k % 12
    s = g.table(spark, d, "customer")
    ring = s.select(k.alias("a"), (town * 12 + (place + 1) % 12).alias("b"))
    road = s.filter(place == 0).select((-town - 1).alias("a"), (-town - 2).alias("b"))
    ties = s.filter((place == 0) | (place == 6) & (town % 3 == 0)).select(k.alias("a"), (-town - 1).alias("b"))
    nodes, _ = network.pockets(graph.undirected(ring.unionByName(road).unionByName(ties)), least=4, most=200)
    return nodes


def distance_field(spark, d):
    r = g.table(spark, d, "lineitem").groupBy((c("l_partkey") % 40).cast("long").alias("row"), (c("l_suppkey") % 40).cast("long").alias("col")).agg((F.max("l_quantity") == 50).alias("on"))
    return network.distance_field(r, "on", 100.0).select("row", "col", F.round("metres", 4).alias("metres"))


def nearest_graph(spark, d):
    return network.nearest_graph(g.facilities(spark, d), 6).select("a", "b", F.round("km", 6).alias("km"))


def radius_graph(spark, d):
    return network.radius_graph(g.pois(spark, d), 0.4, 6)


def metapath_pairs(spark, d):
    t = g.table(spark, d, "orders").select(c("o_custkey").alias("thing"), (c("o_orderkey") % 4001).alias("street"))
    return network.metapaths(t)


def poi_cells(spark, d):
    """Places by the facility whose Voronoi cell they are in: their nearest."""
    near = spatial_joins.nearest_k(g.pois(spark, d), g.facilities(spark, d), 1)
    return near.groupBy(c("t").alias("facility")).agg(F.count("*").alias("n"))


def source_matrix(spark, d):
    """The least finite time from each nation's depots to each part type's place."""
    s = g.table(spark, d, "supplier").select("s_nationkey", (c("s_suppkey") * 13 % 97).alias("from"))
    links = g.table(spark, d, "lineitem").select((c("l_suppkey") * 13 % 97).alias("from"), (c("l_partkey") % 50).alias("to"), F.when(c("l_quantity") < 45, c("l_quantity")).alias("minutes"))
    best = links.filter("minutes is not null").groupBy("from", "to").agg(F.min("minutes").alias("minutes"))
    return s.join(best, "from").groupBy("s_nationkey", "to").agg(F.min("minutes").alias("minutes"))


def cell_fan_in(spark, d):
    """What several sources know of each site; a source that has nothing gives null, and its state."""
    s = g.sites(spark, d).select("k")
    o = g.table(spark, d, "orders").groupBy(c("o_custkey").alias("k")).agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("largest"))
    e = g.table(spark, d, "events").groupBy(c("user_id").alias("k")).agg(F.count("*").alias("events"))
    b = g.table(spark, d, "customer").filter("c_acctbal > 0").select(c("c_custkey").alias("k"), "c_acctbal")
    p = g.table(spark, d, "supplier").select(c("s_suppkey").alias("k"), "s_acctbal")
    out = s
    for part in (o, e, b, p):
        out = out.join(part, "k", "left")
    state = lambda n: F.when(c(n).isNull(), "unavailable").otherwise("ok").alias(f"{n}_state")
    return out.select("k", "orders", "largest", "events", "c_acctbal", "s_acctbal", state("orders"), state("events"), state("c_acctbal"), state("s_acctbal"))


def parallel_roads(spark, d):
    """Roads drawn out to twenty times their length."""
    lines = g.roads(spark, d).filter("class < 2").withColumns({"lat2": c("lat1") + (c("lat2") - c("lat1")) * 20, "lon2": c("lon1") + (c("lon2") - c("lon1")) * 20})
    return network.parallel_roads(lines, 50.0, 400.0, digits=(3, 4))


def large_quakes(spark, d):
    """The latest five events of magnitude 4 or more of each kind."""
    e = g.table(spark, d, "events").select("event_id", "event_type", c("ts").alias("at"), (c("event_id") * 37 % 70 / 10.0).alias("magnitude"))
    order = Window.partitionBy("event_type").orderBy(F.desc("at"), "event_id")
    return e.filter("magnitude >= 4").withColumn("n", F.row_number().over(order)).filter("n <= 5").select("event_type", "n", "event_id", F.round("magnitude", 1).alias("magnitude"))


# Fixed values: (topic, score, bound, whether below it, priority) of a report's recommendations.
ADVICE = (
    ("healthcare", "healthcare_access", 20, True, 0), ("green cover", "green", 15, True, 0), ("safety", "safety", 25, True, 0), ("walking", "walkability", 25, True, 1),
    ("public transport", "connectivity", 20, True, 1), ("education", "education_score", 15, True, 1), ("commerce", "commercial", 15, True, 2), ("investment", "investment", 50, False, 2),
)


def recommendations(spark, d):
    """At most ten recommendations for each cell, the most pressing first."""
    s = q_space.composite_scores(spark, d)
    rows = [F.when(c(n) < bound if below else c(n) > bound, F.struct(F.lit(p).alias("priority"), F.lit(i).alias("seq"), F.lit(topic).alias("topic"))) for i, (topic, n, bound, below, p) in enumerate(ADVICE)]
    given = F.slice(F.array_sort(F.filter(F.array(*rows), lambda r: r.isNotNull())), 1, 10)
    return s.select("k", F.posexplode(given).alias("i", "r")).select("k", (c("i") + 1).alias("rank"), "r.topic", "r.priority")


def fixed_digits(spark, d):
    return g.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", places.fixed_digits(c("l_extendedprice").cast("double") / 8 - 4000, 2).alias("price"))


def feed_links(spark, d):
    e = g.table(spark, d, "events")
    link = F.when(c("event_id") % 3 == 0, F.concat(F.lit("https://feed.example/x?a=1&identifier="), "event_type", F.lit("-"), c("event_id").cast("string"), F.lit("&b=2"))).otherwise(F.concat(F.lit("https://feed.example/"), c("event_id").cast("string")))
    return e.select("event_id", places.link_identifier(link).alias("identifier"), F.round(places.age_years(F.unix_timestamp("ts"), F.lit(1_735_689_600)), 6).alias("age"))


def scene_choice(spark, d):
    """The newest scene with few clouds for each tile."""
    s = g.table(spark, d, "lineitem").select((c("l_partkey") % 500).alias("tile"), c("l_shipdate").alias("day"), c("l_orderkey").alias("scene"), c("l_linenumber").alias("part"), (c("l_discount") * 1000).alias("cloud"))
    first = F.max(F.struct("day", (-c("scene")).alias("s"), (-c("part")).alias("p"), "cloud")).alias("m")
    return s.filter("cloud < 30").groupBy("tile").agg(first).select("tile", F.date_format("m.day", "yyyy-MM-dd").alias("day"), (-c("m.s")).alias("scene"), (-c("m.p")).alias("part"))


def tiles_for_box(spark, d):
    """Tiles of a degree grid that touch each road's box."""
    r = g.roads(spark, d)
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) * 50), F.floor(F.greatest(a, b) * 50))
    return r.select("k", F.explode(span(c("lat1"), c("lat2"))).alias("ty"), "lon1", "lon2").select("k", "ty", F.explode(span(c("lon1"), c("lon2"))).alias("tx")).groupBy("ty", "tx").agg(F.count("*").alias("n"))


def tethers(spark, d):
    """Copies of places with constant properties of their own."""
    return g.facilities(spark, d).select("k", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.lit("tether").alias("kind"), F.lit(60).alias("height_m"), F.concat(F.lit("t-"), c("k").cast("string")).alias("id"))


def drain_upgrades(spark, d):
    """Zones of a hundredth of a degree with three encroachments or more."""
    near = lambda x: (F.rint(c(x) * 100) / 100).alias(x)  # noqa: E731  halves of the binary value go to the even number; bround takes the decimal one
    e = g.sites(spark, d).groupBy(near("lat"), near("lon")).agg(F.count("*").alias("n"))
    return e.filter("n >= 3").withColumn("priority", F.when(c("n") >= 10, "CRITICAL").otherwise("HIGH"))


def embankments(spark, d):
    """Large water bodies near the centre."""
    w = g.pois(spark, d).withColumns({"area": (c("k") % 100) * 1000.0, "m": geo.haversine(c("lat"), c("lon"), F.lit(22.7), F.lit(75.8), 6371000.0)})
    return w.filter("m < 5000 and area > 50000").select("k", "area", F.round(c("m") / 1000, 4).alias("km"))


def rain_gauges(spark, d):
    """A gauge every three hundredths of a degree, numbered, with the sites that are nearest to it on the lattice."""
    s = g.sites(spark, d).select(F.floor((c("lat") - 22.5) / 0.03).alias("i"), F.floor((c("lon") - 75.6) / 0.03).alias("j"))
    return s.groupBy((c("i") * 14 + c("j") + 1).alias("gauge")).agg(F.count("*").alias("sites"))


def gated_advice(spark, d):
    """Recommendations of a region that depend on which layers it has."""
    n = g.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count_if(c("c_acctbal") < 0).alias("drains"), F.avg("c_acctbal").alias("runoff"), F.count_if(c("c_custkey") % 50 == 0).alias("cover"))
    rows = F.array(
        F.struct(F.lit(1).alias("seq"), F.lit("CRITICAL").alias("priority"), F.lit("Dam safety").alias("category"), F.lit(None).cast("double").alias("figure")),
        F.struct(F.lit(2).alias("seq"), F.lit("CRITICAL").alias("priority"), F.lit("Storm drainage").alias("category"), F.when(c("drains") > 0, c("drains") / 10.0).otherwise(F.lit(0.0)).alias("figure")),
        F.when(c("runoff") > 4000, F.struct(F.lit(3).alias("seq"), F.lit("HIGH").alias("priority"), F.lit("Water retention").alias("category"), F.floor("runoff").cast("double").alias("figure"))),
        F.when(c("cover") > 0, F.struct(F.lit(4).alias("seq"), F.lit("HIGH").alias("priority"), F.lit("Green infrastructure").alias("category"), c("cover").cast("double").alias("figure"))),
    )
    return n.select("c_nationkey", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("c_nationkey", "r.*")


def category_items(spark, d):
    """Per tag: how many places, the first twenty by id, and counts of a sub-type."""
    p = g.pois(spark, d).withColumn("sub", F.concat(F.lit("s"), (c("k") % 3).cast("string")))
    order = Window.partitionBy("tag").orderBy("k")
    first = p.withColumn("n", F.row_number().over(order)).filter("n <= 20").groupBy("tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda v: v.cast("string")), ";").alias("first"))
    subs = p.groupBy("tag", "sub").agg(F.count("*").alias("n")).groupBy("tag").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "sub", "n"))), ";").alias("subs"))
    return subs.join(first, "tag")


def coverage_cells(spark, d):
    """Footprints per grid cell: their number, the share of ground that they cover (at most 100), the mean of known areas over all."""
    p = g.pois(spark, d).withColumn("area", F.when(c("k") % 7 != 0, c("k") % 50 * 1000.0))
    cells = grid.dense_index(p, *q_space.BOX, q_space.NY, q_space.NX).groupBy("idx").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(c("area") > 0, c("area"))), F.lit(0.0)).alias("area"))
    return cells.select("idx", "n", F.round(F.least(F.lit(100.0), c("area") / 1_000_000 * 100), 2).alias("coverage"), F.round(c("area") / c("n"), 1).alias("mean_area"))


def flag_near(spark, d):
    """Cells with a police post within two cells in any direction."""
    p = grid.dense_index(g.pois(spark, d).withColumn("police", F.when(c("tag") == 7, 1).otherwise(0)), *q_space.BOX, q_space.NY, q_space.NX).groupBy("idx").agg(F.max("police").alias("police"))
    return grid.neighbourhood_sum(p, "police", q_space.NY, q_space.NX, reach=2).select("idx", (c("total") > 0).alias("near"))


def stop_cells(spark, d):
    """Stops, the most routes of one stop and the least wait per grid cell."""
    p = g.pois(spark, d).filter("tag = 5").withColumns({"routes": c("k") % 9, "headway": F.when(c("k") % 4 != 0, c("k") % 31)})
    return grid.dense_index(p, *q_space.BOX, q_space.NY, q_space.NX).groupBy("idx").agg(F.count("*").alias("stops"), F.max("routes").alias("routes"), F.min("headway").alias("headway"))


def trip_metrics(spark, d):
    """Simulated trips over all and by kind of vehicle: number, mean and largest time, mean speed, share that waited."""
    t = g.table(spark, d, "lineitem").select(c("l_returnflag").alias("kind"), (c("l_quantity") * 10).alias("seconds"), c("l_extendedprice").alias("metres"), (c("l_discount") > 0.05).alias("waited"))
    return t.rollup("kind").agg(
        F.grouping("kind").cast("int").alias("all_kinds"), F.count("*").alias("n"), F.round(F.avg("seconds"), 4).alias("mean_s"), F.max("seconds").alias("max_s"), F.round(F.avg(c("metres") / c("seconds")), 4).alias("mean_speed"),
        F.round(F.count_if("waited") / F.count("*"), 6).alias("waited"),
    )


def bottlenecks(spark, d):
    """The twenty most crowded links, and the first fifty critical ones in the order they came."""
    s = _segments(spark, d).select("k", "betweenness", "critical")
    worst = s.filter("betweenness is not null").orderBy(F.desc("betweenness"), "k").limit(20).select(F.lit("bottleneck").alias("list"), "k")
    return worst.unionByName(s.filter("critical").orderBy("k").limit(50).select(F.lit("critical").alias("list"), "k"))


_CELLS = q_space._CELLS
_IN_VIEW = f"lat BETWEEN {VIEW[0]}::DOUBLE AND {VIEW[2]}::DOUBLE AND lon BETWEEN {VIEW[1]}::DOUBLE AND {VIEW[3]}::DOUBLE"
_SEG = f"""(SELECT {q_space._IDX} AS idx, * FROM (SELECT k, lat2 AS lat, lon2 AS lon, 12742000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, sin(radians(lat2 - lat1) / 2)*sin(radians(lat2 - lat1) / 2) + cos(radians(lat1))*cos(radians(lat2))*sin(radians(lon2 - lon1) / 2)*sin(radians(lon2 - lon1) / 2)))) AS metres,
    CASE WHEN k % 11 <> 0 THEN (k * 7) % 100 END AS risk, CASE WHEN k % 13 <> 0 THEN k % 6 END AS los, CASE WHEN k % 9 <> 0 THEN (k % 1000) / 1000.0::DOUBLE END AS betweenness, k % 97 = 0 AS critical, CASE WHEN class <> 5 THEN 'c' || class END AS class FROM {g.ROAD}) WHERE {q_space._IN})"""


def _asked_sql():
    lexicon = []
    for i, (_, pattern, weights) in enumerate(x.LEXICON):
        for s, w in weights.items():
            lexicon.append(f"({i}, '{pattern.replace(chr(39), chr(39) * 2)}', '{s}', {w}::DOUBLE)")
    return f"""(WITH q AS (SELECT conv_id * 100 + turn AS question, min(text) AS q FROM conversations WHERE text IS NOT NULL GROUP BY 1),
      hits AS (SELECT question, i, score_id, w FROM q, (VALUES {", ".join(lexicon)}) l(i, pattern, score_id, w) WHERE regexp_matches(lower(q), pattern)),
      held AS (SELECT question, score_id, list_reduce(list_prepend(0.0::DOUBLE, list(w ORDER BY i)), lambda a, b: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, a + b))) AS w FROM hits GROUP BY ALL),
      keyed AS (SELECT question, {_route_sql()} AS query FROM q WHERE question NOT IN (SELECT question FROM hits))
      SELECT question, score_id, round(w, 6) AS weight FROM held UNION ALL SELECT k.question, w.score_id, w.weight FROM keyed k JOIN {q_space._CATALOG} ON w.query = k.query)"""


def _route_sql():
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(q), '{p}') THEN '{n}'" for n, p in x.ROUTES) + " ELSE 'best_residential' END"


def _tag_sql():
    cols = ["(['" + "', '".join(v) + f"'])[((k // {s}) % {len(v)} + 1)::BIGINT] AS {n}" for n, (v, s) in TAG_VALUES.items()]
    return f"(SELECT k, {', '.join(cols)} FROM (SELECT p_partkey AS k FROM part))"


_WORSHIP = "CASE lower(trim(religion)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in places.WORSHIP.items()) + " ELSE 'worship_other' END"
_NODE = lambda lat, lon: f"(floor({lon} * 100000 + 0.5) * 100000000 + floor({lat} * 100000 + 0.5))::BIGINT"
_PAIR = f"SELECT a.k AS a, b.k AS b, {g.haversine_sql('a', 'b')} AS km FROM {{t}} a, {{t}} b WHERE a.k <> b.k"
_COS = lambda lat: f"cos(radians({lat})) * 111320.0::DOUBLE"


def _away(i):
    """Distance of a's end i from segment b in metres, in a's local plane."""
    kx = _COS(f"a.lat{i}")
    ax, ay, bx, by = f"((b.lon1 - a.lon{i}) * {kx})", f"((b.lat1 - a.lat{i}) * 111320.0::DOUBLE)", f"((b.lon2 - a.lon{i}) * {kx})", f"((b.lat2 - a.lat{i}) * 111320.0::DOUBLE)"
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    t = f"greatest(0.0, least(1.0, -({ax} * {dx} + {ay} * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return f"sqrt(pow({ax} + {t} * {dx}, 2) + pow({ay} + {t} * {dy}, 2))"



def _overlap(v):
    la, ha, lb, hb = (f"least(a.{v}1, a.{v}2)", f"greatest(a.{v}1, a.{v}2)", f"least(b.{v}1, b.{v}2)", f"greatest(b.{v}1, b.{v}2)")
    both, short = f"(least({ha}, {hb}) - greatest({la}, {lb}))", f"least({ha} - {la}, {hb} - {lb})"
    return f"CASE WHEN {both} > 0 AND {short} > 0 THEN {both} / {short} ELSE 0.0 END"


_NOW = "floor((coalesce(bue * {0}, 0.0) + coalesce(den * {1}, 0.0) + coalesce(cap * {2}, 0.0)) / ((bue IS NOT NULL)::INT * {0} + (den IS NOT NULL)::INT * {1} + (cap IS NOT NULL)::INT * {2}) + 0.5)::INT"
_weights = lambda name: [f"{w!r}::DOUBLE" for w in models.HORIZONS[name]]
_ARROW = lambda s: f"CASE WHEN {s} IS NULL THEN 'none' WHEN {s} > 60 THEN 'up' WHEN {s} > 45 THEN 'level' ELSE 'down' END AS {s}"

QUERIES = {
    "viewport_ranking": (viewport_ranking, f"""SELECT s.k, round(lat, 6) AS lat, round(lon, 6) AS lon, score, row_number() OVER (ORDER BY score DESC, s.k)::INT AS rank FROM ({q_space._RANKED}) s JOIN {_CELLS} c ON c.code = s.k
        WHERE query = 'student' AND {_IN_VIEW} ORDER BY score DESC, s.k LIMIT 10"""),
    "live_viewport": (live_viewport, f"""WITH p AS (SELECT (i * 5 + j)::VARCHAR AS k, 12.9::DOUBLE + {(13.1 - 12.9) / 5!r}::DOUBLE * (i + 0.5) AS lat, 77.5::DOUBLE + {(77.7 - 77.5) / 5!r}::DOUBLE * (j + 0.5) AS lon FROM range(5) a(i), range(5) b(j)),
        cells AS (SELECT *, {g.row_sql('lat', 8)} AS r, {g.col_sql('lon', 8)} AS c, round_even(lat, 0) AS band FROM p),
        bins AS (SELECT {g.row_sql('(lat - 9.6::DOUBLE)', 8)} AS r, {g.col_sql('(lon + 1.8::DOUBLE)', 8)} AS c, tag, count(*) AS n FROM {g.POI} GROUP BY ALL),
        near AS (SELECT x.k, sum(b.n)::BIGINT AS n, count(DISTINCT b.tag) AS kinds FROM cells x, {q_space._offsets_sql()}, bins b WHERE o.band = x.band AND b.r = x.r + o.dr AND b.c = x.c + o.dc GROUP BY x.k)
        SELECT p.k, round(lat, 6) AS lat, round(lon, 6) AS lon, coalesce(n, 0)::BIGINT AS n, coalesce(kinds, 0)::BIGINT AS kinds FROM p LEFT JOIN near ON near.k = p.k"""),
    "question_ranking": (question_ranking, f"""SELECT question, k, score, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, k) AS n FROM (
        SELECT a.question, s.k, round(sum(a.weight * s.v) / sum(abs(a.weight)), 6) AS score FROM {q_space._LONG} s JOIN {_CELLS} c ON c.code = s.k JOIN {_asked_sql()} a ON a.score_id = s.score_id WHERE {_IN_VIEW} GROUP BY ALL)) WHERE n <= 8"""),
    "road_cells": (road_cells, f"""WITH s AS {_SEG}, t AS (SELECT idx, class, sum(metres) AS m FROM s WHERE class IS NOT NULL GROUP BY ALL)
        SELECT idx, coalesce(max(risk), 0) AS risk, max(los) AS los, round(coalesce(max(betweenness), 0.0::DOUBLE), 6) AS betweenness, round(sum(metres), 2) AS metres, max(critical::INT) AS critical,
        (SELECT arg_min(t.class, (-t.m, t.class)) FROM t WHERE t.idx = s.idx) AS dominant FROM s GROUP BY idx"""),
    "growth_cells": (growth_cells, f"""WITH x AS (SELECT *, l_extendedprice / 1500 AS prev, l_discount / 10 AS y0, l_tax / 10 AS y1, l_quantity / 1000 AS y2 FROM lineitem),
        y AS (SELECT *, CASE WHEN l_linenumber <> 7 THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, 50 + 25 * tanh((l_quantity - prev) / prev * 100 / 8) + 15 * tanh(l_tax * 10) + least(10.0, (l_linenumber % 4) * 2.0))) END AS bue,
          CASE WHEN l_linenumber < 5 THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, 50 + 25 * tanh((l_quantity - 25) / 15) + least(15.0::DOUBLE, l_extendedprice / 1000 / 8))) END AS den, CASE WHEN l_linenumber % 3 = 0 THEN (l_partkey % 101)::INT END AS cap,
          (y0 + y1 + y2) / 3 AS mean, -1.0::DOUBLE * (y0 - mean) + 0.0::DOUBLE * (y1 - mean) + (y2 - mean) AS xy, (y0 - mean) * (y0 - mean) + (y1 - mean) * (y1 - mean) + (y2 - mean) * (y2 - mean) AS yy, xy / 2 AS slope, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 12 END AS ssp FROM x),
        z AS (SELECT *, CASE WHEN yy = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, xy * xy / (2 * yy))) END AS r2, {_NOW.format(*_weights('nowcast'))} AS now, {_NOW.format(*_weights('year_2'))} AS year_2 FROM y WHERE bue IS NOT NULL OR den IS NOT NULL OR cap IS NOT NULL),
        w AS (SELECT *, CASE WHEN l_linenumber <> 2 THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, now + slope * 5 * 200)) ELSE now::DOUBLE END AS ahead FROM z)
        SELECT l_orderkey, l_linenumber, now, 5 AS now_band, year_2, 10 AS year_2_band, floor(CASE WHEN ssp IS NULL THEN ahead ELSE floor(greatest(0.0, least(100.0, ahead + (greatest(0.0, least(1.0, ssp)) - 0.5) * 2 * 20)) + 0.5) END + 0.5)::INT AS year_5,
        greatest(10, floor(25 * (1 - CASE WHEN l_linenumber <> 2 THEN r2 ELSE 0.0 END) + 0.5))::INT AS year_5_band, {_ARROW('bue')}, {_ARROW('den')}, {_ARROW('cap')} FROM w"""),
    "heat_rings": (heat_rings, f"""WITH r AS (SELECT floor(lat / 0.03::DOUBLE)::BIGINT AS y, floor(lon / 0.03::DOUBLE)::BIGINT AS x, max(14500 + k % 900) / 50.0::DOUBLE - 273.15::DOUBLE AS night FROM {g.POI} GROUP BY ALL),
        own AS (SELECT s.k, r.night FROM {g.SITE} s JOIN r ON r.y = floor(s.lat / 0.03::DOUBLE) AND r.x = floor(s.lon / 0.03::DOUBLE)),
        ring AS (SELECT s.k, avg(r.night) AS around, count(*) AS n FROM {g.SITE} s, (VALUES {', '.join(map(str, models.RING))}) o(dy, dx), r WHERE r.y = floor((s.lat + dy * 0.09::DOUBLE) / 0.03::DOUBLE) AND r.x = floor((s.lon + dx * (0.09::DOUBLE / cos(radians(s.lat)))) / 0.03::DOUBLE) GROUP BY s.k)
        SELECT own.k, round(night, 6) AS cell, round(around, 6) AS around, coalesce(n, 0)::BIGINT AS n, CASE WHEN around IS NOT NULL THEN greatest(0, least(100, floor((night - around + 2) * 12 + 0.5)))::INT END AS uhi FROM own LEFT JOIN ring ON ring.k = own.k"""),
    "element_kinds": (element_kinds, f"""SELECT k, CASE WHEN amenity = 'bus_station' THEN 'bus_station' WHEN highway <> '' THEN highway WHEN public_transport <> '' THEN public_transport ELSE 'stop' END AS transit,
        CASE WHEN amenity = 'police' THEN 'police' WHEN railway = 'level_crossing' THEN railway WHEN barrier IN ('toll_booth', 'lift_gate') THEN barrier END AS safety,
        CASE WHEN amenity = 'place_of_worship' OR building IN ('temple', 'mosque', 'church') OR religion <> '' THEN {_WORSHIP} WHEN amenity = 'marketplace' THEN 'market' WHEN amenity IN ('school', 'college', 'university') THEN 'school'
          WHEN amenity IN ('hospital', 'clinic') THEN 'hospital' WHEN amenity IN ('police', 'fire_station') THEN amenity WHEN amenity = 'bus_station' OR public_transport = 'station' THEN 'transport'
          WHEN shop IN ('supermarket', 'mall', 'general') THEN 'market' WHEN amenity = 'fuel' THEN 'transport' END AS crowd,
        regexp_full_match(highway, '(motorway|trunk|primary|secondary|tertiary)(_link)?') AS arterial FROM {_tag_sql()}"""),
    "noded_streets": (noded_streets, f"""SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (
        SELECT {_NODE('lat1', 'lon1')} AS a, {_NODE('floor(lat1 * 100) / 100.0::DOUBLE', 'floor(lon1 * 100) / 100.0::DOUBLE')} AS b FROM {g.ROAD} UNION ALL SELECT {_NODE('floor(lat1 * 100) / 100.0::DOUBLE', 'floor(lon1 * 100) / 100.0::DOUBLE')}, {_NODE('lat2', 'lon2')} FROM {g.ROAD}) WHERE a <> b"""),
    "sealable_pockets": (sealable_pockets, None),
    "distance_field": (distance_field, """WITH r AS (SELECT l_partkey % 40 AS row, l_suppkey % 40 AS col, max(l_quantity) = 50 AS on_ FROM lineitem GROUP BY ALL)
        SELECT a.row, a.col, round(min(sqrt(pow(a.row - b.row, 2) + pow(a.col - b.col, 2))) * 100, 4) AS metres FROM r a, r b WHERE b.on_ GROUP BY ALL"""),
    "nearest_graph": (nearest_graph, f"SELECT least(a, b) AS a, greatest(a, b) AS b, round(min(km), 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY km, b) AS n FROM ({_PAIR.format(t=g.FACILITY)})) WHERE n <= 6 GROUP BY ALL"),
    "radius_graph": (radius_graph, f"SELECT a, b, round(km, 6) AS km FROM ({_PAIR.format(t=g.POI)}) WHERE km <= 0.4 AND a < b"),
    "metapath_pairs": (metapath_pairs, "WITH t AS (SELECT o_custkey AS thing, o_orderkey % 4001 AS street FROM orders) SELECT DISTINCT x.thing AS a, y.thing AS b FROM t x JOIN t y USING (street) WHERE x.thing < y.thing"),
    "poi_cells": (poi_cells, f"SELECT t AS facility, count(*) AS n FROM (SELECT p.k, f.k AS t, row_number() OVER (PARTITION BY p.k ORDER BY {g.haversine_sql('p', 'f')}, f.k) AS n FROM {g.POI} p, {g.FACILITY} f) WHERE n = 1 GROUP BY t"),
    "source_matrix": (source_matrix, """SELECT s_nationkey, l_partkey % 50 AS "to", min(l_quantity) AS minutes FROM supplier JOIN lineitem ON s_suppkey * 13 % 97 = l_suppkey * 13 % 97 WHERE l_quantity < 45 GROUP BY ALL"""),
    "cell_fan_in": (cell_fan_in, f"""SELECT s.k, o.orders, o.largest, e.events, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal, s_acctbal, CASE WHEN o.orders IS NULL THEN 'unavailable' ELSE 'ok' END AS orders_state,
        CASE WHEN e.events IS NULL THEN 'unavailable' ELSE 'ok' END AS events_state, CASE WHEN c_acctbal > 0 THEN 'ok' ELSE 'unavailable' END AS c_acctbal_state, CASE WHEN s_acctbal IS NULL THEN 'unavailable' ELSE 'ok' END AS s_acctbal_state
        FROM {g.SITE} s LEFT JOIN (SELECT o_custkey, count(*) AS orders, max(o_totalprice) AS largest FROM orders GROUP BY 1) o ON o_custkey = s.k LEFT JOIN (SELECT user_id, count(*) AS events FROM events GROUP BY 1) e ON user_id = s.k
        LEFT JOIN customer ON c_custkey = s.k LEFT JOIN supplier ON s_suppkey = s.k"""),
    "parallel_roads": (parallel_roads, f"""WITH r AS (SELECT *, {q_space._BEARING} AS dir FROM (SELECT k, lat1, lon1, lat1 + (lat2 - lat1) * 20 AS lat2, lon1 + (lon2 - lon1) * 20 AS lon2 FROM {g.ROAD} WHERE class < 2)),
        p AS (SELECT a.k AS a, b.k AS b, ({_away(1)} + {_away(2)}) / 2 AS metres, CASE WHEN ((a.dir + b.dir) / 2 > 45 AND (a.dir + b.dir) / 2 < 135) OR ((a.dir + b.dir) / 2 > 225 AND (a.dir + b.dir) / 2 < 315) THEN {_overlap('lon')} ELSE {_overlap('lat')} END AS overlap
          FROM r a JOIN r b ON a.k < b.k AND abs(a.lat1 - b.lat1) < 0.06 AND abs(a.lon1 - b.lon1) < 0.06 AND (abs(a.dir - b.dir) < 30 OR abs(a.dir - b.dir) > 330 OR abs(abs(a.dir - b.dir) - 180) < 30))
        SELECT a, b, round(metres, 3) AS metres, round(overlap, 4) AS overlap FROM p WHERE metres BETWEEN 50 AND 400 AND overlap >= 0.3"""),
    "large_quakes": (large_quakes, """SELECT event_type, n::INT AS n, event_id, round(m, 1) AS magnitude FROM (SELECT *, event_id * 37 % 70 / 10.0::DOUBLE AS m, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events WHERE event_id * 37 % 70 >= 40) WHERE n <= 5"""),
    "recommendations": (recommendations, f"""SELECT k, row_number() OVER (PARTITION BY k ORDER BY priority, seq)::INT AS rank, topic, priority FROM (SELECT s.k, a.* EXCLUDE (score_id, bound, below) FROM {q_space._LONG} s JOIN
        (VALUES {", ".join(f"({i}, '{t}', '{n}', {b}, {below}, {p})" for i, (t, n, b, below, p) in enumerate(ADVICE))}) a(seq, topic, score_id, bound, below, priority) ON a.score_id = s.score_id AND CASE WHEN a.below THEN s.v < a.bound ELSE s.v > a.bound END)"""),
    "fixed_digits": (fixed_digits, """SELECT l_orderkey, l_linenumber, CASE WHEN x < 0 THEN '-' ELSE '' END || printf('%.2f', CASE WHEN x * 8 = floor(x * 8) THEN floor(abs(x) * 100 + 0.5) / 100 ELSE abs(x) END) AS price
        FROM (SELECT *, l_extendedprice::DOUBLE / 8 - 4000 AS x FROM lineitem)"""),
    "feed_links": (feed_links, """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || '-' || event_id ELSE 'https://feed.example/' || event_id END AS identifier, round(greatest(0.0, (1735689600 - floor(epoch(ts))) / 31557600.0::DOUBLE), 6) AS age FROM events"""),
    "scene_choice": (scene_choice, """SELECT tile, strftime(day, '%Y-%m-%d') AS day, scene, part FROM (SELECT l_partkey % 500 AS tile, l_shipdate AS day, l_orderkey AS scene, l_linenumber AS part, row_number() OVER (PARTITION BY l_partkey % 500 ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS n
        FROM lineitem WHERE l_discount * 1000 < 30) WHERE n = 1"""),
    "tiles_for_box": (tiles_for_box, f"""SELECT ty, tx, count(*) AS n FROM (SELECT unnest(range(floor(least(lat1, lat2) * 50)::BIGINT, floor(greatest(lat1, lat2) * 50)::BIGINT + 1)) AS ty, lon1, lon2, k FROM {g.ROAD}) r,
        LATERAL (SELECT unnest(range(floor(least(lon1, lon2) * 50)::BIGINT, floor(greatest(lon1, lon2) * 50)::BIGINT + 1)) AS tx) GROUP BY ALL"""),
    "tethers": (tethers, f"SELECT k, round(lat, 6) AS lat, round(lon, 6) AS lon, 'tether' AS kind, 60 AS height_m, 't-' || k AS id FROM {g.FACILITY}"),
    "drain_upgrades": (drain_upgrades, f"SELECT *, CASE WHEN n >= 10 THEN 'CRITICAL' ELSE 'HIGH' END AS priority FROM (SELECT round_even(lat, 2) AS lat, round_even(lon, 2) AS lon, count(*) AS n FROM {g.SITE} GROUP BY ALL) WHERE n >= 3"),
    "embankments": (embankments, f"SELECT k, area, round(m / 1000, 4) AS km FROM (SELECT a.k, (a.k % 100) * 1000.0::DOUBLE AS area, {g.haversine_sql('a', 'b', 6371000.0)} AS m FROM {g.POI} a, (SELECT 22.7::DOUBLE AS lat, 75.8::DOUBLE AS lon) b) WHERE m < 5000 AND area > 50000"),
    "rain_gauges": (rain_gauges, f"SELECT (floor((lat - 22.5::DOUBLE) / 0.03::DOUBLE) * 14 + floor((lon - 75.6::DOUBLE) / 0.03::DOUBLE) + 1)::BIGINT AS gauge, count(*) AS sites FROM {g.SITE} GROUP BY 1"),
    "gated_advice": (gated_advice, """WITH n AS (SELECT c_nationkey, count(*) FILTER (c_acctbal < 0) AS drains, avg(c_acctbal) AS runoff, count(*) FILTER (c_custkey % 50 = 0) AS cover FROM customer GROUP BY 1)
        SELECT c_nationkey, 1 AS seq, 'CRITICAL' AS priority, 'Dam safety' AS category, NULL::DOUBLE AS figure FROM n UNION ALL SELECT c_nationkey, 2, 'CRITICAL', 'Storm drainage', CASE WHEN drains > 0 THEN drains / 10.0::DOUBLE ELSE 0.0 END FROM n
        UNION ALL SELECT c_nationkey, 3, 'HIGH', 'Water retention', floor(runoff) FROM n WHERE runoff > 4000 UNION ALL SELECT c_nationkey, 4, 'HIGH', 'Green infrastructure', cover::DOUBLE FROM n WHERE cover > 0"""),
    "category_items": (category_items, f"""WITH p AS (SELECT k, tag, 's' || (k % 3) AS sub FROM {g.POI}), f AS (SELECT tag, string_agg(k::VARCHAR, ';' ORDER BY k) AS first FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY k) AS n FROM p) WHERE n <= 20 GROUP BY tag),
        s AS (SELECT tag, sum(n)::BIGINT AS n, string_agg(sub || '=' || n, ';' ORDER BY sub) AS subs FROM (SELECT tag, sub, count(*) AS n FROM p GROUP BY ALL) GROUP BY tag) SELECT tag, n, subs, first FROM s JOIN f USING (tag)"""),
    "coverage_cells": (coverage_cells, f"""SELECT idx, n, round(least(100.0::DOUBLE, area / 1000000 * 100), 2) AS coverage, round(area / n, 1) AS mean_area FROM (SELECT {q_space._IDX} AS idx, count(*) AS n, coalesce(sum(CASE WHEN k % 7 <> 0 THEN k % 50 * 1000.0::DOUBLE END), 0.0::DOUBLE) AS area FROM {g.POI} WHERE {q_space._IN} GROUP BY 1)"""),
    "flag_near": (flag_near, f"""WITH p AS (SELECT {q_space._IDX} AS idx, max((tag = 7)::INT) AS police FROM {g.POI} WHERE {q_space._IN} GROUP BY 1)
        SELECT a.idx, max(b.police) > 0 AS near FROM p a JOIN p b ON abs(a.idx // 40 - b.idx // 40) <= 2 AND abs(a.idx % 40 - b.idx % 40) <= 2 GROUP BY a.idx"""),
    "stop_cells": (stop_cells, f"SELECT {q_space._IDX} AS idx, count(*) AS stops, max(k % 9) AS routes, min(CASE WHEN k % 4 <> 0 THEN k % 31 END) AS headway FROM {g.POI} WHERE tag = 5 AND {q_space._IN} GROUP BY 1"),
    "trip_metrics": (trip_metrics, """SELECT l_returnflag AS kind, grouping(l_returnflag)::INT AS all_kinds, count(*) AS n, round(avg(l_quantity * 10), 4) AS mean_s, max(l_quantity * 10) AS max_s, round(avg(l_extendedprice / (l_quantity * 10)), 4) AS mean_speed,
        round(count(*) FILTER (l_discount > 0.05) / count(*)::DOUBLE, 6) AS waited FROM lineitem GROUP BY ROLLUP (l_returnflag)"""),
    "bottlenecks": (bottlenecks, f"""WITH s AS {_SEG} (SELECT 'bottleneck' AS list, k FROM s WHERE betweenness IS NOT NULL ORDER BY betweenness DESC, k LIMIT 20) UNION ALL (SELECT 'critical', k FROM s WHERE critical ORDER BY k LIMIT 50)"""),
}
