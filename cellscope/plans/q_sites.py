"""Queries of sun, sight, building stocks, streets and water near buildings, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import buildings, streets, sun
from ..operators import sight
from . import geography as g

c = F.col
RADIUS_M = 400.0


def _moments(spark, d):
    o = g.table(spark, d, "orders")
    lat, lon = g.at(c("o_custkey"), 7919, 6007)
    s = F.unix_date(c("o_orderdate").cast("date")) * 86400 + c("o_orderkey") % 1440 * 60
    return o.select("o_orderkey", lat, lon, s.cast("double").alias("s")).withColumn("e", sun.elements(sun.centuries(c("s"))))


def solar_position(spark, d):
    p = sun.position(c("lat"), c("lon"), c("s"), c("e"))
    return _moments(spark, d).select("o_orderkey", p.alias("p")).select("o_orderkey", F.round("p.altitude", 3).alias("altitude"), F.round("p.azimuth", 3).alias("azimuth"))


def day_length(spark, d):
    """Length of the day at latitudes from pole to pole."""
    lat = (c("o_orderkey") % 37 * 5 - 90) * 0.99
    return _moments(spark, d).select("o_orderkey", sun.day_length(lat, c("e.decl")).alias("p")).select("o_orderkey", F.round("p.hours", 4).alias("hours"), F.round("p.rise", 4).alias("rise"), "p.polar")


def sun_peak(spark, d):
    """The highest altitude of each day's quarter hours."""
    a = sun.day_altitudes(c("lat"), c("e.decl"))
    return _moments(spark, d).select("o_orderkey", F.round(F.array_max(F.transform(a, lambda v: v["altitude"])), 3).alias("peak"), F.size(a).alias("samples"))


def _heights(spark, d):
    k = c("p_partkey") - 1
    return g.table(spark, d, "part").select(F.floor(k / 40).alias("row"), (k % 40).alias("col"), ((k * 37) % 50).cast("double").alias("v"))


def viewshed(spark, d):
    r = _heights(spark, d)
    at = (c("row") * 40 + c("col")) % 97 == 45
    return sight.viewshed(r, r.filter(at).select((c("row") * 40 + c("col")).alias("k"), "row", "col"), radius=6)


def building_metrics(spark, d):
    """Stock metrics around each brand's centre from one grouped pass; an area's zone comes from its key."""
    k = c("p_partkey")
    levels = F.when(k % 4 != 0, k % 9 + 1)
    p = g.table(spark, d, "part").select("p_brand", levels.alias("levels"), (k % 3).alias("type"), F.when(k % 2 == 0, 1950 + k % 75).alias("year"))
    low, mid, high = c("levels") < 3, c("levels").between(3, 6), c("levels") > 6
    s = p.groupBy("p_brand").agg(
        F.count("*").alias("n"), F.round(F.avg("levels"), 1).alias("levels"), F.array(*[F.count_if(x) for x in (low, mid, high)]).alias("bands"),
        F.array(*[F.count_if(c("type") == i) for i in range(3)]).alias("types"), F.count("year").alias("aged"), F.count_if(c("year") >= 2010).alias("recent"),
    )
    zone = F.substring("p_brand", 7, 2).cast("int") % 13
    return s.select(
        "p_brand", buildings.density_per_ha(c("n"), RADIUS_M).alias("per_ha"), buildings.floor_space_index(c("n"), c("levels"), RADIUS_M).alias("fsi"),
        buildings.ground_coverage(c("n"), RADIUS_M).alias("gcr"), buildings.diversity(c("bands")).alias("height_mix"), buildings.diversity(c("types")).alias("type_mix"),
        buildings.verticality(c("levels")).alias("vertical"), buildings.modern_share(c("recent"), c("aged")).alias("modern"), buildings.urban_form(c("n"), c("levels"), zone).alias("form"),
    )


def building_levels(spark, d):
    """Counts, means, upper median and spread of levels; the median from counted values, no list is gathered."""
    k = c("p_partkey")
    v = g.table(spark, d, "part").select((k % 5).alias("g"), (k * 7 % 11 + 1).alias("v")).groupBy("g", "v").agg(F.count("*").alias("n"))
    own = Window.partitionBy("g")
    w = v.withColumn("upto", F.sum("n").over(own.orderBy("v"))).withColumn("all", F.sum("n").over(own))
    s = w.groupBy("g").agg(
        F.max("all").alias("n"), F.round(F.sum(c("v") * c("n")) / F.max("all"), 1).alias("mean"), F.max("v").alias("most"),
        F.min(F.when(c("upto") > F.floor(c("all") / 2), c("v"))).alias("median"), F.sum(c("v") * c("v") * c("n")).alias("sq"), F.sum(c("v") * c("n")).alias("sum"),
    )
    spread = F.sqrt(c("sq") / c("n") - c("mean") * 2 * c("sum") / c("n") + c("mean") * c("mean"))
    return s.select("g", "n", "mean", "most", "median", F.round(spread, 4).alias("spread"))


def _ring(k):
    p = lambda a, b: F.struct(((k * a) % 23).cast("long").alias("x"), ((k * b) % 19).cast("long").alias("y"))
    return F.array(p(3, 5), p(7, 2), p(11, 13), p(3, 5))


def footprint_orientation(spark, d):
    k = c("c_custkey")
    r = F.transform(_ring(k), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    m = buildings.vertex_mean(r)
    return g.table(spark, d, "customer").select("c_custkey", F.round(buildings.orientation(r), 4).alias("angle"), F.round(m["x"], 4).alias("x"), F.round(m["y"], 4).alias("y"))


def footprint_dxf(spark, d):
    k = c("c_custkey")
    return g.table(spark, d, "customer").select("c_custkey", buildings.dxf_ring(_ring(k), "BUILDINGS", k % 3).alias("dxf"))


def road_widths(spark, d):
    k = c("p_partkey")
    tag = F.when(k % 5 == 0, F.concat((k % 9).cast("string"), F.lit(" m"))).when(k % 5 == 1, "wide")
    lanes = F.when(k % 3 == 0, (k % 4).cast("string"))
    kind = F.element_at(F.array(*map(F.lit, ("trunk", "tertiary", "steps", "bridleway"))), (k % 4 + 1).cast("int"))
    return g.table(spark, d, "part").select("p_partkey", streets.width(tag, lanes, kind).alias("metres"))


def crowd_force(spark, d):
    k = c("o_orderkey")
    mood = F.element_at(F.array(*map(F.lit, ("peaceful", "tense", "riot", "unknown"))), (k % 4 + 1).cast("int"))
    f = streets.force(k % 6000, mood)
    return g.table(spark, d, "orders").select("o_orderkey", streets.crowd_radius(k % 6000).alias("radius_m"), f.alias("f")).select("o_orderkey", "radius_m", "f.total", "f.officers", "f.reserves", "f.commanders")


def crowd_spread(spark, d):
    e = g.facilities(spark, d).select("k", "lat", "lon", (c("k") % 6000 + 100).alias("people"))
    s = g.sites(spark, d).select(c("k").alias("t"), "lat", "lon", (c("k") % 400 * 1.5 + 10).alias("area"))
    return sight.crowd_spread(e, s).select("k", "segments", F.round("placed", 4).alias("placed"))


QUESTIONS = ("What should be built here?", "Is the air quality poor, and the FSI?", "How dense is each building?", "Nearest metro or hospital", "Is land affordable?", "Tell me more", "what do we lack", "solar on a warehouse")


def question_context(spark, d):
    q = F.element_at(F.array(*map(F.lit, QUESTIONS)), (c("c_custkey") % 8 + 1).cast("int"))
    return g.table(spark, d, "customer").groupBy(streets.context(q).alias("context")).agg(F.count("*").alias("n"))


def _reply():
    k = c("c_custkey").cast("string")
    return F.concat(F.lit("Here it is.\n[ACTION] Fly_To lat:"), k, F.lit(" name:'two words' lat: 7\n\n\n\nMore\n  [ACTION] layer id:\"a b\"\nno [ACTION] here"))


def reply_directives(spark, d):
    x = g.table(spark, d, "customer").select("c_custkey", F.posexplode(streets.directives(_reply())).alias("i", "a"))
    get = lambda n: F.try_element_at("a.params", F.lit(n)).alias(n)
    return x.select("c_custkey", "i", "a.type", get("lat"), get("name"), get("id"), F.try_element_at("a.numbers", F.lit("lat")).alias("lat_number"))


def reply_text(spark, d):
    return g.table(spark, d, "customer").groupBy(streets.without_directives(_reply()).alias("shown")).agg(F.count("*").alias("n"))


def utilities(spark, d):
    k = c("l_linenumber")
    n = g.table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(k.isin(1, 2) & (c("l_quantity") > 48)).alias("overhead"), F.count_if((k == 3) & (c("l_quantity") > 48)).alias("cables"),
        F.count_if((k == 4) & (c("l_quantity") > 48)).alias("stations"), F.count_if((k == 5) & (c("l_quantity") > 49)).alias("transformers"), F.max("l_partkey").alias("m"),
    )
    s = streets.noise(F.when(c("m") % 10 != 0, c("m") % 101 * 1.0))
    return n.select("l_suppkey", streets.electricity(c("overhead"), c("cables"), c("stations"), c("transformers")).alias("supply"), s["value"].alias("noise"), s["status"].alias("status"))


def walking_rings(spark, d):
    """Walking discs of some minutes: radius, walking time back, and the extent of the ring."""
    m = (c("k") % 4 + 1) * 5
    r = g.sites(spark, d).select("k", streets.walking_radius(m).alias("r"), streets.circle(c("lat"), c("lon"), streets.walking_radius(m)).alias("ring"))
    axis = lambda n: F.transform("ring", lambda p: p[n])
    return r.select("k", F.round("r", 3).alias("radius_m"), F.round(streets.walking_seconds(c("r")), 3).alias("seconds"), F.size("ring").alias("points"), F.round(F.array_max(axis("lat")), 7).alias("north"), F.round(F.array_min(axis("lon")), 7).alias("west"))


def dates_in_names(spark, d):
    k, day = c("o_orderkey"), c("o_orderdate").cast("date")
    name = F.when(k % 4 == 0, F.date_format(day, "'scene_'yyyyMMdd'.tif'")).when(k % 4 == 1, F.date_format(day, "'s2-'yyyy-MM-dd")).when(k % 4 == 2, F.date_format(day, "yyyy_MM_dd'_b4'")).otherwise("undated.tif")
    return g.table(spark, d, "orders").groupBy(streets.date_in_name(name).alias("date")).agg(F.count("*").alias("n"))


def encroachments(spark, d):
    """Buildings by distance to water (buffers of 300, 600 and 1,000 m on these sparse points), else by depth."""
    near = sight.nearest_within(g.sites(spark, d), g.pois(spark, d).filter("tag in (12, 13)"), 1.0)
    depth = (c("k") % 8) / 10.0
    x = g.sites(spark, d).join(near, "k", "left").select("k", "t", c("d").alias("km"), sight.encroachment(c("d") * 1000, depth, (300.0, 600.0, 1000.0)).alias("e"))
    return x.filter("e is not null").select("k", c("t").alias("water"), F.round("km", 6).alias("km"), "e.risk", "e.action")


def _elements_sql() -> str:
    n = lambda x: f"{x}::DOUBLE"
    si, co = lambda x: f"sin(radians({x}))", lambda x: f"cos(radians({x}))"
    lat, lon = (f"({n(b)} + ((o_custkey*{s})%4000)/10000.0::DOUBLE)" for b, s in ((22.5, 7919), (75.6, 6007)))
    a = f"SELECT o_orderkey, {lat} AS lat, {lon} AS lon, ((o_orderdate::DATE - DATE '1970-01-01') * 86400 + o_orderkey % 1440 * 60)::DOUBLE AS s FROM orders"
    b = f"SELECT *, (s / {n(86400)} + {n(2440587.5)} - {n(2451545)}) / {n(36525)} AS t FROM ({a})"
    l0 = f"{n(280.46646)} + t * ({n(36000.76983)} + t * {n(0.0003032)})"
    e = f"SELECT *, (({l0}) % 360 + 360) % 360 AS l0, {n(357.52911)} + t * ({n(35999.05029)} - t * {n(0.0001537)}) AS m, {n(125.04)} - t * {n(1934.136)} AS node, {n(0.016708634)} - t * ({n(0.000042037)} + t * {n(0.0000001267)}) AS ecc FROM ({b})"
    ctr = f"{si('m')} * ({n(1.914602)} - t * ({n(0.004817)} + t * {n(0.000014)})) + {si('2 * m')} * ({n(0.019993)} - t * {n(0.000101)}) + {si('3 * m')} * {n(0.000289)}"
    tilt = f"{n(23)} + ({n(26)} + ({n(21.448)} - t * ({n(46.815)} + t * ({n(0.00059)} - t * {n(0.001813)}))) / 60) / 60 + {co('node')} * {n(0.00256)}"
    h = f"SELECT *, l0 + {ctr} - {n(0.00569)} - {si('node')} * {n(0.00478)} AS app, {tilt} AS tilt FROM ({e})"
    return f"SELECT *, degrees(asin({si('tilt')} * {si('app')})) AS decl, tan(radians(tilt / 2)) ** 2 AS y FROM ({h})"


_E = _elements_sql()
_EQ = "4 * degrees(y * sin(radians(2 * l0)) - 2 * ecc * sin(radians(m)) + 4 * ecc * y * sin(radians(m)) * cos(radians(2 * l0)) - 0.5::DOUBLE * y * y * sin(radians(4 * l0)) - 1.25::DOUBLE * ecc * ecc * sin(radians(2 * m)))"
_UP = "sin(radians(lat)) * sin(radians(decl)) + cos(radians(lat)) * cos(radians(decl)) * "
_AREA = repr(buildings.disc_area(RADIUS_M)) + "::DOUBLE"
_MIX = "CASE WHEN list_sum({0}) > 0 THEN round(least(100.0::DOUBLE, list_sum(list_transform(list_filter({0}, lambda v: v > 0), lambda v: -v / list_sum({0})::DOUBLE * log2(v / list_sum({0})::DOUBLE))) / log2(greatest(2, len(list_filter({0}, lambda v: v > 0)))) * 100), 0) ELSE 0.0::DOUBLE END"
_HEIGHTS = "(SELECT (p_partkey - 1) // 40 AS r, (p_partkey - 1) % 40 AS c, (((p_partkey - 1) * 37) % 50)::DOUBLE AS v FROM part)"
_P = [f"((c_custkey * {a}) % {m})" for a, m in ((3, 23), (5, 19), (7, 23), (2, 19), (11, 23), (13, 19))]
_EDGES = ", ".join(f"{{'dx': ({_P[2 * ((i + 1) % 3)]} - {_P[2 * i]})::DOUBLE, 'dy': ({_P[2 * ((i + 1) % 3) + 1]} - {_P[2 * i + 1]})::DOUBLE}}" for i in range(3))
_XY = lambda i: f"'\n10\n' || {_P[2 * i]} || '\n20\n' || {_P[2 * i + 1]}"
_CONTEXT = "CASE " + " ".join(f"WHEN regexp_matches(lower(q), '{p}') THEN '{n}'" for n, p in streets.CONTEXTS) + " ELSE 'general' END"
_REPLY = """'Here it is.\n[ACTION] Fly_To lat:' || c_custkey || ' name:''two words'' lat: 7\n\n\n\nMore\n  [ACTION] layer id:"a b"\nno [ACTION] here'"""
_WATER = f"(SELECT s.k, arg_min(w.k, {{'d': {g.haversine_sql('s', 'w')}, 'k': w.k}}) AS t, min({g.haversine_sql('s', 'w')}) AS d FROM {g.SITE} s, {g.POI} w WHERE w.tag IN (12, 13) AND {g.haversine_sql('s', 'w')} <= 1 GROUP BY s.k)"
_RISK = "CASE WHEN d * 1000 <= 300 THEN {} WHEN d * 1000 <= 600 THEN {} WHEN d * 1000 <= 1000 THEN {} WHEN k % 8 > 5 THEN {} END"

QUERIES = {
    "solar_position": (solar_position, f"""SELECT o_orderkey, round(90 - z, 3) AS altitude, round(CASE WHEN ha > 0 THEN (a + 180) % 360 ELSE (540 - a) % 360 END, 3) AS azimuth FROM
        (SELECT *, degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (sin(radians(lat)) * cos(radians(z)) - sin(radians(decl))) / (cos(radians(lat)) * sin(radians(z))))))) AS a FROM
        (SELECT *, degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {_UP} cos(radians(ha)))))) AS z FROM
        (SELECT *, (((o_orderkey % 1440 + {_EQ} + 4 * lon) % 1440 + 1440) % 1440) / 4 - 180 AS ha FROM ({_E}))))"""),
    "day_length": (day_length, f"""SELECT o_orderkey, round(CASE WHEN x <= -1 THEN 24.0::DOUBLE WHEN x >= 1 THEN 0.0::DOUBLE ELSE 2 * h END, 4) AS hours, round(12 - h, 4) AS rise, CASE WHEN x <= -1 THEN 'day' WHEN x >= 1 THEN 'night' END AS polar FROM
        (SELECT *, CASE WHEN abs(x) < 1 THEN degrees(acos(x)) / 15 END AS h FROM (SELECT o_orderkey, (-0.014537808::DOUBLE - sin(radians(p)) * sin(radians(decl))) / (cos(radians(p)) * cos(radians(decl))) AS x
        FROM (SELECT *, (o_orderkey % 37 * 5 - 90) * 0.99::DOUBLE AS p FROM ({_E}))))"""),
    "sun_peak": (sun_peak, f"SELECT o_orderkey, round(list_max(list_transform(range(0, 1441, 15), lambda i: degrees(asin(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {_UP} cos(radians((i / 60.0::DOUBLE - 12) * 15)))))))), 3) AS peak, 97 AS samples FROM ({_E})"),
    "viewshed": (viewshed, f"""WITH r AS {_HEIGHTS}, t AS (SELECT o.r * 40 + o.c AS k, o.r AS oy, o.c AS ox, o.v + 1.7::DOUBLE AS eye, t.r, t.c, t.v, sqrt(((t.r - o.r) ** 2 + (t.c - o.c) ** 2)::DOUBLE) AS far FROM r o, r t WHERE (o.r * 40 + o.c) % 97 = 45 AND (t.r - o.r) ** 2 + (t.c - o.c) ** 2 <= 36),
        w AS (SELECT k, oy, ox, eye, r, c, far, ceil(far) AS n, unnest(range(1, ceil(far)::BIGINT)) AS s FROM t), m AS (SELECT w.k, w.r, w.c, max((h.v - eye) / (far * (s / n) * 9)) AS most FROM w JOIN r h ON h.r = floor(oy + (w.r - oy) * (s / n) + 0.5::DOUBLE) AND h.c = floor(ox + (w.c - ox) * (s / n) + 0.5::DOUBLE) GROUP BY ALL)
        SELECT t.k, t.r AS "row", t.c AS col FROM t LEFT JOIN m ON t.k = m.k AND t.r = m.r AND t.c = m.c WHERE far = 0 OR most IS NULL OR (t.v - eye) / (far * 9) >= most - 1e-6"""),
    "building_metrics": (building_metrics, f"""SELECT p_brand, round(n / ({_AREA} / 10000), 1) AS per_ha, round(n * 120.0::DOUBLE * CASE WHEN lv > 0 THEN lv ELSE 1.5::DOUBLE END / {_AREA}, 2) AS fsi, round(least(1.0::DOUBLE, n * 120.0::DOUBLE / {_AREA}), 3) AS gcr,
        {_MIX.format('b')} AS height_mix, {_MIX.format('t')} AS type_mix, CASE WHEN lv > 0 THEN round(least(100.0::DOUBLE, lv / 5 * 100), 0) ELSE 0.0::DOUBLE END AS vertical, CASE WHEN aged > 0 THEN round(recent / aged::DOUBLE * 100, 0) END AS modern,
        CASE WHEN z BETWEEN 1 AND 3 THEN 'Dense Urban Core' WHEN z BETWEEN 4 AND 6 THEN 'Open Urban' WHEN z = 7 THEN 'Informal Settlement' WHEN z = 8 THEN 'Commercial / Warehouse' WHEN z = 9 THEN 'Peri-Urban' WHEN z = 10 THEN 'Industrial Zone'
        WHEN lv >= 5 THEN 'High-Rise Zone' WHEN lv >= 3 THEN 'Mid-Rise Zone' WHEN n > 50 THEN 'Dense Low-Rise' ELSE 'Low-Density' END AS form
        FROM (SELECT p_brand, count(*) AS n, round(avg(l), 1) AS lv, [count(*) FILTER (l < 3), count(*) FILTER (l BETWEEN 3 AND 6), count(*) FILTER (l > 6)] AS b, [count(*) FILTER (k % 3 = 0), count(*) FILTER (k % 3 = 1), count(*) FILTER (k % 3 = 2)] AS t,
        count(y) AS aged, count(*) FILTER (y >= 2010) AS recent, substr(p_brand, 7, 2)::INT % 13 AS z FROM (SELECT p_brand, p_partkey AS k, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 9 + 1 END AS l, CASE WHEN p_partkey % 2 = 0 THEN 1950 + p_partkey % 75 END AS y FROM part) GROUP BY p_brand)"""),
    "building_levels": (building_levels, """SELECT g, n, mean, most, median, round(sqrt(list_avg(list_transform(l, lambda v: (v - mean) ** 2))), 4) AS spread FROM (SELECT g, count(*) AS n, round(avg(v), 1) AS mean, max(v) AS most, list_sort(list(v))[count(*) // 2 + 1] AS median, list(v) AS l
        FROM (SELECT p_partkey % 5 AS g, p_partkey * 7 % 11 + 1 AS v FROM part) GROUP BY g)"""),
    "footprint_orientation": (footprint_orientation, f"""SELECT c_custkey, round(((degrees(atan2(e.dy, e.dx)) % 180) + 180) % 180, 4) AS angle, round((2 * {_P[0]} + {_P[2]} + {_P[4]}) / 4.0::DOUBLE, 4) AS x, round((2 * {_P[1]} + {_P[3]} + {_P[5]}) / 4.0::DOUBLE, 4) AS y
        FROM (SELECT *, list_reduce([{_EDGES}], lambda a, b: CASE WHEN b.dx * b.dx + b.dy * b.dy > a.dx * a.dx + a.dy * a.dy THEN b ELSE a END) AS e FROM customer)"""),
    "footprint_dxf": (footprint_dxf, f"SELECT c_custkey, '0\nLWPOLYLINE\n8\nBUILDINGS\n90\n4\n70\n1' || CASE WHEN c_custkey % 3 > 0 THEN '\n39\n' || (c_custkey % 3) ELSE '' END || {_XY(0)} || {_XY(1)} || {_XY(2)} || {_XY(0)} AS dxf FROM customer"),
    "road_widths": (road_widths, """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 AND p_partkey % 9 > 0 THEN (p_partkey % 9)::DOUBLE WHEN p_partkey % 3 = 0 AND p_partkey % 4 > 0 THEN p_partkey % 4 * 3.5::DOUBLE ELSE ([12.0::DOUBLE, 5.5, 1.5, 4.0])[p_partkey % 4 + 1] END AS metres FROM part"""),
    "crowd_force": (crowd_force, """SELECT o_orderkey, CASE WHEN p <= 500 THEN 300.0::DOUBLE WHEN p <= 1000 THEN 500 WHEN p <= 2000 THEN 800 WHEN p <= 5000 THEN 1200 ELSE 1800 END AS radius_m, t AS total, ceil(t * 0.6::DOUBLE)::BIGINT AS officers, ceil(t * 0.25::DOUBLE)::BIGINT AS reserves, ceil(t * 0.15::DOUBLE)::BIGINT AS commanders
        FROM (SELECT o_orderkey, o_orderkey % 6000 AS p, ceil((o_orderkey % 6000) / ([50, 15, 6, 50])[o_orderkey % 4 + 1]::DOUBLE)::BIGINT AS t FROM orders)"""),
    "crowd_spread": (crowd_spread, f"""SELECT k, len(l) AS segments, round(p - list_reduce(list_prepend({{'a': p, 'n': 0.0::DOUBLE, 'c': 0.0::DOUBLE}}, l), lambda a, x: {{'a': a.a - least(a.a * x.n * 0.3::DOUBLE, x.c), 'n': 0.0::DOUBLE, 'c': 0.0::DOUBLE}}).a, 4) AS placed FROM
        (SELECT k, p, list({{'a': p, 'n': 1 - d / r, 'c': area * 6}} ORDER BY d, t) AS l FROM (SELECT e.k, s.k AS t, (e.k % 6000 + 100)::DOUBLE AS p, s.k % 400 * 1.5::DOUBLE + 10 AS area, {g.haversine_sql('e', 's')} * 1000 AS d,
        CASE WHEN e.k % 6000 + 100 <= 500 THEN 300.0::DOUBLE WHEN e.k % 6000 + 100 <= 1000 THEN 500 WHEN e.k % 6000 + 100 <= 2000 THEN 800 WHEN e.k % 6000 + 100 <= 5000 THEN 1200 ELSE 1800 END AS r FROM {g.FACILITY} e, {g.SITE} s) WHERE d <= r GROUP BY k, p)"""),
    "question_context": (question_context, f"SELECT {_CONTEXT} AS context, count(*) AS n FROM (SELECT ([{', '.join(repr(q) for q in QUESTIONS)}])[c_custkey % 8 + 1] AS q FROM customer) GROUP BY 1"),
    "reply_directives": (reply_directives, """SELECT c_custkey, 0 AS i, 'fly_to' AS type, '7' AS lat, 'two words' AS name, NULL::VARCHAR AS id, 7.0::DOUBLE AS lat_number FROM customer UNION ALL SELECT c_custkey, 1, 'layer', NULL, NULL, 'a b', NULL FROM customer"""),
    "reply_text": (reply_text, f"""SELECT trim(regexp_replace(array_to_string(list_filter(string_split({_REPLY}, '\n'), lambda x: NOT regexp_matches(x, '^\\s*\\[ACTION\\]\\s')), '\n'), '\n{{3,}}', '\n\n', 'g')) AS shown, count(*) AS n FROM customer GROUP BY 1"""),
    "utilities": (utilities, """SELECT l_suppkey, CASE WHEN u > 0 AND o > 0 THEN 'mixed' WHEN u > 0 THEN 'underground' WHEN o > 0 OR s > 0 OR t > 0 THEN 'overhead' ELSE 'unknown' END AS supply, CASE WHEN m % 10 <> 0 THEN 100 - m % 101 END AS noise,
        CASE WHEN m % 10 = 0 THEN NULL WHEN 100 - m % 101 <= 25 THEN 'good' WHEN 100 - m % 101 <= 50 THEN 'moderate' WHEN 100 - m % 101 <= 70 THEN 'elevated' ELSE 'high' END AS status FROM (SELECT l_suppkey, count(*) FILTER (l_linenumber IN (1, 2) AND l_quantity > 48) AS o,
        count(*) FILTER (l_linenumber = 3 AND l_quantity > 48) AS u, count(*) FILTER (l_linenumber = 4 AND l_quantity > 48) AS s, count(*) FILTER (l_linenumber = 5 AND l_quantity > 49) AS t, max(l_partkey) AS m FROM lineitem GROUP BY 1)"""),
    "walking_rings": (walking_rings, f"""SELECT k, round(r, 3) AS radius_m, round(r * 1.3::DOUBLE / 1.4::DOUBLE, 3) AS seconds, 73 AS points, round(lat + degrees(r / 6371000.0::DOUBLE), 7) AS north, round(lon - degrees(r / 6371000.0::DOUBLE) / cos(radians(lat)), 7) AS west
        FROM (SELECT *, (k % 4 + 1) * 5 * 80.0::DOUBLE / 1.3::DOUBLE AS r FROM {g.SITE})"""),
    "dates_in_names": (dates_in_names, "SELECT CASE WHEN o_orderkey % 4 = 3 THEN 'undated.tif' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, count(*) AS n FROM orders GROUP BY 1"),
    "encroachments": (encroachments, f"""SELECT * FROM (SELECT k, t AS water, round(d, 6) AS km, {_RISK.format("'critical'", "'high'", "'moderate'", "'flood_zone'")} AS risk, {_RISK.format("'REMOVE/RELOCATE'", "'FLOOD-PROOF'", "'MONITOR'", "'FLOOD-PROOF'")} AS action
        FROM {g.SITE} s LEFT JOIN {_WATER} w USING (k)) WHERE risk IS NOT NULL"""),
}
