"""Queries of the smaller city models, service gaps, junctions and exports, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import city, geo
from ..operators import spatial_joins, tables
from . import geography as g

c = F.col


def building_heights(spark, d):
    p = g.table(spark, d, "part")
    k = c("p_partkey")
    height, floors = F.when(k % 5 == 0, (k % 40).cast("double")), F.when(k % 5 == 1, (k % 12).cast("double"))
    use = F.element_at(F.array(*map(F.lit, ("commercial", "industrial", "residential"))), (k % 3 + 1).cast("int"))
    return p.select("p_partkey", F.round(city.building_height(height, floors, use, (k % 900).cast("double"), c("p_brand")), 5).alias("metres"))


def inundation_days(spark, d):
    """Flooded cells and mean depth per day's discharge ratio: cells meet a constant array of ratios."""
    x = g.table(spark, d, "orders").select((c("o_custkey") % 60 / 10.0).alias("ground"), F.explode(F.array(*[F.lit(v) for v in (0.8, 1.4, 2.0, 3.0)])).alias("ratio"))
    depth = city.flood_depth(c("ratio"), F.lit(0.25), c("ground"), F.lit(1.0))
    return x.withColumn("m", depth).groupBy("ratio").agg(F.count_if(c("m") > 0).alias("flooded"), F.round(F.avg("m"), 6).alias("mean_m"))


def bivariate_classes(spark, d):
    x = F.when(c("l_linenumber") != 3, c("l_quantity") * 2)
    return g.table(spark, d, "lineitem").groupBy(city.bivariate_class(x, c("l_extendedprice") / 1000).alias("class")).agg(F.count("*").alias("n"))


def low_lying(spark, d):
    k = c("k")
    e = lambda s: ((k * s) % 97 / 4.0).cast("double")
    around = F.array(F.when(k % 7 != 0, e(11)), e(13), F.when(k % 5 != 0, e(17)), F.lit(None).cast("double"))
    r = city.relative_elevation(F.when(k % 9 != 0, e(19)), around)
    return g.sites(spark, d).select("k", r.alias("r")).select("k", F.round("r.relative", 6).alias("relative"), "r.low_lying")


def junction_severity(spark, d):
    """Junctions of at least four lines by their arterial classes (0 trunk, 1 to 3 other arterials)."""
    ends = F.explode(F.array(F.struct(F.round("lat1", 5).alias("y"), F.round("lon1", 5).alias("x")), F.struct(F.round("lat2", 5).alias("y"), F.round("lon2", 5).alias("x"))))
    n = g.roads(spark, d).select("class", ends.alias("p")).groupBy("p").agg(F.count("*").alias("degree"), F.count_if(c("class") <= 3).alias("arterials"), F.bool_or(c("class") == 0).alias("trunk"))
    rank = lambda s: F.element_at(F.create_map(*[v for i, k in enumerate(("LOW", "MEDIUM", "HIGH", "CRITICAL")) for v in (F.lit(k), F.lit(i))]), s)
    s = n.filter("degree >= 4").withColumn("severity", city.junction_severity(c("degree"), c("arterials"), c("trunk")))
    return s.orderBy(rank(c("severity")).desc(), c("degree").desc(), c("p.y"), c("p.x")).limit(40).select(c("p.y").alias("lat"), c("p.x").alias("lon"), "degree", "severity")


def corridor_congestion(spark, d):
    ratio, level = city.corridor_level(c("l_quantity") * 20 + 300, c("l_linenumber") * 130.0)
    return g.table(spark, d, "lineitem").groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.round(F.max(ratio), 2).alias("worst"))


def scenario_compare(spark, d):
    """Metrics of two runs side by side with a verdict each."""
    x = g.table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.sum(F.when(c("l_returnflag") == "A", c("l_quantity"))).alias("a"), F.sum(F.when(c("l_returnflag") == "R", c("l_quantity"))).alias("b"))
    return x.select("l_linenumber", (c("b") - c("a")).alias("change"), F.round((c("b") - c("a")) / c("a") * 100, 4).alias("pct"), city.verdict(c("a"), c("b"), c("l_linenumber") % 2 == 0).alias("verdict"))


def weight_validation(spark, d):
    """Weights from an untrusted source: unknown, zero and infinite entries go, the rest is held to [-1, 1]."""
    k = c("c_custkey")
    w = F.create_map(F.lit("green"), (k % 5 - 2).cast("double"), F.lit("made_up"), F.lit(1.0), F.lit("safety"), F.when(k % 3 == 0, float("inf")).otherwise((k % 7 - 3) / 4.0), F.lit("tourism"), (k % 2) * 0.5)
    v = city.valid_weights(w, ["green", "safety", "tourism"])
    return g.table(spark, d, "customer").select("c_custkey", v.alias("v")).select("c_custkey", F.try_element_at("v", F.lit("green")).alias("green"), F.try_element_at("v", F.lit("safety")).alias("safety"), F.try_element_at("v", F.lit("tourism")).alias("tourism"), city.primary_score(c("v")).alias("primary"))


def calendar_periods(spark, d):
    o = g.table(spark, d, "orders")
    return o.groupBy(city.eight_day_period(c("o_orderdate").cast("date")).alias("p"), city.decade(F.year("o_orderdate")).alias("decade")).agg(F.count("*").alias("n")).select(F.date_format("p", "yyyy-MM-dd").alias("period"), "decade", "n")


def ndvi_trend_by_date(spark, d):
    """Slope per day on real dates, with a direction."""
    o = g.table(spark, d, "orders").select((c("o_custkey") % 50).alias("k"), F.unix_date(c("o_orderdate").cast("date")).cast("double").alias("day"), (c("o_totalprice") / 400000).alias("v"))
    s = o.groupBy("k").agg(F.regr_slope("v", "day").alias("slope"))
    return s.select("k", F.round(c("slope") * 1000, 6).alias("per_1000_days"), F.when(c("slope") > 1e-4, "up").when(c("slope") < -1e-4, "down").otherwise("stable").alias("direction"))


def service_gaps(spark, d):
    """Sites within the norm of the nearest facility: share covered, gaps, and the worst site."""
    near = spatial_joins.nearest_k(g.sites(spark, d), g.facilities(spark, d), 1)
    return near.agg(F.round(F.count_if(c("d") <= 1.5) / F.count("*") * 100, 4).alias("covered_pct"), F.count_if(c("d") > 1.5).alias("gaps"), F.round(F.max("d"), 6).alias("worst_km"), F.max_by("k", F.struct("d", -c("k"))).alias("worst_site"))


def region_first_match(spark, d):
    """The first region, in manifest order, whose closed box holds a point."""
    boxes = [("a", 22.5, 75.6, 22.7, 75.8), ("b", 22.6, 75.7, 22.8, 75.95), ("c", 22.5, 75.6, 22.9, 76.0)]
    inside = lambda b: c("lat").between(b[1], b[3]) & c("lon").between(b[2], b[4])
    name = F.coalesce(*[F.when(inside(b), b[0]) for b in boxes])
    return g.sites(spark, d).groupBy(name.alias("region")).agg(F.count("*").alias("n"))


def ward_indicators(spark, d):
    """Means over sample points per ward, against the city: ratio to the average as a 1 to 99 percentile."""
    w = g.table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg(c("c_acctbal") + 1000).alias("v"))
    mean = F.avg("v").over(Window.partitionBy())
    return w.select("c_nationkey", F.round("v", 4).alias("mean"), F.round(F.greatest(F.lit(1.0), F.least(F.lit(99.0), c("v") / mean * 50)), 4).alias("percentile"))


def reverse_edges(spark, d):
    """Lines whose reverse exists too, the longest first: one-way candidates."""
    e = g.table(spark, d, "lineitem").select((c("l_suppkey") % 40).alias("a"), (c("l_partkey") % 40).alias("b"), "l_extendedprice").filter("a <> b").groupBy("a", "b").agg(F.max("l_extendedprice").alias("m")).filter("m % 7 < 3")
    back = e.select(c("b").alias("a"), c("a").alias("b"))
    return e.join(back, ["a", "b"], "left_semi").orderBy(F.desc("m"), "a", "b").limit(15)


def digital_twin_edges(spark, d):
    """Nodes for customers' buildings and their levels, at most 60 buildings and 8 levels, with relations."""
    b = tables.top_per_key(g.table(spark, d, "customer").withColumn("one", F.lit(1)), "one", "c_acctbal", "c_custkey", 60)
    levels = b.select(F.concat(F.lit("building-"), "c_custkey").alias("source"), F.explode(F.sequence(F.lit(1), (c("c_custkey") % 8 + 1).cast("int"))).alias("level"))
    return levels.select("source", F.concat("source", F.lit("-level-"), "level").alias("target"), F.lit("hasPart").alias("relation"))


def polygon_areas(spark, d):
    """Areas of each point's rectangle by the shoelace formula on a local plane."""
    k = c("k")
    w, h = (k % 30 + 1) / 1000.0, (k % 17 + 1) / 1000.0
    p = lambda y, x: F.struct((x * 111320.0 * F.cos(F.radians("lat"))).alias("x"), (y * 111320.0).alias("y"))
    z = F.lit(0.0)
    return g.sites(spark, d).select("k", F.round(geo.shoelace(F.array(p(z, z), p(z, w), p(h, w), p(h, z))), 1).alias("m2"))


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_brand, ''), lambda ch: ascii(ch)::BIGINT)), lambda h, ch: ((xor(h, ch)::HUGEINT * 16777619) & 4294967295)::BIGINT)"
_NEAR = f"(SELECT a.k, min({g.haversine_sql('a', 'b')}) AS d FROM {g.SITE} a, {g.FACILITY} b GROUP BY a.k)"
_ENDS = f"(SELECT class, round(lat1, 5) AS lat, round(lon1, 5) AS lon FROM {g.ROAD} UNION ALL SELECT class, round(lat2, 5), round(lon2, 5) FROM {g.ROAD})"

QUERIES = {
    "building_heights": (building_heights, f"""SELECT p_partkey, round(CASE WHEN p_partkey % 5 = 0 THEN greatest(3.0::DOUBLE, p_partkey % 40) WHEN p_partkey % 5 = 1 THEN (p_partkey % 12) * 3.6::DOUBLE ELSE
        least(150.0::DOUBLE, greatest(6.0::DOUBLE, (([16, 11, 7])[p_partkey % 3 + 1] + 0.72::DOUBLE * sqrt(p_partkey % 900)) * (0.78::DOUBLE + 0.55::DOUBLE * ({_FNV} % 100000 / 100000.0::DOUBLE)))) END, 5) AS metres FROM part"""),
    "inundation_days": (inundation_days, """SELECT ratio, count(*) FILTER (m > 0) AS flooded, round(avg(m), 6) AS mean_m FROM (SELECT ratio, greatest(0.0::DOUBLE, 1.0::DOUBLE + (greatest(0.0::DOUBLE, ratio - 1) * 2.5::DOUBLE + 0.25::DOUBLE) - (o_custkey % 60) / 10.0::DOUBLE) AS m
        FROM orders, (VALUES (0.8::DOUBLE), (1.4), (2.0), (3.0)) r(ratio)) GROUP BY ratio"""),
    "bivariate_classes": (bivariate_classes, """SELECT class, count(*) AS n FROM (SELECT CASE WHEN l_linenumber <> 3 THEN (CASE WHEN l_extendedprice / 1000 < 40 THEN 0 WHEN l_extendedprice / 1000 < 70 THEN 1 ELSE 2 END) * 3 + CASE WHEN l_quantity * 2 < 40 THEN 0 WHEN l_quantity * 2 < 70 THEN 1 ELSE 2 END END AS class
        FROM lineitem) GROUP BY class"""),
    "low_lying": (low_lying, f"""SELECT k, round(o - m, 6) AS relative, o < m - 2 AS low_lying FROM (SELECT k, CASE WHEN k % 9 <> 0 THEN (k * 19) % 97 / 4.0::DOUBLE END AS o,
        list_avg([CASE WHEN k % 7 <> 0 THEN (k * 11) % 97 / 4.0::DOUBLE END, (k * 13) % 97 / 4.0::DOUBLE, CASE WHEN k % 5 <> 0 THEN (k * 17) % 97 / 4.0::DOUBLE END]) AS m FROM {g.SITE})"""),
    "junction_severity": (junction_severity, f"""SELECT lat, lon, degree, severity FROM (SELECT *, CASE WHEN degree >= 6 OR (a >= 2 AND t) THEN 'CRITICAL' WHEN a >= 2 OR degree >= 5 THEN 'HIGH' WHEN a >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM
        (SELECT lat, lon, count(*) AS degree, count(*) FILTER (class <= 3) AS a, bool_or(class = 0) AS t FROM {_ENDS} GROUP BY ALL HAVING count(*) >= 4)) ORDER BY list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity) DESC, degree DESC, lat, lon LIMIT 40"""),
    "corridor_congestion": (corridor_congestion, """SELECT level, count(*) AS n, round(max(round(r, 2)), 2) AS worst FROM (SELECT r, CASE WHEN r < 1.1::DOUBLE THEN 'FREE_FLOW' WHEN r < 1.3::DOUBLE THEN 'LIGHT' WHEN r < 1.6::DOUBLE THEN 'MODERATE' WHEN r < 2 THEN 'HEAVY' ELSE 'SEVERE' END AS level
        FROM (SELECT (l_quantity * 20 + 300) / (l_linenumber * 130.0::DOUBLE) AS r FROM lineitem)) GROUP BY level"""),
    "scenario_compare": (scenario_compare, """SELECT l_linenumber, b - a AS change, round((b - a) / a * 100, 4) AS pct, CASE WHEN a = b THEN 'SAME' WHEN (b < a) = (l_linenumber % 2 = 0) THEN 'BETTER' ELSE 'WORSE' END AS verdict
        FROM (SELECT l_linenumber, sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY 1)"""),
    "weight_validation": (weight_validation, """SELECT c_custkey, g AS green, s AS safety, t AS tourism, (list_sort([{'w': -abs(x.w), 'k': x.k} FOR x IN [{'k': 'green', 'w': g}, {'k': 'safety', 'w': s}, {'k': 'tourism', 'w': t}] IF x.w IS NOT NULL]))[1].k AS "primary"
        FROM (SELECT c_custkey, nullif(greatest(-1, least(1, c_custkey % 5 - 2)), 0)::DOUBLE AS g, CASE WHEN c_custkey % 3 <> 0 THEN nullif((c_custkey % 7 - 3) / 4.0::DOUBLE, 0) END AS s, nullif(c_custkey % 2 * 0.5::DOUBLE, 0) AS t FROM customer)"""),
    "calendar_periods": (calendar_periods, """SELECT strftime(date_trunc('year', o_orderdate)::DATE + ((dayofyear(o_orderdate) - 1) // 8 * 8)::INT, '%Y-%m-%d') AS period, (year(o_orderdate) // 10 * 10) || 's' AS decade, count(*) AS n FROM orders GROUP BY ALL"""),
    "ndvi_trend_by_date": (ndvi_trend_by_date, """SELECT k, round(s * 1000, 6) AS per_1000_days, CASE WHEN s > 1e-4 THEN 'up' WHEN s < -1e-4 THEN 'down' ELSE 'stable' END AS direction
        FROM (SELECT o_custkey % 50 AS k, regr_slope(o_totalprice / 400000, (o_orderdate::DATE - DATE '1970-01-01')::DOUBLE) AS s FROM orders GROUP BY 1)"""),
    "service_gaps": (service_gaps, f"SELECT round(count(*) FILTER (d <= 1.5) / count(*)::DOUBLE * 100, 4) AS covered_pct, count(*) FILTER (d > 1.5) AS gaps, round(max(d), 6) AS worst_km, arg_max(k, {{'d': d, 'k': -k}}) AS worst_site FROM {_NEAR}"),
    "region_first_match": (region_first_match, f"""SELECT CASE WHEN lat BETWEEN 22.5::DOUBLE AND 22.7::DOUBLE AND lon BETWEEN 75.6::DOUBLE AND 75.8::DOUBLE THEN 'a' WHEN lat BETWEEN 22.6::DOUBLE AND 22.8::DOUBLE AND lon BETWEEN 75.7::DOUBLE AND 75.95::DOUBLE THEN 'b'
        WHEN lat BETWEEN 22.5::DOUBLE AND 22.9::DOUBLE AND lon BETWEEN 75.6::DOUBLE AND 76.0::DOUBLE THEN 'c' END AS region, count(*) AS n FROM {g.SITE} GROUP BY 1"""),
    "ward_indicators": (ward_indicators, "SELECT c_nationkey, round(v, 4) AS mean, round(greatest(1.0::DOUBLE, least(99.0::DOUBLE, v / avg(v) OVER () * 50)), 4) AS percentile FROM (SELECT c_nationkey, avg(c_acctbal + 1000) AS v FROM customer GROUP BY 1)"),
    "reverse_edges": (reverse_edges, """WITH e AS (SELECT a, b, max(l_extendedprice) AS m FROM (SELECT l_suppkey % 40 AS a, l_partkey % 40 AS b, l_extendedprice FROM lineitem) WHERE a <> b GROUP BY ALL HAVING max(l_extendedprice) % 7 < 3)
        SELECT a, b, m FROM e WHERE (b, a) IN (SELECT (a, b) FROM e) ORDER BY m DESC, a, b LIMIT 15"""),
    "digital_twin_edges": (digital_twin_edges, """SELECT 'building-' || c_custkey AS source, 'building-' || c_custkey || '-level-' || l AS target, 'hasPart' AS relation FROM (SELECT c_custkey, unnest(range(1, c_custkey % 8 + 2)) AS l FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 60))"""),
    "polygon_areas": (polygon_areas, f"SELECT k, round((k % 30 + 1) / 1000.0::DOUBLE * 111320.0::DOUBLE * cos(radians(lat)) * ((k % 17 + 1) / 1000.0::DOUBLE * 111320.0::DOUBLE), 1) AS m2 FROM {g.SITE}"),
}
