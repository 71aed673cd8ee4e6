"""Queries of property outlooks, flood zones, street pairs and record helpers, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import estate, geo, models
from ..operators import flood, sight, spatial_joins
from . import geography as g

c = F.col
KEYS = list(estate.FACTORS)


def _values(k):
    return F.create_map(*[x for i, n in enumerate(KEYS) for x in (F.lit(n), F.when((k + i) % (i % 4 + 2) != 0, (k * (i + 3) % 103).cast("double")))])


def estate_outlooks(spark, d):
    """The outlook of every site for four intents, in one pass."""
    s = g.spread(g.sites(spark, d).select("k"), "k").select("k", _values(c("k")).alias("v"))
    per = F.array(*[F.struct(F.lit(i).alias("intent"), estate.outlook(c("v"), i).alias("o")) for i in estate.INTENTS])
    return s.select("k", F.explode(per).alias("x")).select("k", "x.intent", "x.o.score", "x.o.band", "x.o.confidence", "x.o.used", "x.o.low", "x.o.mid", "x.o.high")


def estate_drivers(spark, d):
    o = estate.outlook(_values(c("k")), "invest")
    return g.spread(g.sites(spark, d).select("k"), "k").select("k", o.alias("o")).select("k", "o.lifted", "o.held")


def factor_values(spark, d):
    k = c("k")
    return g.sites(spark, d).select(
        "k", F.round(estate.flood_safety(F.when(k % 3 != 0, k % 50 / 10.0), F.when(k % 2 == 0, k % 120 * 1.0)), 6).alias("flood"), F.round(estate.air_quality(k % 400 * 1.0), 6).alias("air"),
        F.round(estate.share_or_score(k % 7 / 4.0), 6).alias("expansion"),
    )


KINDS = ("water", "depression", "low", "channel", "seasonal", "permanent")


def flood_zones(spark, d):
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (c("tag") % 6 + 1).cast("int"))
    e = g.pois(spark, d).select(c("k").alias("t"), kind.alias("kind"), "lat", "lon")
    return flood.zones(g.sites(spark, d), e, 35.0)


def culvert_sites(spark, d):
    """Channel points within 500 m of a road's start: the nearest road, closest first."""
    channels = g.pois(spark, d).filter("tag = 13")
    roads = g.roads(spark, d).filter("class <= 3").select("k", c("lat1").alias("lat"), c("lon1").alias("lon"))
    n = sight.nearest_within(channels, roads, 0.5)
    return n.select("k", c("t").alias("road"), F.round("d", 6).alias("km"), F.when(c("d") < 0.05, "crossing").otherwise("near").alias("kind"))


def gauge_coverage(spark, d):
    """Candidate sites farther than 2 km from every gauge."""
    s = g.sites(spark, d)
    near = spatial_joins.place_pairs(s, g.facilities(spark, d), 2.0).select("lat", "lon").distinct()
    return s.join(near.hint("merge"), ["lat", "lon"], "left_anti").select("k")


def grade_fallback(spark, d):
    """The stored grade, else one from the class's usual capacity."""
    k = c("o_orderkey")
    stored = F.when(k % 3 == 0, F.lit("B"))
    return g.table(spark, d, "orders").groupBy(F.coalesce(stored, models.level_of_service(k % 130 / 100.0)).alias("grade")).agg(F.count("*").alias("n"))


def line_middles(spark, d):
    """Middle vertex and length of lines of four vertices."""
    p = lambda t: F.struct((c("lat1") + (c("lat2") - c("lat1")) * t).alias("lat"), (c("lon1") + (c("lon2") - c("lon1")) * t).alias("lon"))
    r = g.roads(spark, d).select("k", F.array(*[p(t) for t in (0.0, 0.25, 0.5, 1.0)]).alias("v"))
    parts = F.zip_with(F.slice("v", 1, F.size("v") - 1), F.slice("v", 2, F.size("v") - 1), lambda a, b: geo.haversine(a["lat"], a["lon"], b["lat"], b["lon"]))
    mid = F.get("v", F.floor(F.size("v") / 2).cast("int"))
    return r.select("k", F.round(mid["lat"], 6).alias("lat"), F.round(mid["lon"], 6).alias("lon"), F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), 6).alias("km"))


def sample_centres(spark, d):
    """Centres of a 5 by 5 grid over each nation's box of sites."""
    s = g.table(spark, d, "customer").select("c_nationkey", *g.at(c("c_custkey"), 7919, 6007)).groupBy("c_nationkey").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    i = F.explode(F.sequence(F.lit(0), F.lit(24)))
    x = s.withColumn("i", i)
    at = lambda low, high, j: F.round(c(low) + (c(high) - c(low)) * (j + 0.5) / 5, 7)
    return x.select("c_nationkey", "i", at("s", "n", F.floor(c("i") / 5)).alias("lat"), at("w", "e", c("i") % 5).alias("lon"))


def box_relations(spark, d):
    """Boxes that overlap, touch or miss a window; touching counts as intersecting."""
    k = c("c_custkey")
    s, w = k % 20, k * 3 % 20
    hit = (s <= 10) & (s + 4 >= 5) & (w <= 12) & (w + 3 >= 6)
    inner = (s < 10) & (s + 4 > 5) & (w < 12) & (w + 3 > 6)
    return g.table(spark, d, "customer").groupBy(F.when(inner, "overlap").when(hit, "touch").otherwise("miss").alias("relation")).agg(F.count("*").alias("n"))


def ward_numbers(spark, d):
    """Ward numbers from the first of several fields that holds digits; a record's status by what it has."""
    k = c("c_custkey")
    a, b = F.when(k % 3 == 0, F.concat(F.lit("Ward No. "), (k % 40).cast("string"))), F.when(k % 2 == 0, F.concat(F.lit("W-"), (k % 9).cast("string")))
    digits = lambda v: F.regexp_replace(v, r"\D", "").try_cast("int")
    n = F.coalesce(digits(a), digits(b))
    return g.table(spark, d, "customer").select("c_custkey", n.alias("ward"), F.when(n.isNotNull(), "ok").otherwise("unavailable").alias("status"))


def _outlook_sql(intent: str) -> str:
    w = estate.weights_of(intent)
    v = [f"(CASE WHEN (k + {i}) % {i % 4 + 2} <> 0 THEN least(100.0::DOUBLE, k * {i + 3} % 103) END)" for i in range(len(KEYS))]
    top = " + ".join(f"coalesce({w[n]!r}::DOUBLE * {v[i]}, 0)" for i, n in enumerate(KEYS))
    low = " + ".join(f"CASE WHEN {v[i]} IS NULL THEN 0 ELSE {w[n]!r}::DOUBLE END" for i, n in enumerate(KEYS))
    used = " + ".join(f"({v[i]} IS NOT NULL)::INT" for i in range(len(KEYS)))
    return f"SELECT k, '{intent}' AS intent, floor(({top}) / ({low}) + 0.5::DOUBLE)::BIGINT AS score, {used} AS used FROM {g.SITE}"


def _drivers_sql() -> str:
    w = estate.weights_of("invest")
    items = ", ".join(f"{{'i': {i}, 'key': '{n}', 'c': {w[n]!r}::DOUBLE * (CASE WHEN (k + {i}) % {i % 4 + 2} <> 0 THEN least(100.0::DOUBLE, k * {i + 3} % 103) END - 50)}}" for i, n in enumerate(KEYS))
    return f"SELECT k, unnest([{items}]) AS f FROM {g.SITE}"


_NEAR = lambda kind, km: f"EXISTS (SELECT 1 FROM e WHERE e.kind = '{kind}' AND {g.haversine_sql('s', 'e')} < {km}::DOUBLE)"
_MID = lambda a, t: f"({a}1 + ({a}2 - {a}1) * {t}::DOUBLE)"
_LEG = lambda s, t: g.haversine_sql("a", "b").replace("b.lat", _MID("lat", t)).replace("a.lat", _MID("lat", s)).replace("b.lon", _MID("lon", t)).replace("a.lon", _MID("lon", s))

QUERIES = {
    "estate_outlooks": (estate_outlooks, "SELECT * EXCLUDE (m, h), round(m - h, 1) AS low, round(m, 1) AS mid, round(m + h, 1) AS high FROM (SELECT k, intent, score, CASE WHEN score >= 70 THEN 'strong' WHEN score >= 58 THEN 'above' WHEN score >= 43 THEN 'stable' WHEN score >= 30 THEN 'soft' ELSE 'weak' END AS band, CASE WHEN used >= 10.8 THEN 'high' WHEN used >= 6.3 THEN 'medium' ELSE 'low' END AS confidence, used, 6.0::DOUBLE + (score - 50) / 50.0::DOUBLE * 6.0::DOUBLE AS m, CASE WHEN used >= 10.8 THEN 1.5::DOUBLE WHEN used >= 6.3 THEN 2.5 ELSE 4 END AS h FROM (" + " UNION ALL ".join(_outlook_sql(i) for i in estate.INTENTS) + "))"),
    "estate_drivers": (estate_drivers, f"""SELECT k, coalesce(array_to_string(list(f.key ORDER BY abs(round(f.c, 1)) DESC, f.i) FILTER (f.c > 0 AND round(f.c, 1) <> 0)[1:3], ','), '') AS lifted, coalesce(array_to_string(list(f.key ORDER BY abs(round(f.c, 1)) DESC, f.i) FILTER (f.c < 0 AND round(f.c, 1) <> 0)[1:3], ','), '') AS held FROM ({_drivers_sql()}) GROUP BY k"""),
    "factor_values": (factor_values, f"""SELECT k, round(CASE WHEN k % 3 <> 0 THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 - (k % 50 / 10.0::DOUBLE - 1) * (100 / 3.0::DOUBLE))) WHEN k % 2 = 0 THEN 100.0::DOUBLE - least(100.0::DOUBLE, k % 120) END, 6) AS flood,
        round(greatest(0.0::DOUBLE, 100 - k % 400 / 300.0::DOUBLE * 100), 6) AS air, round(least(100.0::DOUBLE, CASE WHEN k % 7 / 4.0::DOUBLE <= 1 THEN k % 7 / 4.0::DOUBLE * 100 ELSE k % 7 / 4.0::DOUBLE END), 6) AS expansion FROM {g.SITE}"""),
    "flood_zones": (flood_zones, f"""WITH e AS (SELECT k AS t, ([{', '.join(repr(k) for k in KINDS)}])[tag % 6 + 1] AS kind, lat, lon FROM {g.POI}), z AS (SELECT s.k, (SELECT min({g.haversine_sql('s', 'e')}) FROM e WHERE kind = 'water') AS w, {_NEAR('depression', 0.5)} AS d, {_NEAR('low', 0.5)} AS l, {_NEAR('channel', 0.5)} AS ch,
        (SELECT arg_min(e.kind, e.t) FROM e WHERE e.kind IN ('seasonal', 'permanent') AND {g.haversine_sql('s', 'e')} < 0.8::DOUBLE) AS p FROM {g.SITE} s)
        SELECT k, score, CASE WHEN score >= 50 THEN 'critical' WHEN score >= 35 THEN 'high' WHEN score >= 20 THEN 'moderate' ELSE 'low' END AS level FROM (SELECT k, CASE WHEN w < 0.5 THEN 25 WHEN w < 1.5 THEN 15 WHEN w < 3 THEN 5 ELSE 0 END
        + CASE WHEN d THEN 20 ELSE 0 END + CASE WHEN l THEN 15 ELSE 0 END + CASE WHEN ch THEN 15 ELSE 0 END + CASE p WHEN 'seasonal' THEN 20 WHEN 'permanent' THEN 10 ELSE 0 END + 10 AS score FROM z)"""),
    "culvert_sites": (culvert_sites, f"""SELECT k, n.t AS road, round(n.d, 6) AS km, CASE WHEN n.d < 0.05 THEN 'crossing' ELSE 'near' END AS kind FROM (SELECT p.k, min({{'d': {g.haversine_sql('p', 'r')}, 't': r.k}}) AS n FROM {g.POI} p, (SELECT k, lat1 AS lat, lon1 AS lon FROM {g.ROAD} WHERE class <= 3) r
        WHERE p.tag = 13 AND {g.haversine_sql('p', 'r')} <= 0.5::DOUBLE GROUP BY p.k)"""),
    "gauge_coverage": (gauge_coverage, f"SELECT k FROM {g.SITE} s WHERE NOT EXISTS (SELECT 1 FROM {g.FACILITY} f WHERE {g.haversine_sql('s', 'f')} <= 2)"),
    "grade_fallback": (grade_fallback, "SELECT CASE WHEN k % 3 = 0 THEN 'B' WHEN r <= 35 THEN 'A' WHEN r <= 55 THEN 'B' WHEN r <= 75 THEN 'C' WHEN r <= 90 THEN 'D' WHEN r <= 100 THEN 'E' ELSE 'F' END AS grade, count(*) AS n FROM (SELECT o_orderkey AS k, o_orderkey % 130 AS r FROM orders) GROUP BY 1"),
    "line_middles": (line_middles, f"SELECT k, round({_MID('lat', 0.5)}, 6) AS lat, round({_MID('lon', 0.5)}, 6) AS lon, round({_LEG(0.0, 0.25)} + {_LEG(0.25, 0.5)} + {_LEG(0.5, 1.0)}, 6) AS km FROM {g.ROAD}"),
    "sample_centres": (sample_centres, f"""SELECT c_nationkey, i, round(s + (n - s) * (i // 5 + 0.5::DOUBLE) / 5, 7) AS lat, round(w + (e - w) * (i % 5 + 0.5::DOUBLE) / 5, 7) AS lon FROM (SELECT c_nationkey, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e, unnest(range(0, 25)) AS i FROM {g.SITE} JOIN customer ON k = c_custkey GROUP BY 1)"""),
    "box_relations": (box_relations, """SELECT CASE WHEN s < 10 AND s + 4 > 5 AND w < 12 AND w + 3 > 6 THEN 'overlap' WHEN s <= 10 AND s + 4 >= 5 AND w <= 12 AND w + 3 >= 6 THEN 'touch' ELSE 'miss' END AS relation, count(*) AS n FROM (SELECT c_custkey % 20 AS s, c_custkey * 3 % 20 AS w FROM customer) GROUP BY 1"""),
    "ward_numbers": (ward_numbers, """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 40 WHEN c_custkey % 2 = 0 THEN c_custkey % 9 END AS ward, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 2 = 0 THEN 'ok' ELSE 'unavailable' END AS status FROM customer"""),
}
