"""Queries of summaries, composites, growth, planning models and tile pyramids, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, num, planning
from ..operators import growth, raster, tables
from . import geography as g

c = F.col
YEARS = range(1992, 1999)


def alert_summary(spark, d):
    """Counts by category and by severity from one pass over the alerts."""
    o = g.table(spark, d, "orders")
    return o.groupingSets([["o_orderpriority"], ["o_orderstatus"]], "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


def alerts_in_scope(spark, d):
    """Alerts that name a place's state; where none does, those that name its city."""
    k = c("o_orderkey")
    x = g.table(spark, d, "orders").groupBy((c("o_custkey") % 50).alias("place")).agg(F.count_if(k % 97 == c("o_custkey") % 50).alias("state"), F.count_if(k % 3 == 0).alias("city"))
    return x.select("place", F.when(c("state") > 0, c("state")).otherwise(c("city")).alias("n"), F.when(c("state") > 0, "state").otherwise("city").alias("scope"))


def parity_worst(spark, d):
    """The ten features whose counts differ most between two sources, with their share of all differences."""
    s = g.table(spark, d, "lineitem").groupBy((c("l_partkey") % 37).alias("feature")).agg(F.count_if(c("l_returnflag") == "A").alias("pre"), F.count_if(c("l_returnflag") == "R").alias("live"))
    a = s.withColumn("delta", F.abs(c("pre") - c("live")))
    total = a.agg(F.sum("delta")).first()[0] or 1
    return a.orderBy(F.desc("delta"), "feature").limit(10).select("feature", "pre", "live", "delta", F.round(c("delta") / total, 6).alias("share"))


def scene_stats(spark, d):
    """Statistics of an index per scene; values have two digits, so a scene's median needs few distinct values."""
    v = (c("l_orderkey") * 31 + c("l_linenumber") * 17) % 201 / 100.0 - 1
    x = g.table(spark, d, "lineitem").select((c("l_suppkey") % 10).alias("scene"), v.alias("v")).groupBy("scene")
    return x.agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.median("v"), 4).alias("median"), F.round(F.stddev_pop("v"), 6).alias("std"), F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.count_if(c("v") > 0.3) / F.count("*") * 100, 4).alias("green_pct"))


def annual_composite(spark, d):
    """One band per year and cell, the mean of the year's scenes in hundredths."""
    o = g.table(spark, d, "orders").select((c("o_custkey") % 60).alias("cell"), F.year("o_orderdate").alias("y"), F.round(c("o_totalprice") * 100).cast("long").alias("v"))
    return o.groupBy("cell").pivot("y", list(YEARS)).agg(F.avg("v")).select("cell", *[c(str(y)).alias(f"b{y}") for y in YEARS])


def temporal_mosaic(spark, d):
    k = c("l_orderkey") + c("l_linenumber")
    v = F.when(k % 3 == 0, -99.0).otherwise(k % 160 / 100.0)
    return raster.mosaic(g.table(spark, d, "lineitem").select((c("l_partkey") % 30).alias("row"), (c("l_suppkey") % 10).alias("col"), v.alias("v"))).select("row", "col", F.round("v", 6).alias("v"))


def fraction_raster(spark, d):
    """A fraction raster of unknown unit: the largest value, one number, tells percent from shares."""
    v = F.when(c("k") % 11 == 0, float("nan")).otherwise(c("k") % 120 * 1.0)
    r = g.pois(spark, d).select("k", v.alias("v"))
    largest = r.filter(~F.isnan("v")).agg(F.max("v")).first()[0]
    return r.select("k", planning.unit_fraction(c("v"), F.lit(largest)).alias("fraction"))


def night_trends(spark, d):
    """Trends over the years that have a value, counted anew without the others."""
    o = g.table(spark, d, "orders")
    of = lambda y: F.avg(F.when(F.year("o_orderdate") == y, c("o_totalprice") / 977))
    s = o.groupBy("o_custkey").agg(F.array(*[of(y) for y in YEARS]).alias("s"))
    t = s.select("o_custkey", num.trend(F.filter("s", lambda v: v.isNotNull())).alias("t")).filter("t is not null")
    return t.select("o_custkey", F.round("t.slope", 4).alias("slope"), F.round("t.r2", 4).alias("r2"))


def raster_lines(spark, d):
    return growth.rasterise(g.roads(spark, d).filter("class <= 1"), 22.5, 75.6, 0.002)


def dual_graph(spark, d):
    """Neighbours of each street in the dual graph."""
    e = g.table(spark, d, "orders").select(c("o_orderkey").alias("k"), c("o_custkey").alias("u"), (c("o_custkey") + 1 + c("o_orderkey") % 5).alias("v"))
    p = growth.dual(e)
    return p.select(F.explode(F.array("a", "b")).alias("k")).groupBy("k").agg(F.count("*").alias("degree"))


def ridge_weights(spark, d):
    s = g.table(spark, d, "lineitem").select(*[F.when((c("l_orderkey") + i) % 9 != 0, c(n) % 101).alias(n) for i, n in enumerate(("l_partkey", "l_suppkey", "l_quantity"))], (c("l_extendedprice") / 1000).alias("y"))
    r = growth.ridge(s, ["l_partkey", "l_suppkey", "l_quantity"], "y")
    return spark.createDataFrame([("intercept", round(r["intercept"], 6)), *[(k, round(v, 6)) for k, v in r["weights"].items()], ("r2", round(r["r2"], 6))], "name string, value double")


def _cells(spark, d):
    k = c("p_partkey") - 1
    return g.table(spark, d, "part").select(F.floor(k / 40).alias("row"), (k % 40).alias("col"), (k * 13 % 7 == 0).alias("was"), ((k * 13 % 7 == 0) | (k * 29 % 31 < 8)).alias("now"), (k * 29 % 31).cast("double").alias("a"), (k * 17 % 23).cast("double").alias("b"))


def growth_hindcast(spark, d):
    """Learned on the cells' first period, held against a second one in which the next cells of the same kind turn."""
    x = _cells(spark, d).select("row", "col", c("was").alias("first"), c("now").alias("middle"), (c("now") | (c("a") < 12)).alias("last"), "a", "b")
    return growth.hindcast(x, ["a", "b"], steps=1).select(F.round("merit", 4).alias("merit"), F.round("kappa", 4).alias("kappa"), "demand")


def growth_potential(spark, d):
    p = growth.transition_potential(_cells(spark, d), ["a", "b"])
    return p.select("row", "col", F.round("potential", 4).alias("potential"))


def growth_projection(spark, d):
    x = _cells(spark, d)
    return growth.project(x.select("row", "col", c("was").cast("int").alias("v")), x.select("row", "col", (c("a") / 31).alias("potential")), 20, 3).select("row", "col", F.round("p", 6).alias("p"))


def carbon_scores(spark, d):
    k = c("l_orderkey")
    x = g.table(spark, d, "lineitem")
    return x.groupBy(planning.carbon(k % 80, k % 30, k % 101, F.when(k % 5 != 0, k % 6), k % 90).alias("carbon"), planning.efficiency(k % 80, k % 90, k % 101).alias("efficiency")).agg(F.count("*").alias("n"))


def emergency_readiness(spark, d):
    k = c("k")
    return g.sites(spark, d).select("k", F.round(planning.readiness(k % 3, k % 2, k % 5, F.when(k % 7 != 0, k % 101)), 4).alias("score"))


def intervention_scores(spark, d):
    k = c("k")
    m = F.create_map(F.lit("connectivity"), k % 101 * 1.0, F.lit("walkability"), F.lit(3.0), F.lit("safety"), k % 50 * 1.0)
    r = planning.intervene(m, "widen_road")
    return g.sites(spark, d).select("k", *[F.try_element_at(r, F.lit(n)).alias(n) for n in ("connectivity", "walkability", "safety", "noise_estimate", "commercial")])


def oneway_pair_scores(spark, d):
    k = c("l_orderkey")
    s = planning.pair_score(k % 3 == 0, k % 4 == 0, c("l_quantity") * 20, c("l_partkey") % 900 * 1.0, c("l_suppkey") * 7.0, k % 11 == 0, c("l_linenumber") > 2)
    return g.table(spark, d, "lineitem").groupBy(F.round(s, 2).alias("score")).agg(F.count("*").alias("n"))


def census_indicators(spark, d):
    """Indicators of each nation's people against the whole."""
    k = c("c_custkey")
    n = g.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("people"), F.count_if(k % 3 == 0).alias("workers"), F.count_if(k % 7 == 0).alias("children"), F.count_if(k % 4 != 0).alias("literate"))
    whole = Window.partitionBy()
    state = F.sum("literate").over(whole) / F.sum("people").over(whole) * 100
    return n.select("c_nationkey", planning.share(c("people") - c("workers"), c("workers")).alias("dependency"), planning.share(c("children"), c("people")).alias("children_pct"), F.round(c("literate") / c("people") * 100 - state, 2).alias("literacy_delta"))


def edge_metrics(spark, d):
    """Metrics per edge over all intervals; negative speeds are missing, inner edges take no part."""
    x = g.table(spark, d, "lineitem").filter(c("l_suppkey") % 10 != 0)
    speed = F.when(c("l_linenumber") != 4, c("l_quantity") / 4)
    return x.groupBy("l_suppkey").agg(
        F.round(F.coalesce(F.avg(speed), F.lit(0.0)) * 3.6, 1).alias("kmh"), F.round(F.avg("l_discount"), 2).alias("density"), F.sum(c("l_partkey") % 20).alias("entered"), F.count("*").alias("samples"),
    )


def charging_summary(spark, d):
    """Stations around a place: nearest, fast ones, points, and the first four operators by distance."""
    k = c("o_orderkey")
    s = g.table(spark, d, "orders").select((k % 40).alias("place"), (k * 7 % 83 / 10.0).alias("km"), F.when(k % 6 != 0, k % 120).alias("kw"), (k % 5).alias("points"), F.concat(F.lit("op"), (k % 7).cast("string")).alias("op"))
    first = s.groupBy("place", "op").agg(F.count("*").alias("n"), F.min("km").alias("km"), F.count_if(c("kw") >= 50).alias("fast"), F.sum("points").alias("points"))
    ops = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("km", "op"))), 1, 4), lambda v: v["op"])
    return first.groupBy("place").agg(F.sum("n").alias("n"), F.min("km").alias("nearest"), F.sum("fast").alias("fast"), F.sum("points").alias("points"), F.array_join(ops, ",").alias("operators"))


def tile_pyramid(spark, d):
    """Points per tile from zoom 10 to 14; points within 5 % of an edge are in the neighbour too."""
    x, y = planning.world_x(c("lon")), planning.world_y(c("lat"))
    tiles = F.flatten(F.array(*[planning.covering_tiles(x, y, z) for z in range(10, 15)]))
    return g.pois(spark, d).select("tag", F.explode(tiles).alias("t")).groupBy("t.z", "t.x", "t.y").agg(F.count("*").alias("n"), F.count_if(c("tag") == 3).alias("health"))


def merged_trips(spark, d):
    """Trips of two files by departure, with new ids from 0."""
    o = g.table(spark, d, "orders")
    half = lambda r: o.filter(c("o_orderkey") % 2 == r).select(c("o_orderkey").alias("trip"), (c("o_orderkey") * 37 % 3600).alias("depart"))
    return tables.sequential_ids(half(0).unionByName(half(1)), ["depart", "trip"])


def drainage_density(spark, d):
    """Length and density of lines by class."""
    m = geo.haversine(c("lat1"), c("lon1"), c("lat2"), c("lon2"))
    return g.roads(spark, d).groupBy("class").agg(F.count("*").alias("n"), F.round(F.sum(m), 4).alias("km"), F.round(F.sum(m) / 1800, 6).alias("per_km2"))


def site_briefs(spark, d):
    x = g.table(spark, d, "customer")
    word = F.when(c("c_acctbal") >= 5000, "strong").when(c("c_acctbal") >= 0, "fair").otherwise("weak")
    return x.select("c_custkey", F.concat_ws("\n", F.concat(F.lit("Site "), c("c_custkey").cast("string")), F.concat(F.lit("Segment: "), c("c_mktsegment")), F.concat(F.lit("Outlook: "), word)).alias("brief"))


def comparison_sheet(spark, d):
    """Tab-separated lines of segments by score columns, one line a segment."""
    s = g.table(spark, d, "customer").groupBy("c_mktsegment", (c("c_nationkey") % 5).alias("r")).agg(F.count("*").alias("n"))
    cells = F.array_sort(F.collect_list(F.struct("r", "n")))
    return s.groupBy("c_mktsegment").agg(F.concat_ws("\t", F.first("c_mktsegment"), F.transform(cells, lambda v: v["n"].cast("string"))).alias("line"))


def score_fields(spark, d):
    """An array of values and its field names as a map, and labelled scores as plain values."""
    k = c("k")
    names = F.array(F.lit("green"), F.lit("safety"), F.lit("noise"))
    m = F.map_from_arrays(names, F.array(k % 100, k % 7, k % 3))
    labelled = F.transform_values(m, lambda n, v: F.struct(F.upper(n).alias("label"), v.alias("value")))
    flat = F.transform_values(labelled, lambda _, v: v["value"])
    return g.sites(spark, d).select("k", F.explode(flat).alias("name", "value"))


def annual_rain(spark, d):
    o = g.table(spark, d, "orders").withColumn("mm", F.when(c("o_orderkey") % 6 != 0, c("o_totalprice") / 10000))
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(F.round(F.sum("mm"), 1).alias("mm"), F.count_distinct(F.when(c("mm").isNotNull(), c("o_orderdate"))).alias("days"))


def surface_water(spark, d):
    """Cells by how often they held water: permanent, seasonal, rare, never."""
    v = c("l_quantity") * 2
    kind = num.band(v, [(0, "never"), (25, "rare"), (75, "seasonal")], "permanent")
    return g.table(spark, d, "lineitem").groupBy(kind.alias("kind")).agg(F.count("*").alias("cells"))


_TX, _TY = "(lon + 180) / 360", "0.5::DOUBLE - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * 3.141592653589793::DOUBLE)"
_SPAN = "unnest(range(greatest(0, floor({0} * n - 0.05::DOUBLE))::BIGINT, least(n - 1, floor({0} * n + 0.05::DOUBLE))::BIGINT + 1))"
_HELD = lambda x: f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, {x}))"
_K = "l_orderkey"

QUERIES = {
    "alert_summary": (alert_summary, "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus))"),
    "alerts_in_scope": (alerts_in_scope, "SELECT place, CASE WHEN s > 0 THEN s ELSE c END AS n, CASE WHEN s > 0 THEN 'state' ELSE 'city' END AS scope FROM (SELECT o_custkey % 50 AS place, count(*) FILTER (o_orderkey % 97 = o_custkey % 50) AS s, count(*) FILTER (o_orderkey % 3 = 0) AS c FROM orders GROUP BY 1)"),
    "parity_worst": (parity_worst, """SELECT feature, pre, live, delta, round(delta / t::DOUBLE, 6) AS share FROM (SELECT *, abs(pre - live) AS delta, sum(abs(pre - live)) OVER () AS t FROM (SELECT l_partkey % 37 AS feature, count(*) FILTER (l_returnflag = 'A') AS pre, count(*) FILTER (l_returnflag = 'R') AS live FROM lineitem GROUP BY 1)) ORDER BY delta DESC, feature LIMIT 10"""),
    "scene_stats": (scene_stats, """SELECT scene, round(avg(v), 6) AS mean, round(median(v), 4) AS median, round(stddev_pop(v), 6) AS std, min(v) AS low, max(v) AS high, round(count(*) FILTER (v > 0.3::DOUBLE) / count(*)::DOUBLE * 100, 4) AS green_pct
        FROM (SELECT l_suppkey % 10 AS scene, (l_orderkey * 31 + l_linenumber * 17) % 201 / 100.0::DOUBLE - 1 AS v FROM lineitem) GROUP BY scene"""),
    "annual_composite": (annual_composite, "SELECT o_custkey % 60 AS cell, " + ", ".join(f"avg(round(o_totalprice * 100)::BIGINT) FILTER (year(o_orderdate) = {y}) AS b{y}" for y in YEARS) + " FROM orders GROUP BY 1"),
    "temporal_mosaic": (temporal_mosaic, """SELECT l_partkey % 30 AS "row", l_suppkey % 10 AS col, round(coalesce(avg(CASE WHEN (l_orderkey + l_linenumber) % 3 <> 0 THEN least(1.0::DOUBLE, (l_orderkey + l_linenumber) % 160 / 100.0::DOUBLE) END), 0), 6) AS v FROM lineitem GROUP BY ALL"""),
    "fraction_raster": (fraction_raster, f"SELECT k, CASE WHEN k % 11 = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, (k % 120) / 100.0::DOUBLE) END AS fraction FROM {g.POI}"),
    "night_trends": (night_trends, """SELECT o_custkey, round(regr_slope(v, x), 4) AS slope, round(regr_r2(v, x), 4) AS r2 FROM (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY y) - 1)::DOUBLE AS x FROM
        (SELECT o_custkey, year(o_orderdate) AS y, avg(o_totalprice / 977) AS v FROM orders WHERE year(o_orderdate) BETWEEN 1992 AND 1998 GROUP BY ALL)) GROUP BY o_custkey HAVING count(*) >= 3"""),
    "raster_lines": (raster_lines, f"""SELECT DISTINCT floor((lat1 + (lat2 - lat1) * i / n - 22.5::DOUBLE) / 0.002::DOUBLE)::BIGINT AS "row", floor((lon1 + (lon2 - lon1) * i / n - 75.6::DOUBLE) / 0.002::DOUBLE)::BIGINT AS col FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM
        (SELECT *, greatest(1, ceil(greatest(abs(lat2 - lat1), abs(lon2 - lon1)) / 0.001::DOUBLE))::BIGINT AS n FROM {g.ROAD} WHERE class <= 1))"""),
    "dual_graph": (dual_graph, """WITH e AS (SELECT o_orderkey AS k, unnest([o_custkey, o_custkey + 1 + o_orderkey % 5]) AS node FROM orders), p AS (SELECT DISTINCT a.k AS a, b.k AS b FROM e a JOIN e b ON a.node = b.node AND a.k < b.k)
        SELECT k, count(*) AS degree FROM (SELECT unnest([a, b]) AS k FROM p) GROUP BY k"""),
    "ridge_weights": (ridge_weights, None),
    "growth_potential": (growth_potential, None),
    "growth_projection": (growth_projection, None),
    "growth_hindcast": (growth_hindcast, None),
    "carbon_scores": (carbon_scores, f"""SELECT floor({_HELD(f'least({_K} % 80 / 50.0::DOUBLE, 1) * 30 + least({_K} % 30 / 20.0::DOUBLE, 1) * 25 + {_K} % 101 / 100.0::DOUBLE * 20 + CASE WHEN {_K} % 5 <> 0 THEN least({_K} % 6 / 3.0::DOUBLE, 1) * 15 ELSE 0 END - {_K} % 90 / 100.0::DOUBLE * 25')} + 0.5::DOUBLE)::BIGINT AS carbon,
        floor({_HELD(f'25 + least({_K} % 80 / 30.0::DOUBLE, 1) * 25 + greatest(0, 100 - {_K} % 90) / 100.0::DOUBLE * 25 + {_K} % 101 / 100.0::DOUBLE * 25')} + 0.5::DOUBLE)::BIGINT AS efficiency, count(*) AS n FROM lineitem GROUP BY ALL"""),
    "emergency_readiness": (emergency_readiness, f"SELECT k, round(least(100.0::DOUBLE, CASE WHEN k % 3 > 0 THEN 30 ELSE 0 END + CASE WHEN k % 2 > 0 THEN 30 ELSE 0 END + CASE WHEN k % 5 > 0 THEN 20 ELSE 0 END + CASE WHEN k % 7 <> 0 THEN k % 101 ELSE 0 END * 0.2::DOUBLE), 4) AS score FROM {g.SITE}"),
    "intervention_scores": (intervention_scores, f"SELECT k, least(100.0::DOUBLE, k % 101 + 20) AS connectivity, 0.0::DOUBLE AS walkability, (k % 50)::DOUBLE AS safety, 0.0::DOUBLE AS noise_estimate, 5.0::DOUBLE AS commercial FROM {g.SITE}"),
    "oneway_pair_scores": (oneway_pair_scores, """SELECT round(CASE WHEN l_orderkey % 3 = 0 THEN 30.0::DOUBLE ELSE 0 END + CASE WHEN l_orderkey % 4 = 0 THEN 30 ELSE 0 END + least(l_quantity * 20 / 50 + l_partkey % 900 / 50.0::DOUBLE, 40) / 2 + CASE WHEN l_suppkey * 7 BETWEEN 80 AND 250 THEN 20 ELSE 0 END
        + CASE WHEN l_orderkey % 11 = 0 THEN 15 ELSE 0 END + CASE WHEN l_linenumber > 2 THEN 10 ELSE 0 END, 2) AS score, count(*) AS n FROM lineitem GROUP BY 1"""),
    "census_indicators": (census_indicators, """SELECT c_nationkey, CASE WHEN w > 0 THEN round((p - w) / w::DOUBLE * 100, 2) END AS dependency, round(ch / p::DOUBLE * 100, 2) AS children_pct, round(l / p::DOUBLE * 100 - (sum(l) OVER ()) / (sum(p) OVER ())::DOUBLE * 100, 2) AS literacy_delta FROM
        (SELECT c_nationkey, count(*) AS p, count(*) FILTER (c_custkey % 3 = 0) AS w, count(*) FILTER (c_custkey % 7 = 0) AS ch, count(*) FILTER (c_custkey % 4 <> 0) AS l FROM customer GROUP BY 1)"""),
    "edge_metrics": (edge_metrics, """SELECT l_suppkey, round(coalesce(avg(CASE WHEN l_linenumber <> 4 THEN l_quantity / 4 END), 0) * 3.6::DOUBLE, 1) AS kmh, round(avg(l_discount), 2) AS density, sum(l_partkey % 20)::BIGINT AS entered, count(*) AS samples FROM lineitem WHERE l_suppkey % 10 <> 0 GROUP BY 1"""),
    "charging_summary": (charging_summary, """SELECT place, sum(n)::BIGINT AS n, min(km) AS nearest, sum(fast)::BIGINT AS fast, sum(points)::BIGINT AS points, array_to_string(list(op ORDER BY km, op)[1:4], ',') AS operators FROM (SELECT place, op, count(*) AS n, min(km) AS km, count(*) FILTER (kw >= 50) AS fast, sum(points) AS points FROM
        (SELECT o_orderkey % 40 AS place, o_orderkey * 7 % 83 / 10.0::DOUBLE AS km, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 120 END AS kw, o_orderkey % 5 AS points, 'op' || (o_orderkey % 7) AS op FROM orders) GROUP BY ALL) GROUP BY place"""),
    "tile_pyramid": (tile_pyramid, f"""SELECT z, x, y, count(*) AS n, count(*) FILTER (tag = 3) AS health FROM (SELECT tag, z, n, x, {_SPAN.format('ty')} AS y FROM (SELECT tag, z, n, ty, {_SPAN.format('tx')} AS x FROM
        (SELECT tag, z, 2 ** z::BIGINT AS n, {_TX} AS tx, {_TY} AS ty FROM {g.POI}, (SELECT unnest(range(10, 15))::INT AS z)))) GROUP BY ALL"""),
    "merged_trips": (merged_trips, "SELECT o_orderkey AS trip, o_orderkey * 37 % 3600 AS depart, row_number() OVER (ORDER BY o_orderkey * 37 % 3600, o_orderkey) - 1 AS id FROM orders"),
    "drainage_density": (drainage_density, f"SELECT class, count(*) AS n, round(sum(d), 4) AS km, round(sum(d) / 1800, 6) AS per_km2 FROM (SELECT a.class, {g.haversine_sql('a', 'b')} AS d FROM (SELECT k, class, lat1 AS lat, lon1 AS lon FROM {g.ROAD}) a JOIN (SELECT k, lat2 AS lat, lon2 AS lon FROM {g.ROAD}) b USING (k)) GROUP BY class"),
    "site_briefs": (site_briefs, """SELECT c_custkey, 'Site ' || c_custkey || '\nSegment: ' || c_mktsegment || '\nOutlook: ' || CASE WHEN c_acctbal >= 5000 THEN 'strong' WHEN c_acctbal >= 0 THEN 'fair' ELSE 'weak' END AS brief FROM customer"""),
    "comparison_sheet": (comparison_sheet, """SELECT c_mktsegment, c_mktsegment || '\t' || string_agg(n::VARCHAR, '\t' ORDER BY r) AS line FROM (SELECT c_mktsegment, c_nationkey % 5 AS r, count(*) AS n FROM customer GROUP BY ALL) GROUP BY 1"""),
    "score_fields": (score_fields, f"SELECT k, unnest(['green', 'safety', 'noise']) AS name, unnest([k % 100, k % 7, k % 3]) AS value FROM {g.SITE}"),
    "annual_rain": (annual_rain, "SELECT year(o_orderdate) AS year, round(sum(mm), 1) AS mm, count(DISTINCT CASE WHEN mm IS NOT NULL THEN o_orderdate END) AS days FROM (SELECT o_orderdate, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice / 10000 END AS mm FROM orders) GROUP BY 1"),
    "surface_water": (surface_water, "SELECT CASE WHEN l_quantity * 2 <= 0 THEN 'never' WHEN l_quantity * 2 <= 25 THEN 'rare' WHEN l_quantity * 2 <= 75 THEN 'seasonal' ELSE 'permanent' END AS kind, count(*) AS cells FROM lineitem GROUP BY 1"),
}
