"""Queries of shapes: areas from relations, region outlines, tessellations and vector tiles, with oracle SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import areas, raster, siting, tessellation, vector_tiles
from . import geography as g

c = F.col
# Metres to a degree of longitude and latitude about the middle of the sites.
EAST, NORTH = 102_730.0, 111_195.0


def area_relations(spark, d):
    """Rings of twelve sites mapped as twelve ways, every third the other way round; every fifth ring lacks a way."""
    s = g.sites(spark, d)
    ring, place = F.floor(c("k") / 12), c("k") % 12
    to = ring * 12 + (place + 1) % 12
    ways = s.select("k", F.when(c("k") % 3 == 0, F.array(to, "k")).otherwise(F.array("k", to)).alias("refs"))
    member = F.struct(c("k").alias("way"), F.when(c("k") % 2 == 0, "outer").otherwise("").alias("role"))
    relations = s.filter((ring % 5 != 4) | (place != 7)).groupBy(ring.alias("k")).agg(F.collect_list(member).alias("members"))
    relations = relations.withColumn("tags", F.create_map(F.lit("type"), F.when(c("k") % 7 != 6, "multipolygon").otherwise("route")))
    return areas.area_centres(s, ways, relations).select("k", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def _mask(spark, d):
    k = c("p_partkey") - 1
    return g.table(spark, d, "part").filter((c("p_size") * 7 + c("p_partkey") * 13) % 10 < 6).select(F.floor(k / 50).alias("row"), (k % 50).alias("col"))


def region_outlines(spark, d):
    """Cells and corners of each region of a mask, from its outlines."""
    r = raster.outlines(_mask(spark, d), 50)
    return r.groupBy("region").agg(F.sum("area").cast("long").alias("cells"), F.sum(F.size("points")).cast("long").alias("corners"), F.count_if(~c("hole")).alias("outer"))


def _planar(spark, d):
    return g.sites(spark, d).select("k", ((c("lon") - 75.6) * EAST).alias("x"), ((c("lat") - 22.5) * NORTH).alias("y"))


def tessellation_cells(spark, d):
    """Voronoi cells of the sites within their extent."""
    p = _planar(spark, d)
    made = tessellation.triangles(p)
    cells = tessellation.voronoi(p, made, (0.0, 0.0, 0.4 * EAST, 0.4 * NORTH))
    return cells.select("k", "neighbours", F.round(c("area") / 1e6, 4).alias("km2"), F.size("ring").alias("corners"))


def contiguous_sites(spark, d):
    return tessellation.contiguity(tessellation.triangles(_planar(spark, d)))


def vector_tiles_built(spark, d):
    """Hexagons around the places, by tile from zoom 10 to 14."""
    turn = lambda i: F.struct((c("lon") + F.lit(0.002) * F.cos(F.lit(i * 1.0471975511965976))).alias("x"), (c("lat") + F.lit(0.002) * F.sin(F.lit(i * 1.0471975511965976))).alias("y"))
    p = g.pois(spark, d).select("k", F.array(*[turn(i) for i in range(6)]).alias("ring"), c("tag").alias("class"), F.when(c("k") % 3 != 0, c("k") % 60 / 4.0).alias("height"))
    return vector_tiles.tiles(p, ["class", "height"]).select("z", "x", "y", "features", F.length("tile").alias("bytes"))


def retention_ponds(spark, d):
    """Ponds among the places, taken as depressions of a terrain of 90 m cells."""
    p = g.pois(spark, d).select((c("k") * 7919 % 1000003).alias("k"), "lat", "lon", (c("k") * 31 % 211).alias("accum"), (c("k") % 13 / 4.0).alias("depth"))
    r = siting.retention_ponds(p, 90.0, top=100)
    return r.select("k", F.round("catchment_km2", 4).alias("catchment_km2"), F.round("volume_m3", 2).alias("volume_m3"), "cells", "priority")


def pumping_stations(spark, d):
    p = g.sites(spark, d).select("k", "lat", "lon", (c("k") * 17 % 97 / 32.0).alias("depth"))
    return siting.pumping_stations(p, reach=900.0, top=100).select("k", F.round("depth", 4).alias("depth"), "priority")


def aligned_raster(spark, d):
    """The terrain's cells drawn onto a grid of another origin and cell size; some cells have no source."""
    r = g.table(spark, d, "lineitem").groupBy((c("l_partkey") % 40).alias("row"), (c("l_suppkey") % 40).alias("col")).agg(F.avg("l_quantity").alias("v"))
    return raster.aligned(r, (0.0, 40.0, 1.0, 1.0), (-2.25, 39.5, 1.5, 0.75), 60, 32).select("row", "col", F.round("v", 7).alias("v"))


def parking_zones(spark, d):
    """Parking pressure of roads named by their customer, from places of three kinds."""
    r = g.roads(spark, d).withColumns({"name": c("k") % 977, "lat": c("lat1"), "lon": c("lon1"), "category": F.element_at(F.array(*map(F.lit, ("primary", "secondary", "tertiary", "residential"))), (c("k") % 4 + 1).cast("int"))})
    p = g.sites(spark, d)
    return siting.parking_zones(r.select("name", "k", "lat", "lon", "category"), p.filter("k % 3 <> 0"), p.filter("k % 3 = 0"), g.pois(spark, d).filter("tag = 5")).select("name", "category", "demand", "supply", "stops", "segments", "pressure")


_NEAR = lambda places, km: f"(SELECT f.name, count(*) AS n FROM f JOIN {places} t ON abs(t.lat - f.lat) < 0.01 AND {g.haversine_sql('f', 't')} < {km}::DOUBLE GROUP BY f.name)"
_MASK = "(SELECT (p_partkey - 1) // 50 AS row, (p_partkey - 1) % 50 AS col, p_partkey - 1 AS id FROM part WHERE (p_size * 7 + p_partkey * 13) % 10 < 6)"

QUERIES = {
    "area_relations": (area_relations, f"""WITH r AS (SELECT s.k // 12 AS k, s.k % 12 AS place, lat, lon FROM {g.SITE} s)
        SELECT k, round((min(lat) + max(lat)) / 2, 6) AS lat, round((min(lon) + max(lon)) / 2, 6) AS lon FROM r WHERE k % 5 <> 4 AND k % 7 <> 6 GROUP BY k HAVING count(*) = 12"""),
    "region_outlines": (region_outlines, f"""WITH RECURSIVE m AS MATERIALIZED {_MASK},
        e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.row - b.row) + abs(a.col - b.col) = 1),
        f AS (SELECT id AS node, id AS label FROM m UNION SELECT e.b, f.label FROM f JOIN e ON e.a = f.node),
        n AS (SELECT node, min(label) AS region FROM f GROUP BY node),
        x AS (SELECT region, row + dr AS r, col + dc AS c, count(*) AS n, sum((dr + dc) % 2) AS odd FROM m JOIN n ON n.node = m.id, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(dr, dc) GROUP BY ALL),
        y AS (SELECT region, sum(CASE WHEN n % 2 = 1 THEN 1 WHEN n = 2 AND odd <> 1 THEN 2 ELSE 0 END)::BIGINT AS corners FROM x GROUP BY region)
        SELECT region, cells, corners, 1::BIGINT AS outer FROM (SELECT region, count(*) AS cells FROM n GROUP BY region) JOIN y USING (region)"""),
    "tessellation_cells": (tessellation_cells, None),
    "contiguous_sites": (contiguous_sites, None),
    "vector_tiles": (vector_tiles_built, None),
    "retention_ponds": (retention_ponds, None),
    "pumping_stations": (pumping_stations, None),
    "parking_zones": (parking_zones, f"""WITH f AS MATERIALIZED (SELECT k % 977 AS name, min(k) AS k, arg_min(lat1, k) AS lat, arg_min(lon1, k) AS lon, count(*) AS segments FROM {g.ROAD} GROUP BY 1),
        j AS (SELECT f.name, ['primary', 'secondary', 'tertiary', 'residential'][k % 4 + 1] AS category, coalesce(a.n, 0) AS demand, coalesce(b.n, 0) AS supply, coalesce(s.n, 0) AS stops, segments, CASE k % 4 WHEN 0 THEN 1.5 WHEN 1 THEN 1.2 ELSE 1.0 END::DOUBLE AS w FROM f
          LEFT JOIN {_NEAR(f"(SELECT * FROM {g.SITE} WHERE k % 3 <> 0)", 0.2)} a ON a.name = f.name LEFT JOIN {_NEAR(f"(SELECT * FROM {g.SITE} WHERE k % 3 = 0)", 0.3)} b ON b.name = f.name LEFT JOIN {_NEAR(f"(SELECT * FROM {g.POI} WHERE tag = 5)", 0.1)} s ON s.name = f.name)
        SELECT name, category, demand, supply, stops, segments, round(greatest(0.0::DOUBLE, (demand * 15 - supply * 10 + stops * 5) * w), 1) AS pressure FROM j"""),
    "aligned_raster": (aligned_raster, """WITH s AS (SELECT l_partkey % 40 AS r, l_suppkey % 40 AS q, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), t AS (SELECT a.i AS row, b.j AS col FROM range(60) a(i), range(32) b(j)),
        o AS (SELECT row, col, v, greatest(0.0::DOUBLE, least(q + 1.0::DOUBLE, (col + 1) * 1.5::DOUBLE - 2.25::DOUBLE) - greatest(q::DOUBLE, col * 1.5::DOUBLE - 2.25::DOUBLE))
          * greatest(0.0::DOUBLE, least(40.0::DOUBLE - r, 39.5::DOUBLE - row * 0.75::DOUBLE) - greatest(39.0::DOUBLE - r, 38.75::DOUBLE - row * 0.75::DOUBLE)) AS w FROM t, s)
        SELECT row, col, round(coalesce(sum(v * w) FILTER (w > 0) / sum(w) FILTER (w > 0), 0.0::DOUBLE), 7) AS v FROM o GROUP BY row, col"""),
}
