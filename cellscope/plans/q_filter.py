"""Queries of text and box matches, street uses, filled fields, pixels and viewports, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filters
from . import geography as g

c = F.col
# A transform with some rotation, and one without.
_TURNED = (0.5, 0.25, 75.6, 0.125, -0.5, 22.9)
_PLAIN = (0.01, 0.0, 75.6, 0.0, -0.01, 22.9)
_CLASSES = ("trunk", "primary", "footway", "cycleway", "living_street", "service", "secondary", "residential")


def _streets(spark, d):
    kinds = F.array(*map(F.lit, _CLASSES))
    k = c("o_orderkey")
    side = F.when(k % 3 == 0, "both").when(k % 3 == 1, "")
    return g.table(spark, d, "orders").select(F.element_at(kinds, (k % 8 + 1).cast("int")).alias("class"), side.alias("sidewalk"), F.when(k % 5 == 0, "lane").alias("cycleway"))


def district_match(spark, d):
    fields = [c("p_name"), F.when(c("p_partkey") % 4 > 0, c("p_brand")), c("p_type")]
    return g.table(spark, d, "part").filter(filters.mentions(fields, F.lit("COLD w"), F.lit("brand#5 econ"), F.lit(""))).select("p_partkey")


def drivable_streets(spark, d):
    return _streets(spark, d).filter(filters.drivable(c("class"))).groupBy("class").agg(F.count("*").alias("n"))


def walking_gaps(spark, d):
    use = filters.walking_use(c("class"), c("sidewalk"), c("cycleway"))
    return _streets(spark, d).withColumn("use", use).filter("use is not null").groupBy("use", "class").agg(F.count("*").alias("n"))


def roads_touching_box(spark, d):
    ends = F.array(*[F.struct(c(f"lat{i}").alias("lat"), c(f"lon{i}").alias("lon")) for i in (1, 2)])
    return g.roads(spark, d).filter(filters.touches_box(ends, 22.6, 75.7, 22.7, 75.8)).select("k")


def filled_fields(spark, d):
    k = c("p_partkey")
    first = {"k": k, "aqi": F.when(k % 3 > 0, c("p_size")), "pm25": F.when(k % 4 > 0, c("p_retailprice"))}
    second = {"aqi": F.when(k % 6 > 0, c("p_size") * 2), "pm25": c("p_retailprice") / 2}
    return g.table(spark, d, "part").select(*filters.filled(first, second))


def pixel_places(spark, d):
    k = c("p_partkey")
    return g.table(spark, d, "part").select(k.alias("k"), filters.pixel_place(k % 37, k % 41, _TURNED).alias("p")).select("k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def pixels_of_points(spark, d):
    p = filters.pixel_at(c("lon"), c("lat"), _PLAIN, 30, 30)
    return g.pois(spark, d).select("k", p.alias("p")).filter("p is not null").select("k", "p.row", "p.col")


def viewport_cells(spark, d):
    half = (c("k") % 3 + 1) / F.lit(64.0)
    box = [c("lat") - half, c("lon") - half, c("lat") + half, c("lon") + half]
    seen = g.spread(g.sites(spark, d), "k").select("k", filters.viewport_cells(*box, c("k") % 14 + 6).alias("v"))
    rows = seen.select("k", "v.level", "v.cols", F.explode("v.rows").alias("row"))
    return rows.select("k", "level", "row", F.explode("cols").alias("col")).select("k", filters.cell_code(c("row"), c("col"), c("level")).alias("code"))


_STREET = f"(SELECT ({list(_CLASSES)!r})[o_orderkey % 8 + 1] AS class, CASE o_orderkey % 3 WHEN 0 THEN 'both' WHEN 1 THEN '' END AS sidewalk, CASE WHEN o_orderkey % 5 = 0 THEN 'lane' END AS cycleway FROM orders)"
_LEVEL = "CASE WHEN zoom >= 18 THEN 8 WHEN zoom >= 16 THEN 7 WHEN zoom >= 14 THEN 6 WHEN zoom >= 12 THEN 5 WHEN zoom >= 10 THEN 4 WHEN zoom >= 8 THEN 3 END"

QUERIES = {
    "district_match": (district_match, "SELECT p_partkey FROM part WHERE lower(concat_ws(' ', p_name, CASE WHEN p_partkey % 4 > 0 THEN p_brand END, p_type)) LIKE '%cold w%' OR lower(concat_ws(' ', p_name, CASE WHEN p_partkey % 4 > 0 THEN p_brand END, p_type)) LIKE '%brand#5 econ%'"),
    "drivable_streets": (drivable_streets, f"SELECT class, count(*) AS n FROM {_STREET} WHERE class IN {filters.DRIVABLE!r} GROUP BY class"),
    "walking_gaps": (walking_gaps, f"""SELECT use, class, count(*) AS n FROM (SELECT class, CASE WHEN class IN {filters.ACTIVE!r} THEN 'active' WHEN class = 'cycleway' THEN 'cycle' WHEN class IN {filters.MAIN!r} AND coalesce(sidewalk, '') = '' AND coalesce(cycleway, '') = '' THEN 'gap' END AS use FROM {_STREET})
        WHERE use IS NOT NULL GROUP BY ALL"""),
    "roads_touching_box": (roads_touching_box, f"SELECT k FROM {g.ROAD} WHERE (lat1 BETWEEN 22.6::DOUBLE AND 22.7::DOUBLE AND lon1 BETWEEN 75.7::DOUBLE AND 75.8::DOUBLE) OR (lat2 BETWEEN 22.6::DOUBLE AND 22.7::DOUBLE AND lon2 BETWEEN 75.7::DOUBLE AND 75.8::DOUBLE)"),
    "filled_fields": (filled_fields, "SELECT p_partkey AS k, coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_size END, CASE WHEN p_partkey % 6 > 0 THEN p_size * 2 END) AS aqi, coalesce(CASE WHEN p_partkey % 4 > 0 THEN p_retailprice END, p_retailprice / 2) AS pm25 FROM part"),
    "pixel_places": (pixel_places, "SELECT p_partkey AS k, round(75.6::DOUBLE + (p_partkey % 41) * 0.5::DOUBLE + (p_partkey % 37) * 0.25::DOUBLE, 6) AS x, round(22.9::DOUBLE + (p_partkey % 41) * 0.125::DOUBLE - (p_partkey % 37) * 0.5::DOUBLE, 6) AS y FROM part"),
    "pixels_of_points": (pixels_of_points, f"""SELECT k, "row", col FROM (SELECT k, trunc((lat - 22.9::DOUBLE) / -0.01::DOUBLE)::INT AS "row", trunc((lon - 75.6::DOUBLE) / 0.01::DOUBLE)::INT AS col FROM {g.POI}) WHERE "row" BETWEEN 0 AND 29 AND col BETWEEN 0 AND 29"""),
    "viewport_cells": (viewport_cells, f"""WITH b AS (SELECT k, lat - (k % 3 + 1) / 64.0::DOUBLE AS s, lon - (k % 3 + 1) / 64.0::DOUBLE AS w, lat + (k % 3 + 1) / 64.0::DOUBLE AS n, lon + (k % 3 + 1) / 64.0::DOUBLE AS e, k % 14 + 6 AS zoom FROM {g.SITE}),
        l AS (SELECT *, {_LEVEL} AS level FROM b), t AS (SELECT *, 36.0::DOUBLE / pow(4.0::DOUBLE, level) AS step FROM l WHERE level IS NOT NULL), f AS (SELECT *, ceil((n - s) / step)::BIGINT AS high, ceil((e - w) / step)::BIGINT AS wide FROM t),
        r AS (SELECT *, unnest(range(high)) AS i FROM f WHERE high * wide <= 500), q AS (SELECT *, unnest(range(wide)) AS j FROM r), p AS (SELECT k, level, s + step * (i + 0.5::DOUBLE) AS la, w + step * (j + 0.5::DOUBLE) AS lo, n, e FROM q), x AS (SELECT k, level, {g.row_sql('la', 10)} AS y, {g.col_sql('lo', 10)} AS x FROM p WHERE la < n AND lo < e),
        z AS (SELECT DISTINCT k, substr({g.code_sql('y', 'x', 10)}, 1, level) AS code FROM x) SELECT k, concat_ws('-', substr(code, 1, 3), nullif(substr(code, 4, 3), ''), nullif(substr(code, 7), '')) AS code FROM z"""),
}
