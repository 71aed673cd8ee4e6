"""Queries over cells, discs, grids, distances and classified elements, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import classify, grid, scores, spatial_joins
from . import geography as g

BOX = (22.5, 75.6, 22.9, 76.0)  # south, west, north, east
NY, NX = 40, 40
SHIFTS = (-13, 0, 12)  # degrees of latitude
RING = [(75.65, 22.55), (75.95, 22.6), (75.9, 22.85), (75.75, 22.7), (75.62, 22.8)]


def cell_encode(spark, d):
    s = g.sites(spark, d)
    return s.select("k", geo.encode(F.col("lat"), F.col("lon")).alias("code"))


def cell_decode(spark, d):
    s = g.sites(spark, d).select("k", geo.code_of(geo.cell_row(F.col("lat"), 8), geo.cell_col(F.col("lon"), 8), 8).alias("code"))
    c = geo.decode(F.col("code"))
    return s.select("k", "code", *[F.round(c[n], 6).alias(n) for n in ("lat", "lon", "south", "north", "west", "east")])


def cell_enumerate(spark, d):
    return grid.cells_for_bbox(spark, *BOX, 6).select("code", "row", "col", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def cell_hierarchy_rollup(spark, d):
    s = g.sites(spark, d)
    code = geo.code_of(geo.cell_row(F.col("lat"), 8), geo.cell_col(F.col("lon"), 8), 8)
    levels = F.explode(F.sequence(F.lit(4), F.lit(8)))
    return s.select(code.alias("code"), levels.alias("level")).groupBy("level", F.expr("left(code, level)").alias("ancestor")).agg(F.count("*").alias("n"))


def tag_classify(spark, d):
    return classify.classify(g.elements(spark, d))


def feature_counts(spark, d):
    return tag_classify(spark, d).groupBy("category", "feature").agg(F.count("*").alias("n"))


def disc_kernel_counts(spark, d):
    """Three times the same places, moved north and south: a disc is as many columns wide as its latitude asks for."""
    moved = lambda p: p.withColumn("by", F.explode(F.array(*map(F.lit, SHIFTS)))).withColumns({"k": F.concat_ws(":", "by", "k"), "lat": F.col("lat") + F.col("by")})
    return grid.disc_counts(moved(g.sites(spark, d)), moved(g.pois(spark, d)), "tag")


def _cell_features(spark, d):
    cells = grid.cells_for_bbox(spark, *BOX, 6).select(F.col("code").alias("k"), "lat", "lon")
    elements = g.elements(spark, d)
    kinds = classify.classify(elements).join(elements.select("k", "lat", "lon"), "k").withColumn("kind", F.concat_ws("/", "category", "feature"))
    counts = grid.disc_counts(cells, kinds, "kind", radius_m=1500.0)
    return cells, counts.select("k", F.split_part("kind", F.lit("/"), F.lit(1)).alias("category"), F.split_part("kind", F.lit("/"), F.lit(2)).alias("feature"), "cnt")


def composite_scores(spark, d):
    cells, counts = _cell_features(spark, d)
    return scores.composite(cells, counts)


def environment_scores(spark, d):
    """Scores that follow a cell's surroundings: people per hectare, ground and religions known for some cells only."""
    k = F.col("c_custkey")
    kinds = F.filter(F.array(*[F.struct(F.lit(n).alias("r"), F.when(k % m != 0, k % (m + 3)).otherwise(F.lit(0)).cast("long").alias("n")) for n, m in (("hindu", 2), ("jain", 3), ("sikh", 5), ("muslim", 7))]), lambda x: k % 4 != 3)
    cells = g.table(spark, d, "customer").select(
        k.alias("k"), F.when(k % 3 != 0, F.col("c_acctbal") / 20).alias("persons_per_hectare"), F.when(k % 5 != 0, k % 7 == 0).alias("low_lying"),
        F.when(k % 5 != 0, (k % 23 - 9).cast("double")).alias("relative_elevation"), F.when(k % 11 != 0, F.map_from_entries(kinds)).alias("religions"),
    )
    o = g.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.element_at(F.array(*[F.lit(x) for x in _AROUND]), (F.col("o_orderkey") % len(_AROUND) + 1).cast("int")).alias("f"))
    counts = o.groupBy("k", F.split_part("f", F.lit("/"), F.lit(1)).alias("category"), F.split_part("f", F.lit("/"), F.lit(2)).alias("feature")).agg(F.count("*").alias("cnt"))
    return scores.composite(cells, counts).select("k", "population_proxy", "religious_diversity", "flood_risk")


_AROUND = ("entertainment/worship", "infrastructure/river", "infrastructure/bridge", "landuse/industrial_area", "landuse/res_buildings", "shopping/convenience", "infrastructure/power")


def rank_query_topk(spark, d):
    ranked = scores.rank(composite_scores(spark, d), scores.CATALOG["family"])
    return ranked.orderBy(F.desc("score"), "k").limit(10)


def rank_catalog(spark, d):
    """The best cell of each named query: one pass over the score table for the whole catalogue."""
    return scores.rank_all(composite_scores(spark, d), top=3)


def grid_footprint(spark, d):
    p = g.pois(spark, d).withColumn("area", (F.col("k") % 50 * 10.0))
    return grid.dense_index(p, *BOX, NY, NX).groupBy("idx").agg(F.count("*").alias("n"), F.round(F.sum("area"), 3).alias("area"), F.round(F.avg("area"), 6).alias("mean_area"))


def neighbourhood_sum(spark, d):
    counts = grid.dense_index(g.pois(spark, d), *BOX, NY, NX).groupBy("idx").agg(F.count("*").alias("n"))
    return grid.neighbourhood_sum(counts, "n", NY, NX).select("idx", F.col("total").cast("long").alias("total"))


def lookup_sample(spark, d):
    counts = grid.dense_index(g.pois(spark, d), *BOX, NY, NX).groupBy("idx").agg(F.count("*").alias("n"))
    return grid.sample(g.sites(spark, d), counts, *BOX, NY, NX).select("k", "idx", "n")


def grid_segments(spark, d):
    """Length and number of lines by the grid cell of their midpoint."""
    r = g.roads(spark, d).withColumns({"lat": (F.col("lat1") + F.col("lat2")) / 2, "lon": (F.col("lon1") + F.col("lon2")) / 2})
    r = r.withColumn("m", geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), 6371000.0))
    return grid.dense_index(r, *BOX, NY, NX).groupBy("idx").agg(F.count("*").alias("n"), F.round(F.sum("m"), 2).alias("metres"), F.max("class").alias("top_class"))


def slippy_tiles(spark, d):
    s = g.sites(spark, d).select("k", geo.tile_x(F.col("lon"), 14).alias("x"), geo.tile_y(F.col("lat"), 14).alias("y"))
    return s.select("k", "x", "y", geo.quadkey(F.col("x"), F.col("y"), 14).alias("quadkey"))


def nearest_facility(spark, d):
    return spatial_joins.nearest_k(g.sites(spark, d), g.facilities(spark, d), 1).select("k", F.col("t").alias("facility"), F.round("d", 6).alias("km"))


def nearest_k(spark, d):
    return spatial_joins.nearest_k(g.sites(spark, d), g.facilities(spark, d), 4).select("k", "rank", F.round("d", 6).alias("km"))


def radius_join(spark, d):
    return spatial_joins.within(g.sites(spark, d), g.facilities(spark, d), 3.0, digits=6).select("k", F.col("t").alias("facility"), F.col("d").alias("km"))


def radius_counts(spark, d):
    s = g.sites(spark, d)
    pois = g.pois(spark, d)
    here = pois.groupBy(F.col("lat").alias("tlat"), F.col("lon").alias("tlon")).agg(F.count("*").alias("n"))
    met = spatial_joins.place_pairs(s, pois, 3.0).join(here.hint("merge"), ["tlat", "tlon"])
    near = met.groupBy("lat", "lon").agg(*[F.sum(F.when(F.col("d") <= km, F.col("n")).otherwise(0)).alias(f"n{m}") for m, km in ((1000, 1.0), (2000, 2.0), (3000, 3.0))])
    return s.join(near.hint("merge"), ["lat", "lon"], "left").select("k", "n1000", "n2000", "n3000").na.fill(0)


def bucket_segment_semi(spark, d):
    return spatial_joins.near_segments(g.pois(spark, d), g.roads(spark, d), 60.0).select("k")


def theta_pairs(spark, d):
    lines = g.roads(spark, d).filter("class = 3")
    return spatial_joins.parallel_pairs(lines, max_m=2500.0, digits=(4, 3))


def point_in_polygon(spark, d):
    return g.sites(spark, d).filter(geo.point_in_polygon(F.col("lon"), F.col("lat"), RING)).select("k")


def bearing_compass(spark, d):
    b = geo.bearing(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    names = F.array(*map(F.lit, "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()))
    return g.roads(spark, d).select("k", F.round(b, 6).alias("bearing"), F.element_at(names, (F.floor((b + 11.25) / 22.5) % 16 + 1).cast("int")).alias("compass"))


def kde_surface(spark, d):
    """Weighted Gaussian density over a 16 x 16 lattice: samples add to the lattice points in reach."""
    w = F.col("s_acctbal") / 10000.0
    s = g.table(spark, d, "supplier").select(*g.at(F.col("s_suppkey"), 7919, 6007), w.alias("w"))
    s = s.select(((F.col("lon") - 75.6) / 0.4).alias("x"), ((F.col("lat") - 22.5) / 0.4).alias("y"), "w")
    lattice = F.explode(F.sequence(F.lit(0), F.lit(255)))
    p = s.withColumn("cell", lattice)
    dx, dy = F.col("x") - (F.col("cell") % 16 + 0.5) / 16, F.col("y") - (F.floor(F.col("cell") / 16) + 0.5) / 16
    return p.groupBy("cell").agg(F.round(F.sum(F.col("w") * F.exp(-(dx * dx + dy * dy) / F.lit(2 * 0.13 * 0.13))), 5).alias("density"))


_DIST = g.haversine_sql("a", "b")
_IDX = "(greatest(0, least(39, 39 - floor((lat - 22.5::DOUBLE) / {h!r}::DOUBLE))) * 40 + greatest(0, least(39, floor((lon - 75.6::DOUBLE) / {w!r}::DOUBLE))))::BIGINT".format(h=(22.9 - 22.5) / 40, w=(76.0 - 75.6) / 40)
_IN = "lon >= 75.6::DOUBLE AND lon < 76.0::DOUBLE AND lat >= 22.5::DOUBLE AND lat < 22.9::DOUBLE"


def _offsets_sql(level=8, radius=400.0):
    """Offsets (dr, dc) of the bins of a disc for each whole degree of latitude."""
    step = 36 / 4**level * 111320.0
    reach = int(radius / step) + 2
    return f"""(SELECT band, dr, dc FROM range(2, 40) a(band), range({-reach}, {reach + 1}) b(dr), range({-2 * reach}, {2 * reach + 1}) c(dc)
      WHERE pow(dr * {step!r}::DOUBLE, 2) + pow(dc * {step!r}::DOUBLE * cos(radians(band)), 2) <= {radius**2!r}::DOUBLE) o"""


_CELLS = f"""(SELECT {g.code_sql('r', 'c', 6)} AS code, r AS row, c AS col, 2.5::DOUBLE + (r + 0.5::DOUBLE) * {36 / 4**6!r}::DOUBLE AS lat, 63.5::DOUBLE + (c + 0.5::DOUBLE) * {36 / 4**6!r}::DOUBLE AS lon
  FROM range({grid.count_cells(*BOX, 6)[0]}, {grid.count_cells(*BOX, 6)[1] + 1}) a(r), range({grid.count_cells(*BOX, 6)[2]}, {grid.count_cells(*BOX, 6)[3] + 1}) b(c))"""
_TAGS = "(VALUES " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(g.TAGS)) + ") t(tag, key, value)"
_RULES = "(VALUES " + ", ".join(f"('{c}', '{f}', '{k}', '{v}')" for c, f, k, v in classify.rule_rows()) + ") r(category, feature, key, value)"
_CLASSIFY = f"SELECT DISTINCT p.k, r.category, r.feature FROM {g.POI} p JOIN {_TAGS} ON p.tag = t.tag JOIN {_RULES} ON t.key = r.key AND (t.value = r.value OR r.value = '*')"
_COMPOSITE = f"""
WITH kinds AS (SELECT e.k, e.category, e.feature, p.lat, p.lon FROM ({_CLASSIFY}) e JOIN {g.POI} p ON p.k = e.k),
bins AS (SELECT {g.row_sql('lat', 8)} AS r, {g.col_sql('lon', 8)} AS c, category, feature, count(*) AS n FROM kinds GROUP BY ALL),
cells AS (SELECT code AS k, {g.row_sql('lat', 8)} AS r, {g.col_sql('lon', 8)} AS c, round_even(lat, 0) AS band FROM {_CELLS}),
counts AS (SELECT x.k, b.category, b.feature, sum(b.n)::DOUBLE AS cnt FROM cells x, {_offsets_sql(radius=1500.0)}, bins b WHERE o.band = x.band AND b.r = x.r + o.dr AND b.c = x.c + o.dc GROUP BY ALL)
{scores.composite_sql('cells', 'counts')}"""
_CATALOG = "(VALUES " + ", ".join(f"('{q}', '{s}', {w}::DOUBLE)" for q, weights in scores.CATALOG.items() for s, w in weights.items()) + ") w(query, score_id, weight)"
_LONG = "(UNPIVOT ({}) ON COLUMNS (* EXCLUDE (k)) INTO NAME score_id VALUE v)".format(_COMPOSITE)
_RANKED = f"SELECT query, k, round(sum(weight * v) / sum(abs(weight)), 6) AS score FROM {_LONG} s JOIN {_CATALOG} ON w.score_id = s.score_id GROUP BY query, k"
_NEAREST = f"SELECT a.k, b.k AS t, {_DIST} AS d FROM {g.SITE} a, {g.FACILITY} b"


def _ring_sql():
    parts = []
    for (x1, y1), (x2, y2) in zip(RING, [*RING[1:], RING[0]], strict=True):
        parts.append(f"((({y1}::DOUBLE > lat) <> ({y2}::DOUBLE > lat)) AND lon < ({x2 - x1!r}::DOUBLE) * (lat - {y1}::DOUBLE) / ({y2 - y1!r}::DOUBLE) + {x1}::DOUBLE)::INT")
    return " + ".join(parts)


_BEARING = "atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))"
_BEARING = f"(CASE WHEN degrees({_BEARING}) < 0 THEN degrees({_BEARING}) + 360 ELSE degrees({_BEARING}) END)"
_KX = "cos(radians(p.lat)) * 111320.0::DOUBLE"
_SEG = f"""(SELECT p.k, (s.lon1 - p.lon) * {_KX} AS ax, (s.lat1 - p.lat) * 111320.0::DOUBLE AS ay, (s.lon2 - p.lon) * {_KX} AS bx, (s.lat2 - p.lat) * 111320.0::DOUBLE AS by_
  FROM {g.POI} p, {g.ROAD} s WHERE abs(s.lat1 - p.lat) < 0.01 AND abs(s.lon1 - p.lon) < 0.01)"""
_MID = f"(SELECT k, (lat1 + lat2) / 2 AS lat, (lon1 + lon2) / 2 AS lon, {_BEARING} % 180 AS dir FROM {g.ROAD} WHERE class = 3)"

_ENVIRONMENT = """WITH n AS (SELECT o_custkey AS k, count(*) FILTER (o_orderkey % 7 = 0) AS worship, count(*) FILTER (o_orderkey % 7 = 1) AS river, count(*) FILTER (o_orderkey % 7 = 2) AS bridge, count(*) FILTER (o_orderkey % 7 = 3) AS industry,
        count(*) FILTER (o_orderkey % 7 = 4) AS homes, count(*) FILTER (o_orderkey % 7 = 5) AS shops, count(*) FILTER (o_orderkey % 7 = 6) AS power FROM orders GROUP BY 1),
      x AS (SELECT c_custkey AS k, c_custkey % 3 <> 0 AND c_acctbal > 0 AS counted, c_acctbal / 20 AS people, c_custkey % 5 <> 0 AS ground, c_custkey % 7 = 0 AS low, c_custkey % 23 - 9 AS rise, coalesce(worship, 0) AS worship, coalesce(river, 0) AS river, coalesce(bridge, 0) AS bridge,
        coalesce(industry, 0) AS industry, coalesce(homes, 0) AS homes, coalesce(shops, 0) AS shops, coalesce(power, 0) AS power,
        CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 4 <> 3 THEN list_filter([CASE WHEN c_custkey % 2 <> 0 THEN c_custkey % 5 ELSE 0 END, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 6 ELSE 0 END, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 8 ELSE 0 END,
          CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 10 ELSE 0 END], lambda c: c > 0) ELSE [] END AS faiths FROM customer LEFT JOIN n ON n.k = c_custkey),
      y AS (SELECT *, list_sum(faiths)::DOUBLE AS told, least(len(faiths) / 4, 1) AS rich, CASE WHEN counted THEN people ELSE homes * 5 + shops * 8 END AS crowd, CASE WHEN counted THEN 500 ELSE 200 END AS anchor FROM x),
      z AS (SELECT *, CASE WHEN len(faiths) > 1 THEN -list_sum(list_transform(faiths, lambda c: c / told * ln(c / told))) / ln(len(faiths)) END AS even FROM y)
      SELECT k, (CASE WHEN crowd > 0 THEN least(100, floor(ln(1 + crowd) / ln(1.0::DOUBLE + anchor) * 100 + 0.5)) ELSE 0 END)::INT AS population_proxy,
        (CASE WHEN len(faiths) = 0 THEN floor(least(100, floor(ln(1.0::DOUBLE + worship) / ln(21.0::DOUBLE) * 100 + 0.5)) * 0.5::DOUBLE + 0.5) WHEN len(faiths) = 1 THEN floor(100 * (0.4::DOUBLE * rich) * least(1, told / 3) + 0.5) ELSE floor(100 * (0.6::DOUBLE * even + 0.4::DOUBLE * rich) + 0.5) END)::INT AS religious_diversity,
        greatest(0, least(100, 30 + CASE WHEN ground AND low THEN 25 WHEN ground AND rise < 0 THEN 10 WHEN ground AND rise > 5 THEN -15 ELSE 0 END + 12 * river - 5 * bridge - 2 * power + 5 * industry))::INT AS flood_risk FROM z"""

QUERIES = {
    "environment_scores": (environment_scores, _ENVIRONMENT),
    "cell_encode": (cell_encode, f"SELECT k, c[1:3] || '-' || c[4:6] || '-' || c[7:10] AS code FROM (SELECT k, {g.code_sql('r', 'q', 10)} AS c FROM (SELECT k, {g.row_sql('lat', 10)} AS r, {g.col_sql('lon', 10)} AS q FROM {g.SITE}))"),
    "cell_decode": (cell_decode, f"""SELECT k, {g.code_sql('r', 'c', 8)} AS code, round(2.5 + r * w + w / 2, 6) AS lat, round(63.5 + c * w + w / 2, 6) AS lon, round(2.5 + r * w, 6) AS south,
        round(2.5 + r * w + w, 6) AS north, round(63.5 + c * w, 6) AS west, round(63.5 + c * w + w, 6) AS east FROM (SELECT k, {g.row_sql('lat', 8)} AS r, {g.col_sql('lon', 8)} AS c, {36 / 4**8!r}::DOUBLE AS w FROM {g.SITE})"""),
    "cell_enumerate": (cell_enumerate, f"SELECT code, row, col, round(lat, 6) AS lat, round(lon, 6) AS lon FROM {_CELLS}"),
    "cell_hierarchy_rollup": (cell_hierarchy_rollup, f"SELECT level::INT AS level, left(code, level::BIGINT) AS ancestor, count(*) AS n FROM (SELECT {g.code_sql(g.row_sql('lat', 8), g.col_sql('lon', 8), 8)} AS code FROM {g.SITE}), range(4, 9) l(level) GROUP BY ALL"),
    "tag_classify": (tag_classify, _CLASSIFY),
    "feature_counts": (feature_counts, f"SELECT category, feature, count(*) AS n FROM ({_CLASSIFY}) GROUP BY ALL"),
    "disc_kernel_counts": (disc_kernel_counts, f"""WITH moved(by_) AS (VALUES {", ".join(f"({x})" for x in SHIFTS)}),
        bins AS (SELECT {g.row_sql('(lat + by_)', 8)} AS r, {g.col_sql('lon', 8)} AS c, tag, count(*) AS n FROM {g.POI}, moved GROUP BY ALL),
        cells AS (SELECT by_ || ':' || k AS k, {g.row_sql('(lat + by_)', 8)} AS r, {g.col_sql('lon', 8)} AS c, round_even(lat + by_, 0) AS band FROM {g.SITE}, moved)
        SELECT x.k, b.tag, sum(b.n)::BIGINT AS cnt FROM cells x, {_offsets_sql()}, bins b WHERE o.band = x.band AND b.r = x.r + o.dr AND b.c = x.c + o.dc GROUP BY ALL"""),
    "composite_scores": (composite_scores, _COMPOSITE),
    "rank_query_topk": (rank_query_topk, f"SELECT k, score FROM ({_RANKED}) WHERE query = 'family' ORDER BY score DESC, k LIMIT 10"),
    "rank_catalog": (rank_catalog, f"SELECT query, k, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, k) AS rank FROM ({_RANKED})) WHERE rank <= 3"),
    "grid_footprint": (grid_footprint, f"SELECT {_IDX} AS idx, count(*) AS n, round(sum(k % 50 * 10.0::DOUBLE), 3) AS area, round(avg(k % 50 * 10.0::DOUBLE), 6) AS mean_area FROM {g.POI} WHERE {_IN} GROUP BY 1"),
    "neighbourhood_sum": (neighbourhood_sum, f"""WITH c AS (SELECT {_IDX} AS idx, count(*) AS n FROM {g.POI} WHERE {_IN} GROUP BY 1)
        SELECT a.idx, sum(b.n)::BIGINT AS total FROM c a JOIN c b ON abs(a.idx // 40 - b.idx // 40) <= 1 AND abs(a.idx % 40 - b.idx % 40) <= 1 GROUP BY a.idx"""),
    "lookup_sample": (lookup_sample, f"""WITH c AS (SELECT {_IDX} AS idx, count(*) AS n FROM {g.POI} WHERE {_IN} GROUP BY 1)
        SELECT s.k, s.idx, c.n FROM (SELECT k, CASE WHEN {_IN} THEN {_IDX} END AS idx FROM {g.SITE}) s LEFT JOIN c ON c.idx = s.idx"""),
    "grid_segments": (grid_segments, f"""SELECT {_IDX} AS idx, count(*) AS n, round(sum(m), 2) AS metres, max(class) AS top_class FROM (SELECT class, (lat1 + lat2) / 2 AS lat, (lon1 + lon2) / 2 AS lon,
        12742000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, sin(radians(lat2 - lat1) / 2)*sin(radians(lat2 - lat1) / 2) + cos(radians(lat1))*cos(radians(lat2))*sin(radians(lon2 - lon1) / 2)*sin(radians(lon2 - lon1) / 2)))) AS m FROM {g.ROAD}) WHERE {_IN} GROUP BY 1"""),
    "slippy_tiles": (slippy_tiles, "SELECT k, x, y, " + " || ".join(f"(((x >> {s}) & 1) + 2 * ((y >> {s}) & 1))::VARCHAR" for s in range(13, -1, -1)) + f""" AS quadkey FROM
        (SELECT k, floor((lon + 180.0) / 360.0 * 16384)::BIGINT AS x, floor((1.0::DOUBLE - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2 * 16384)::BIGINT AS y FROM {g.SITE})"""),
    "nearest_facility": (nearest_facility, f"SELECT k, t AS facility, round(d, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, t) AS n FROM ({_NEAREST})) WHERE n = 1"),
    "nearest_k": (nearest_k, f"SELECT k, n::INT AS rank, round(d, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, t) AS n FROM ({_NEAREST})) WHERE n <= 4"),
    "radius_join": (radius_join, f"SELECT k, t AS facility, round(d, 6) AS km FROM ({_NEAREST}) WHERE d <= 3.0"),
    "radius_counts": (radius_counts, f"""SELECT s.k, coalesce(n1000, 0)::BIGINT AS n1000, coalesce(n2000, 0)::BIGINT AS n2000, coalesce(n3000, 0)::BIGINT AS n3000 FROM {g.SITE} s LEFT JOIN
        (SELECT a.k, count(*) FILTER ({_DIST} <= 1.0) AS n1000, count(*) FILTER ({_DIST} <= 2.0) AS n2000, count(*) FILTER ({_DIST} <= 3.0) AS n3000 FROM {g.SITE} a, {g.POI} b GROUP BY a.k) n ON n.k = s.k"""),
    "bucket_segment_semi": (bucket_segment_semi, f"""SELECT DISTINCT k FROM (SELECT k, ax, ay, bx - ax AS dx, by_ - ay AS dy FROM {_SEG}) WHERE
        sqrt(pow(ax + greatest(0.0, least(1.0, -(ax*dx + ay*dy) / (dx*dx + dy*dy))) * dx, 2) + pow(ay + greatest(0.0, least(1.0, -(ax*dx + ay*dy) / (dx*dx + dy*dy))) * dy, 2)) <= 60.0"""),
    "theta_pairs": (theta_pairs, f"""SELECT a, b, round(angle, 4) AS angle, round(metres, 3) AS metres FROM (SELECT a.k AS a, b.k AS b, least(abs(a.dir - b.dir), 180.0 - abs(a.dir - b.dir)) AS angle, {g.haversine_sql('a', 'b', 6371000.0)} AS metres
        FROM {_MID} a JOIN {_MID} b ON a.k < b.k AND abs(a.lat - b.lat) < 0.04 AND abs(a.lon - b.lon) < 0.04) WHERE angle <= 30 AND metres BETWEEN 50 AND 2500"""),
    "point_in_polygon": (point_in_polygon, f"SELECT k FROM {g.SITE} WHERE ({_ring_sql()}) % 2 = 1"),
    "bearing_compass": (bearing_compass, f"SELECT k, round(b, 6) AS bearing, string_split('N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW', ' ')[(floor((b + 11.25) / 22.5) % 16 + 1)::BIGINT] AS compass FROM (SELECT k, {_BEARING} AS b FROM {g.ROAD})"),
    "kde_surface": (kde_surface, f"""SELECT cell::INT AS cell, round(sum(w * exp(-(pow(x - (cell % 16 + 0.5) / 16, 2) + pow(y - (cell // 16 + 0.5) / 16, 2)) / {2 * 0.13 * 0.13!r}::DOUBLE)), 5) AS density FROM
        (SELECT (75.6::DOUBLE + ((s_suppkey*6007)%4000)/10000.0::DOUBLE - 75.6) / 0.4::DOUBLE AS x, (22.5::DOUBLE + ((s_suppkey*7919)%4000)/10000.0::DOUBLE - 22.5) / 0.4::DOUBLE AS y, s_acctbal / 10000.0 AS w FROM supplier), range(256) l(cell) GROUP BY cell"""),
}
