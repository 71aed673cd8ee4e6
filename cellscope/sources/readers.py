"""Readers with explicit schemas: map elements, GeoJSON, footprints, timetables, feeds, alerts, rasters, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENT = "type string, id long, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>, geometry array<struct<lat:double,lon:double>>"
FEATURE = "type string, geometry struct<type:string,coordinates:string>, properties map<string,string>"


def map_elements(spark: SparkSession, path: str) -> DataFrame:
    """``k, type, lat, lon, tags, geometry`` from JSON files with an ``elements`` list; areas count at their centre."""
    raw = spark.read.schema(f"elements array<struct<{_fields(ELEMENT)}>>").option("multiLine", True).json(path)
    e = raw.select(F.explode("elements").alias("e"))
    return e.select(F.col("e.id").alias("k"), "e.type", F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"), "e.tags", "e.geometry").filter("lat is not null and lon is not null")


def _fields(schema: str) -> str:
    out, depth = [], 0
    for part in schema.split(", "):
        name, kind = part.split(" ", 1)
        out.append(f"{name}:{kind}")
        depth += 1
    return ",".join(out)


def geometry_kind(points: str = "geometry"):
    """Polygon for a closed ring of at least four points, else LineString."""
    p = F.col(points)
    return F.when((F.size(p) >= 4) & (F.get(p, F.lit(0)) == F.get(p, F.size(p) - 1)), "Polygon").otherwise("LineString")


def geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """``lat, lon, properties`` of a FeatureCollection's points; features without two finite coordinates are dropped."""
    raw = spark.read.schema(f"features array<struct<{_fields(FEATURE)}>>").option("multiLine", True).json(path)
    f = raw.select(F.explode("features").alias("f")).filter("f.geometry.type = 'Point'")
    xy = F.from_json("f.geometry.coordinates", "array<double>")
    return f.select(F.get(xy, F.lit(1)).alias("lat"), F.get(xy, F.lit(0)).alias("lon"), "f.properties").filter("lat is not null and lon is not null")


def footprints_csv(spark: SparkSession, path: str, south: float, west: float, north: float, east: float, confidence: float = 0.65) -> DataFrame:
    """Building footprints from (gzipped) CSV with quoted WKT: numbers are filtered first, WKT parsed for what is left."""
    schema = "latitude double, longitude double, area_in_meters double, confidence double, geometry string, full_plus_code string"
    raw = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"')
    inside = raw.filter(F.col("latitude").between(south, north) & F.col("longitude").between(west, east) & (F.col("confidence") >= confidence))
    return inside.withColumn("ring", wkt_ring(F.col("geometry"))).drop("geometry")


def wkt_ring(wkt):
    """Outer ring of a WKT polygon as ``array<struct<x,y>>``; null for anything else or fewer than four points."""
    text = F.regexp_extract(wkt, r"^\s*POLYGON\s*\(\(([^)]*)\)", 1)
    ring = F.transform(F.split(text, r"\s*,\s*"), lambda p: F.struct(F.get(F.split(F.trim(p), " +"), F.lit(0)).try_cast("double").alias("x"), F.get(F.split(F.trim(p), " +"), F.lit(1)).try_cast("double").alias("y")))
    return F.when((text != "") & (F.size(ring) >= 4), ring)


def timetable(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    """A timetable's text table; a missing file is an empty table, a byte order mark is dropped."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}.txt")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    names = [p.split()[0] for p in schema.split(",")]
    raw = spark.read.option("header", True).csv(str(where))
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    return raw.select(*[F.col(n).try_cast(p.split()[1]).alias(n) if n in raw.columns else F.lit(None).cast(p.split()[1]).alias(n) for n, p in zip(names, schema.split(","), strict=True)])


def map_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Nodes or ways of a map extract in XML, tags as a map."""
    tag = "array<struct<_k:string,_v:string>>"
    schema = f"_id long, _lat double, _lon double, tag {tag}" if row_tag == "node" else f"_id long, nd array<struct<_ref:long>>, tag {tag}"
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    tags = F.map_from_entries(F.coalesce(F.col("tag"), F.array().cast(tag)))
    return raw.select(F.col("_id").alias("k"), *([F.col("_lat").alias("lat"), F.col("_lon").alias("lon")] if row_tag == "node" else [F.transform("nd", lambda n: n["_ref"]).alias("refs")]), tags.alias("tags"))


def way_centres(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """``k, lat, lon, tags``: the middle of the box of a way's nodes, by a join on node ids."""
    refs = ways.select("k", F.explode("refs").alias("node")).join(nodes.select(F.col("k").alias("node"), "lat", "lon"), "node")
    box = refs.groupBy("k").agg(((F.min("lat") + F.max("lat")) / 2).alias("lat"), ((F.min("lon") + F.max("lon")) / 2).alias("lon"))
    return box.join(ways.select("k", "tags"), "k")


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS alert files."""
    schema = "title string, description string, link string, pubDate string, guid string"
    return spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)


def envelope(spark: SparkSession, path: str, names: tuple[str, ...] = ("data", "warnings", "forecast", "results")) -> DataFrame:
    """Records of JSON files that hold a list, or an object with the list under one of several names, as variants."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    found = F.coalesce(*[F.try_variant_get("v", f"$.{n}", "array<variant>") for n in names], F.col("v").try_cast("array<variant>"))
    return raw.select(F.explode(found).alias("record"))


def raster_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Raster cells as a table: ``raster, band, row, col, value``."""
    return spark.read.schema("raster string, band int, row int, col int, value double").parquet(path)


def score_shards(spark: SparkSession, path: str, region: str, prefixes: list[str]) -> DataFrame:
    """Only the shards of a region that a viewport needs: both filters prune partitions."""
    return spark.read.parquet(path).filter((F.col("region") == region) & F.col("prefix").isin(prefixes))


def html_table(spark: SparkSession, path: str, table_id: str, least_cells: int = 9) -> DataFrame:
    """``cells array<string>``: the rows of one table of each page, tags gone, white space single; short rows are dropped."""
    page = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", rf"(?is)<table[^>]*\bid\s*=\s*[\"']?{table_id}\b[^>]*>(.*?)</table>", 1)
    rows = F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)
    clean = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, "(?s)<[^>]*>", " "), r"\s+", " "))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), 1), clean)
    return page.select(F.explode(rows).alias("row")).select(cells.alias("cells")).filter(F.size("cells") >= least_cells)


def quake_table(spark: SparkSession, path: str, table_id: str) -> DataFrame:
    """Quakes of a bulletin page; rows without magnitude or place are dropped, an unknown depth is 0."""
    at = lambda i: F.col("cells")[i]
    number = lambda i: at(i).try_cast("double")
    rows = html_table(spark, path, table_id).select(
        number(0).alias("magnitude"), at(1).alias("origin_time"), number(2).alias("lat"), number(3).alias("lon"), F.coalesce(number(4), F.lit(0.0)).alias("depth_km"),
        at(5).alias("region"), at(6).alias("location"), at(7).alias("review"),
    )
    key = F.format_string("%s|%.3f,%.3f", "origin_time", "lat", "lon")
    return rows.filter("magnitude is not null and lat is not null and lon is not null").withColumn("id", key)


def quake_feed(spark: SparkSession, path: str) -> DataFrame:
    """``id, magnitude, time_ms, place, lat, lon, depth_km`` of GeoJSON quake feeds."""
    raw = spark.read.schema("features array<struct<id:string,geometry:struct<coordinates:array<double>>,properties:struct<mag:double,time:long,place:string>>>").option("multiLine", True).json(path)
    xyz = lambda i: F.get("f.geometry.coordinates", F.lit(i))
    f = raw.select(F.explode("features").alias("f"))
    return f.select("f.id", F.col("f.properties.mag").alias("magnitude"), F.col("f.properties.time").alias("time_ms"), "f.properties.place", xyz(1).alias("lat"), xyz(0).alias("lon"), F.coalesce(xyz(2), F.lit(0.0)).alias("depth_km")).filter("magnitude is not null and lat is not null and lon is not null")


def paged(spark: SparkSession, path: str, most_pages: int = 3) -> DataFrame:
    """Records, as JSON text, of a paged service's answers kept as files: pages after the last record or the limit are not read on."""
    raw = spark.read.schema("meta struct<page:int,limit:int,found:long>, results array<variant>").option("multiLine", True).json(path)
    wanted = raw.filter((F.col("meta.page") <= most_pages) & ((F.col("meta.page") - 1) * F.col("meta.limit") < F.col("meta.found")))
    return wanted.select(F.col("meta.page").alias("page"), F.explode("results").alias("r")).select("page", F.to_json("r").alias("record"))


def sensor_readings(spark: SparkSession, path: str) -> DataFrame:
    """Readings of any source: place, time and a map of metrics; readings without a place or metric are dropped."""
    raw = spark.read.schema("source string, type string, ts timestamp, lat double, lon double, metrics map<string,double>").json(path)
    held = F.map_filter("metrics", lambda _, v: v.isNotNull())
    return raw.filter("lat is not null and lon is not null").withColumn("metrics", held).filter(F.size("metrics") > 0)


def simulated_trips(spark: SparkSession, path: str) -> DataFrame:
    """Trips of a traffic simulation's XML report."""
    raw = spark.read.format("xml").option("rowTag", "tripinfo").schema("_id string, _depart double, _duration double, _waitingTime double, _timeLoss double, _routeLength double").load(path)
    return raw.toDF("id", "depart", "duration", "waiting", "time_loss", "length")


def simulated_edges(spark: SparkSession, path: str) -> DataFrame:
    """``start, stop, edge, speed, density, entered`` per interval; inner edges (":") are left out, a missing speed is null."""
    raw = spark.read.format("xml").option("rowTag", "interval").schema("_begin double, _end double, edge array<struct<_id:string,_speed:double,_density:double,_entered:double>>").load(path)
    e = raw.select(F.col("_begin").alias("start"), F.col("_end").alias("stop"), F.explode("edge").alias("e")).filter("not startswith(e._id, ':')")
    return e.select("start", "stop", F.col("e._id").alias("edge"), F.when(F.col("e._speed") >= 0, F.col("e._speed")).alias("speed"), F.coalesce("e._density", F.lit(0.0)).alias("density"), F.coalesce("e._entered", F.lit(0.0)).cast("long").alias("entered"))
