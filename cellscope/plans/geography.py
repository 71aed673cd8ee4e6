"""A deterministic geography over the star-schema tables: coordinates from integer keys.

Each view is defined twice, as a DataFrame and as SQL for the oracle, with the same integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# One tag pair for each of the twenty element kinds.
TAGS = (
    ("amenity", "restaurant"), ("amenity", "cafe"), ("shop", "supermarket"), ("amenity", "hospital"), ("amenity", "school"),
    ("highway", "bus_stop"), ("leisure", "park"), ("amenity", "police"), ("office", "company"), ("building", "house"),
    ("shop", "mall"), ("tourism", "hotel"), ("natural", "water"), ("waterway", "river"), ("highway", "residential"),
    ("highway", "footway"), ("amenity", "place_of_worship"), ("landuse", "industrial"), ("man_made", "tower"), ("amenity", "bar"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(key: Column, lat_step: int, lon_step: int) -> tuple[Column, Column]:
    place = lambda step, base: F.lit(base) + (key * step) % 4000 / F.lit(10000.0)
    return place(lat_step, 22.5).alias("lat"), place(lon_step, 75.6).alias("lon")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows shared out over all tasks: before costly work by row, as a small file of many rows is read in one task.

    The number of tasks is named, or adaptive execution would join them again by their few bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("k"), *at(k, 7919, 6007))


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("k"), *at(k, 5003, 3001), (k % 20).alias("tag"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with string tags, as a map source gives them; worship places carry one of four religions."""
    keys, values = F.array(*[F.lit(k) for k, _ in TAGS]), F.array(*[F.lit(v) for _, v in TAGS])
    pick = (F.col("tag") + 1).cast("int")
    religion = F.when(F.col("tag") == 16, F.element_at(F.array(*map(F.lit, ("hindu", "muslim", "christian", "jain"))), (F.col("k") % 4 + 1).cast("int")))
    tags = F.map_from_arrays(F.array(F.element_at(keys, pick), F.lit("religion")), F.array(F.element_at(values, pick), F.coalesce(religion, F.lit(""))))
    return pois(spark, sf_dir).select("k", "lat", "lon", "tag", tags.alias("tags"))


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pois(spark, sf_dir).filter("tag = 3").select("k", "lat", "lon")


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-point lines from orders, with a class from 0 to 7."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    lat, lon = at(c, 7919, 6007)
    own = table(spark, sf_dir, "orders").select(o.alias("k"), lat.alias("lat1"), lon.alias("lon1"), (o % 17).alias("m"), (o % 8).alias("class"))
    return own.select("k", "class", "lat1", "lon1", (F.col("lat1") + (F.col("m") + 1) / F.lit(20000.0)).alias("lat2"), (F.col("lon1") + (17 - F.col("m")) / F.lit(20000.0)).alias("lon2"))


SITE = "(SELECT c_custkey k, 22.5::DOUBLE + ((c_custkey*7919)%4000)/10000.0::DOUBLE lat, 75.6::DOUBLE + ((c_custkey*6007)%4000)/10000.0::DOUBLE lon FROM customer)"
POI = "(SELECT p_partkey k, 22.5::DOUBLE + ((p_partkey*5003)%4000)/10000.0::DOUBLE lat, 75.6::DOUBLE + ((p_partkey*3001)%4000)/10000.0::DOUBLE lon, p_partkey%20 tag FROM part)"
FACILITY = f"(SELECT k, lat, lon FROM {POI} WHERE tag = 3)"
ROAD = (
    "(SELECT k, class, lat1, lon1, lat1 + (m + 1)/20000.0::DOUBLE lat2, lon1 + (17 - m)/20000.0::DOUBLE lon2 FROM (SELECT o_orderkey k, o_orderkey%8 class, o_orderkey%17 m,"
    " 22.5::DOUBLE + ((o_custkey*7919)%4000)/10000.0::DOUBLE lat1, 75.6::DOUBLE + ((o_custkey*6007)%4000)/10000.0::DOUBLE lon1 FROM orders))"
)


def code_sql(row: str, col: str, level: int) -> str:
    return " || ".join(f"substr('FC98J327K456LMPT', (4*(3-(({row} >> {s}) & 3)) + (({col} >> {s}) & 3) + 1)::BIGINT, 1)" for s in range(2 * (level - 1), -1, -2))


def row_sql(lat: str, level: int) -> str:
    return f"least(floor(({lat} - 2.5::DOUBLE) / {36.0 / 4**level!r}::DOUBLE), {4**level - 1})::BIGINT"


def col_sql(lon: str, level: int) -> str:
    return f"least(floor(({lon} - 63.5::DOUBLE) / {36.0 / 4**level!r}::DOUBLE), {4**level - 1})::BIGINT"


def haversine_sql(a: str, b: str, radius: float = 6371.0) -> str:
    p, q = f"radians({b}.lat - {a}.lat) / 2", f"radians({b}.lon - {a}.lon) / 2"
    h = f"sin({p})*sin({p}) + cos(radians({a}.lat))*cos(radians({b}.lat))*sin({q})*sin({q})"
    return f"{2 * radius!r}::DOUBLE * asin(sqrt(least(1.0::DOUBLE, {h})))"
