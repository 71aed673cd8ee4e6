"""Composite flood zones from evidence near each zone's centre."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import band_desc
from . import spatial_joins

# Kilometres within which a kind of evidence counts, and its points.
NEAR = {"depression": (0.5, 20), "low": (0.5, 15), "channel": (0.5, 15)}
WATER_KM = ((0.5, 25), (1.5, 15), (3.0, 5))
HISTORY_KM = 0.8
LEVELS = [(50, "critical"), (35, "high"), (20, "moderate")]


def zones(cells: DataFrame, evidence: DataFrame, urban_pct: float) -> DataFrame:
    """``k, score, level`` of every cell (k, lat, lon).

    ``evidence(t, kind, lat, lon)`` has the kinds water, depression, low, channel, seasonal and permanent.
    Nearness to water counts in bands, the others once; of the past's two kinds the one with the smallest t
    counts. Each kind is one bucket join of places at its own radius; their hits meet in one aggregation by place.
    """
    # One row for each place and kind of evidence, and one for each place of cells.
    first = evidence.groupBy("kind", F.col("lat").alias("tlat"), F.col("lon").alias("tlon")).agg(F.min("t").alias("t"))

    def near(kind: str, km: float) -> DataFrame:
        own = first.filter(F.col("kind") == kind)
        return spatial_joins.place_pairs(cells, own.select(F.col("tlat").alias("lat"), F.col("tlon").alias("lon")), km).join(own.hint("merge"), ["tlat", "tlon"]).select("lat", "lon", "t", "d", "kind")

    hits = near("water", WATER_KM[-1][0])
    for kind, km in [(k, v[0]) for k, v in NEAR.items()] + [("seasonal", HISTORY_KM), ("permanent", HISTORY_KM)]:
        hits = hits.unionByName(near(kind, km))
    is_kind = lambda k: F.col("kind") == k
    strict = lambda kind: F.when(is_kind(kind), F.col("d") < (NEAR[kind][0] if kind in NEAR else HISTORY_KM))
    past = F.min_by(F.col("kind"), F.when(F.col("kind").isin("seasonal", "permanent") & (F.col("d") < HISTORY_KM), F.col("t")))
    g = hits.groupBy("lat", "lon").agg(
        F.min(F.when(is_kind("water"), F.col("d"))).alias("water"), past.alias("past"), *[F.bool_or(strict(kind)).alias(kind) for kind in NEAR],
    )
    w = F.col("water")
    water = F.when(w < WATER_KM[0][0], WATER_KM[0][1]).when(w < WATER_KM[1][0], WATER_KM[1][1]).when(w < WATER_KM[2][0], WATER_KM[2][1]).otherwise(0)
    score = water + F.when(F.col("past") == "seasonal", 20).when(F.col("past") == "permanent", 10).otherwise(0) + (10 if urban_pct > 30 else 0)
    for kind, (_, points) in NEAR.items():
        score = score + F.when(F.col(kind), points).otherwise(0)
    return cells.select("k", "lat", "lon").join(g.hint("merge"), ["lat", "lon"], "left").select("k", score.alias("score")).withColumn("level", band_desc(F.col("score"), LEVELS, "low"))


# Points by kilometres to the nearest drain, for a depression within half a kilometre, and the levels.
DRAIN_KM = ((0.1, 40), (0.3, 20), (0.5, 10))
DEPRESSION_KM, DEPRESSION_POINTS = 0.5, 30
EXPOSED = [(40, "high"), (20, "medium")]


def building_exposure(buildings: DataFrame, drains: DataFrame, depressions: DataFrame) -> DataFrame:
    """``k, drain_km, score, level`` of every building (k, lat, lon), none left out; drain_km is null beyond half a kilometre.

    Drains are points along watercourses. Both kinds of evidence are bucket joins of places at half a kilometre, and
    meet the buildings by place in one aggregation.
    """
    reach = DRAIN_KM[-1][0]
    hits = spatial_joins.place_pairs(buildings, drains, reach).select("lat", "lon", F.col("d").alias("drain"), F.lit(None).cast("double").alias("low"))
    hits = hits.unionByName(spatial_joins.place_pairs(buildings, depressions, DEPRESSION_KM).select("lat", "lon", F.lit(None).cast("double").alias("drain"), F.col("d").alias("low")))
    g = hits.groupBy("lat", "lon").agg(F.min("drain").alias("drain_km"), F.min("low").alias("low"))
    d = F.col("drain_km")
    near = F.when(d < DRAIN_KM[0][0], DRAIN_KM[0][1]).when(d < DRAIN_KM[1][0], DRAIN_KM[1][1]).when(d < DRAIN_KM[2][0], DRAIN_KM[2][1]).otherwise(0)
    score = near + F.when(F.col("low") < DEPRESSION_KM, DEPRESSION_POINTS).otherwise(0)
    return buildings.select("k", "lat", "lon").join(g.hint("merge"), ["lat", "lon"], "left").select("k", "drain_km", score.alias("score")).withColumn("level", band_desc(F.col("score"), EXPOSED, "low"))
