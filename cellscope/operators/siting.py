"""Sites for flood works: candidates in order, with what lies within reach of a chosen one folded into it or left out."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import models
from . import graph, spatial_joins, tables

# Metres of reach, least accumulation and number of ponds; metres of reach, least depth and number of pumping stations.
POND_REACH, POND_ACCUM, PONDS = 500.0, 30, 15
PUMP_REACH, PUMP_DEPTH, PUMPS = 300.0, 0.5, 8


def _folded(ordered: DataFrame, metres: float) -> DataFrame:
    """``ordered(seq, lat, lon, ...)`` with ``cluster``: the first earlier choice nearer than ``metres``, or its own. Those of one place share it."""
    under = math.nextafter(metres, 0.0)
    placed = graph.cluster_places(ordered.withColumn("__all", F.lit(0)), under, "__all").select("lat", "lon", "cluster")
    return ordered.join(placed.hint("merge"), ["lat", "lon"])


def retention_ponds(depressions: DataFrame, cell_m: float, reach: float = POND_REACH, least: int = POND_ACCUM, top: int = PONDS) -> DataFrame:
    """``k, lat, lon, catchment_km2, volume_m3, cells, priority``: the ``top`` ponds with the largest catchments.

    Depressions ``k, lat, lon, accum, depth`` that drain more than ``least`` cells are taken in the order of k: one near an earlier choice is
    part of it. A pond stands where most cells drain to, ties to the smaller k; its volume is its own depth over the cells of all.
    """
    area = cell_m * cell_m
    own = depressions.filter(F.col("accum") > least).withColumn("seq", F.col("k"))
    best = F.max_by(F.struct("k", "lat", "lon", "accum", "depth"), F.struct("accum", -F.col("k")))
    ponds = _folded(own, reach).groupBy("cluster").agg(best.alias("b"), F.count("*").alias("cells"))
    catchment = F.col("b.accum") * (area / 1e6)
    out = ponds.select("b.k", "b.lat", "b.lon", catchment.alias("catchment_km2"), (F.col("b.depth") * area * F.col("cells")).alias("volume_m3"), "cells", F.when(catchment > 1, "HIGH").otherwise("MEDIUM").alias("priority"))
    return out.orderBy(F.desc("catchment_km2"), "k").limit(top)


def pumping_stations(flooded: DataFrame, reach: float = PUMP_REACH, least: float = PUMP_DEPTH, top: int = PUMPS) -> DataFrame:
    """``k, lat, lon, depth, priority``: of places ``k, lat, lon, depth`` flooded deeper than ``least``, the ``top`` deepest that aren't near a deeper one chosen.

    Equal depths go by k. A place near one that was itself left out can still be chosen.
    """
    own = flooded.filter(F.col("depth") > least).withColumn("__d", -F.col("depth"))
    ordered = tables.sequential_ids(own.select("k", "lat", "lon", "depth", "__d"), ["__d", "k"], "seq").drop("__d")
    first = _folded(ordered, reach).groupBy("cluster").agg(F.min_by(F.struct("k", "lat", "lon", "depth"), "seq").alias("p"), F.min("seq").alias("seq"))
    return first.orderBy("seq").limit(top).select("p.*", F.when(F.col("p.depth") > 1, "CRITICAL").otherwise("HIGH").alias("priority"))


# Metres within which demand, supply and stops count for a road, and the weight of its class.
PARKING_REACH = {"demand": 200.0, "supply": 300.0, "stops": 100.0}
PARKING_WEIGHT = {"primary": 1.5, "secondary": 1.2, "tertiary": 1.0}


def parking_zones(roads: DataFrame, demand: DataFrame, supply: DataFrame, stops: DataFrame) -> DataFrame:
    """``name, category, demand, supply, stops, segments, pressure``: parking pressure of each named road.

    ``roads(name, k, lat, lon, category)`` are segments; places ``k, lat, lon`` count by their distance from a road's first segment (the least k), each kind
    within its own reach. A class without a weight has 1; pressure is 0 at least, rounded to one digit.
    """
    first = roads.groupBy("name").agg(F.min_by(F.struct("k", "lat", "lon", "category"), "k").alias("s"), F.count("*").alias("segments"))
    own = first.select("name", "segments", "s.k", "s.lat", "s.lon", "s.category")
    for kind, places in (("demand", demand), ("supply", supply), ("stops", stops)):
        near = spatial_joins.within(own, places, PARKING_REACH[kind] / 1000).filter(F.col("d") < PARKING_REACH[kind] / 1000)
        own = own.join(near.groupBy("k").agg(F.count("*").alias(kind)), "k", "left").withColumn(kind, F.coalesce(kind, F.lit(0)))
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for e in PARKING_WEIGHT.items() for x in e]), F.col("category")), F.lit(1.0))
    return own.select("name", "category", "demand", "supply", "stops", "segments", F.round(models.parking_pressure(F.col("demand"), F.col("supply"), F.col("stops"), weight), 1).alias("pressure"))
