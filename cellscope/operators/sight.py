"""Lines of sight on a raster, crowds along streets and water near buildings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import streets
from . import spatial_joins


def viewshed(r: DataFrame, observers: DataFrame, radius: int = 120, eye_m: float = 1.7, cell_m: float = 9.0) -> DataFrame:
    """``k, row, col``: cells of ``r(row, col, v)`` that each observer (k, row, col) sees, its own included.

    A target is seen if its slope from the eye is at least that of every step on the ray before it. Rays
    are rows: each step meets its height in an equi-join and the steepest is one aggregation, so work is
    spread over targets, and an observer costs about radius cubed rows whatever the raster's size.
    Observers outside the raster see nothing; steps on missing cells hide nothing.
    """
    span = F.sequence(F.lit(-radius), F.lit(radius))
    eye = observers.join(r, ["row", "col"]).select("k", F.col("row").alias("oy"), F.col("col").alias("ox"), (F.col("v") + eye_m).alias("eye"))
    box = eye.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span)).filter(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx") <= radius * radius)
    target = box.select("*", (F.col("oy") + F.col("dy")).alias("row"), (F.col("ox") + F.col("dx")).alias("col")).join(r, ["row", "col"])
    far = F.sqrt((F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).cast("double"))
    own = (F.col("dy") == 0) & (F.col("dx") == 0)
    slope = F.when(~own, (F.col("v") - F.col("eye")) / (F.col("far") * cell_m))
    target = target.withColumn("far", far).withColumn("slope", slope).withColumn("steps", F.ceil("far")).drop("v")
    walk = target.filter("steps > 1").withColumn("s", F.explode(F.sequence(F.lit(1).cast("long"), F.col("steps") - 1))).withColumn("f", F.col("s") / F.col("steps"))
    at = lambda o, d: F.floor(F.col(o) + F.col(d) * F.col("f") + 0.5).alias("sy" if o == "oy" else "sx")
    heights = r.select(F.col("row").alias("sy"), F.col("col").alias("sx"), F.col("v").alias("h"))
    met = walk.select("k", "row", "col", "eye", "far", "f", at("oy", "dy"), at("ox", "dx")).join(heights, ["sy", "sx"])
    steepest = met.groupBy("k", "row", "col").agg(F.max((F.col("h") - F.col("eye")) / (F.col("far") * F.col("f") * cell_m)).alias("most"))
    seen = target.join(steepest, ["k", "row", "col"], "left").filter(F.col("slope").isNull() | F.col("most").isNull() | (F.col("slope") >= F.col("most") - 1e-6))
    return seen.select("k", "row", "col")


def crowd_spread(events: DataFrame, segments: DataFrame) -> DataFrame:
    """``k, segments, placed``: people of each event (k, lat, lon, people) placed on segments (t, lat, lon, area) nearby.

    Segments are filled by distance: a share of the people left that falls with distance, at most six per
    square metre. What one takes depends on those before, so an event's segments are folded in order; they
    are those of one disc of at most 1.8 km. Discs are put together once for a place, however many events are there, and a fold
    ends with the distance at which too few people are left to change the result.
    """
    most_km = 1.8
    at = ["lat", "lon"]
    own = events.select("k", *at, F.col("people").cast("double").alias("people"), streets.crowd_radius(F.col("people")).alias("r"))
    held = segments.filter("lat is not null and lon is not null").groupBy(F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))
    held = held.agg(F.collect_list(F.struct("t", (F.col("area") * 6.0).alias("cap"))).alias("own"))
    near = spatial_joins.place_pairs(events, segments, most_km, 6371.0).join(held.hint("merge"), ["tlat", "tlon"])
    rings = near.groupBy(*at, (F.col("d") * 1000).alias("d")).agg(F.transform(F.array_sort(F.flatten(F.collect_list("own"))), lambda x: x["cap"]).alias("caps"))
    discs = rings.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("d", "caps"))).alias("rings"))
    met = own.join(discs.hint("merge"), at).withColumn("rings", F.filter("rings", lambda g: g["d"] <= F.col("r"))).filter(F.size("rings") > 0)
    met = met.repartition("k")  # folds are long and places few

    def fill(a: Column, g: Column) -> Column:
        share = F.lit(1.0) - g["d"] / F.col("r")
        return F.aggregate(g["caps"], a, lambda a, cap: F.when(a > 0, a - F.least(a * share * 0.3, cap)).otherwise(a))

    left = F.aggregate("rings", F.col("people"), lambda a, g: F.when(a > F.col("people") * 2.0**-60, fill(a, g)).otherwise(a))
    segments_met = F.aggregate("rings", F.lit(0), lambda n, g: n + F.size(g["caps"]))
    return met.select("k", segments_met.alias("segments"), (F.col("people") - left).alias("placed"))


def encroachment(distance_m: Column, depth_m: Column, buffers: tuple[float, float, float] = (30.0, 60.0, 100.0)) -> Column:
    """``struct(risk, action)`` of a building by its distance to water, else by depth; null without a risk."""
    a, b, c = buffers
    rule = lambda risk, action: F.struct(F.lit(risk).alias("risk"), F.lit(action).alias("action"))
    return (
        F.when(distance_m <= a, rule("critical", "REMOVE/RELOCATE")).when(distance_m <= b, rule("high", "FLOOD-PROOF"))
        .when(distance_m <= c, rule("moderate", "MONITOR")).when(depth_m > 0.5, rule("flood_zone", "FLOOD-PROOF"))
    )


def nearest_within(points: DataFrame, targets: DataFrame, km: float) -> DataFrame:
    """``k, t, d``: the nearest target within ``km``, ties to the smaller id; points without one are absent. Points and targets that share a place count once."""
    first = targets.groupBy(F.col("lat").alias("tlat"), F.col("lon").alias("tlon")).agg(F.min("k").alias("t"))
    near = spatial_joins.place_pairs(points, targets, km).join(first.hint("merge"), ["tlat", "tlon"]).groupBy("lat", "lon").agg(F.min(F.struct("d", "t")).alias("n"))
    return points.select("k", "lat", "lon").join(near.hint("merge"), ["lat", "lon"]).select("k", "n.t", "n.d")
