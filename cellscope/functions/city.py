"""Smaller city models as column expressions: heights, inundation, terrain, junctions, classes, demography."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import band, clamp

FNV_START, FNV_PRIME = 2166136261, 16777619
# Base height in metres by use, for buildings without a height of their own.
BASE_HEIGHT = {"commercial": 16.0, "industrial": 11.0}


def unit_fnv(text: Column) -> Column:
    """The 32-bit FNV-1a hash of an ASCII text's characters as a number in [0, 1), to five digits."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF))
    h = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(FNV_START).cast("long"), step)
    return h % 100000 / F.lit(100000.0)


def building_height(height: Column, floors: Column, use: Column, area_m2: Column, seed: Column) -> Column:
    """The given height, else floors at 3.6 m, else an estimate from use, footprint and a stable jitter."""
    base = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in BASE_HEIGHT.items() for x in (F.lit(k), F.lit(v))]), use), F.lit(7.0))
    estimate = clamp((base + F.lit(0.72) * F.sqrt(F.greatest(F.lit(0.0), F.coalesce(area_m2, F.lit(0.0))))) * (F.lit(0.78) + F.lit(0.55) * unit_fnv(seed)), 6.0, 150.0)
    return F.coalesce(F.when(height.isNotNull(), F.greatest(F.lit(3.0), height)), F.floor(floors) * 3.6, estimate)


def flood_depth(ratio: Column, extra_m: Column, ground: Column, cell_ground: Column) -> Column:
    """Metres of water on ``ground`` when the cell's level has risen by the discharge ratio and extra depth."""
    rise = F.greatest(F.lit(0.0), ratio - 1) * 2.5 + F.coalesce(extra_m, F.lit(0.0))
    return F.greatest(F.lit(0.0), cell_ground + rise - ground)


def bivariate_class(x: Column, y: Column, low: float = 40.0, high: float = 70.0) -> Column:
    """0 to 8, y in threes and x within; null if either is."""
    part = lambda v: band(v, [(low, 0), (high, 1)], 2, op="<")
    return (part(y) * 3 + part(x)).cast("int")


def relative_elevation(centre: Column, around: Column) -> Column:
    """``struct(relative, low_lying)`` against the valid samples around; null without a centre or any of them."""
    valid = F.filter(around, lambda v: v.isNotNull())
    mean = F.aggregate(valid, F.lit(0.0), lambda a, v: a + v) / F.size(valid)
    return F.when(centre.isNotNull() & (F.size(valid) > 0), F.struct((centre - mean).alias("relative"), (centre < mean - 2).alias("low_lying")))


def junction_severity(degree: Column, arterials: Column, has_trunk: Column) -> Column:
    return (
        F.when((degree >= 6) | (arterials >= 2) & has_trunk, "CRITICAL").when((arterials >= 2) | (degree >= 5), "HIGH")
        .when(arterials >= 1, "MEDIUM").otherwise("LOW")
    )


def corridor_level(traffic_s: Column, static_s: Column) -> tuple[Column, Column]:
    """Ratio to the free travel time to two digits, and its level."""
    ratio = F.when(static_s > 0, traffic_s / static_s).otherwise(F.lit(1.0))
    return F.round(ratio, 2), band(ratio, [(1.1, "FREE_FLOW"), (1.3, "LIGHT"), (1.6, "MODERATE"), (2.0, "HEAVY")], "SEVERE", op="<")


def verdict(before: Column, after: Column, less_is_better: Column) -> Column:
    return F.when(after == before, "SAME").when((after < before) == less_is_better, "BETTER").otherwise("WORSE")


def valid_weights(weights: Column, allowed: list[str]) -> Column:
    """Entries of a ``map<string,double>`` for known scores, finite and not 0, held to [-1, 1]; null if none is left."""
    ok = F.map_filter(weights, lambda k, v: k.isin(allowed) & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & (v != 0))
    held = F.transform_values(ok, lambda _, v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)))
    return F.when(F.size(ok) > 0, held)


def primary_score(weights: Column) -> Column:
    """The score of the largest weight by magnitude, the first in code-point order on a tie."""
    entries = F.transform(F.map_entries(weights), lambda e: F.struct((-F.abs(e["value"])).alias("w"), e["key"].alias("k")))
    return F.get(F.array_sort(entries), F.lit(0))["k"]


def eight_day_period(day: Column) -> Column:
    """The start of the eight-day period of the year that a date falls in."""
    return F.date_add(F.trunc(day, "YEAR"), (F.floor((F.dayofyear(day) - 1) / 8) * 8).cast("int"))


def decade(year: Column) -> Column:
    return F.when((year > 1800) & (year <= 2030), F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s")))
