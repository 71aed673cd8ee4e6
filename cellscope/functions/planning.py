"""Planning models as column expressions: carbon, efficiency, emergency readiness, parallel pairs, census, tiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import clamp

# What each intervention adds to which score.
INTERVENTIONS = {
    "add_hospital": {"healthcare_access": 25, "safety": 10, "livability": 8},
    "add_school": {"education_score": 30, "livability": 10, "population_proxy": 5},
    "add_park": {"green": 20, "livability": 12, "noise_estimate": 8, "walkability": 5},
    "add_metro": {"connectivity": 35, "walkability": 15, "commercial": 10, "investment": 20},
    "add_ev": {"digital_readiness": 15, "infra_maturity": 10, "investment": 5},
    "add_market": {"commercial": 25, "food_diversity": 15, "entertainment_score": 10},
    "widen_road": {"connectivity": 20, "walkability": -5, "noise_estimate": -10, "commercial": 5},
    "plant_trees": {"green": 15, "noise_estimate": 10, "livability": 5},
}


def _or0(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def _up_to(x: Column, full: float, points: float) -> Column:
    """Points in proportion to x, all of them from ``full`` on."""
    return F.least(_or0(x) / full, F.lit(1.0)) * points


def _score(x: Column) -> Column:
    return F.floor(clamp(x, 0.0, 100.0) + 0.5)


def carbon(buildings: Column, roads: Column, commercial: Column, industry: Column, green: Column) -> Column:
    return _score(_up_to(buildings, 50, 30) + _up_to(roads, 20, 25) + _or0(commercial) / 100 * 20 + _up_to(industry, 3, 15) - _or0(green) / 100 * 25)


def efficiency(buildings: Column, green: Column, commercial: Column) -> Column:
    return _score(F.lit(25.0) + _up_to(buildings, 30, 25) + F.greatest(F.lit(0.0), F.lit(100.0) - _or0(green)) / 100 * 25 + _or0(commercial) / 100 * 25)


def readiness(hospitals: Column, fire: Column, police: Column, connectivity: Column) -> Column:
    has = lambda x, points: F.when(x > 0, float(points)).otherwise(0.0)
    return F.least(F.lit(100.0), has(hospitals, 30) + has(fire, 30) + has(police, 20) + _or0(connectivity) * 0.2)


def intervene(scores: Column, kind: str) -> Column:
    """The ``map<string,double>`` of scores after an intervention, held to 0 to 100; scores it lacks start at 0."""
    effect = INTERVENTIONS[kind]
    added = F.create_map(*[x for k, v in effect.items() for x in (F.lit(k), F.lit(float(v)))])
    rest = F.map_filter(added, lambda k, _: ~F.map_contains_key(scores, k))
    moved = F.transform_values(F.map_concat(scores, rest), lambda k, v: v + F.when(F.map_contains_key(scores, k), F.coalesce(F.try_element_at(added, k), F.lit(0.0))).otherwise(0.0))
    return F.transform_values(moved, lambda _, v: clamp(v, 0.0, 100.0))


def pair_score(major_a: Column, major_b: Column, length_a: Column, length_b: Column, apart_m: Column, old_city: Column, two_way: Column) -> Column:
    """How well two parallel roads would serve as a one-way pair."""
    points = lambda x, p: F.when(x, float(p)).otherwise(0.0)
    return points(major_a, 30) + points(major_b, 30) + F.least(length_a / 50 + length_b / 50, F.lit(40.0)) / 2 + points(apart_m.between(80, 250), 20) + points(old_city, 15) + points(two_way, 10)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, 2))


def unit_fraction(v: Column, largest: Column) -> Column:
    """A cell of a fraction raster, given in percent if its largest value says so; not-a-number counts 0."""
    held = F.when(F.isnan(v) | v.isNull(), 0.0).otherwise(F.when(largest > 1.5, v / 100).otherwise(v))
    return clamp(held, 0.0, 1.0)


def covering_tiles(x: Column, y: Column, zoom: int, buffer: float = 0.05) -> Column:
    """``array<struct<z,x,y>>``: tiles whose buffered square holds a point given in fractions of the world."""
    n = 2**zoom
    span = lambda v: F.sequence(F.greatest(F.lit(0), F.floor(v * n - buffer)).cast("long"), F.least(F.lit(n - 1), F.floor(v * n + buffer)).cast("long"))
    return F.flatten(F.transform(span(x), lambda a: F.transform(span(y), lambda b: F.struct(F.lit(zoom).alias("z"), a.alias("x"), b.alias("y")))))


def world_x(lon: Column) -> Column:
    return (lon + 180) / 360


def world_y(lat: Column) -> Column:
    """Web Mercator, 0 in the north."""
    s = F.sin(F.radians(lat))
    return F.lit(0.5) - F.log((F.lit(1.0) + s) / (F.lit(1.0) - s)) / (4 * 3.141592653589793)
