"""Metrics and forms of a building stock as column expressions over grouped counts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Assumed footprint in square metres, and urban forms by local climate zone.
FOOTPRINT_M2 = 120.0
FORMS = {
    1: "Dense Urban Core", 2: "Dense Urban Core", 3: "Dense Urban Core", 4: "Open Urban", 5: "Open Urban", 6: "Open Urban",
    7: "Informal Settlement", 8: "Commercial / Warehouse", 9: "Peri-Urban", 10: "Industrial Zone",
}


def disc_area(radius_m: float) -> float:
    return math.pi * radius_m * radius_m


def density_per_ha(n: Column, radius_m: float) -> Column:
    return F.round(n / F.lit(disc_area(radius_m) / 10000), 1)


def floor_space_index(n: Column, levels: Column, radius_m: float) -> Column:
    """Floor area over disc area; stocks without known levels count 1.5."""
    known = F.when(levels > 0, levels).otherwise(F.lit(1.5))
    return F.round(n * F.lit(FOOTPRINT_M2) * known / F.lit(disc_area(radius_m)), 2)


def ground_coverage(n: Column, radius_m: float) -> Column:
    return F.round(F.least(F.lit(1.0), n * F.lit(FOOTPRINT_M2) / F.lit(disc_area(radius_m))), 3)


def diversity(counts: Column) -> Column:
    """Shannon entropy of an array of counts as a share of its maximum, 0 to 100; 0 without any."""
    held = F.filter(counts, lambda v: v > 0)
    total = F.aggregate(held, F.lit(0.0), lambda a, v: a + v)
    bits = F.aggregate(held, F.lit(0.0), lambda a, v: a - v / total * F.log2(v / total))
    return F.when(F.size(held) > 0, F.round(F.least(F.lit(100.0), bits / F.log2(F.greatest(F.lit(2), F.size(held))) * 100), 0)).otherwise(F.lit(0.0))


def verticality(levels: Column) -> Column:
    return F.when(levels > 0, F.round(F.least(F.lit(100.0), levels / 5 * 100), 0)).otherwise(F.lit(0.0))


def modern_share(recent: Column, aged: Column) -> Column:
    return F.when(aged > 0, F.round(recent / aged * 100, 0))


def urban_form(n: Column, levels: Column, zone: Column) -> Column:
    known = F.try_element_at(F.create_map(*[x for k, v in FORMS.items() for x in (F.lit(k), F.lit(v))]), zone)
    rise = F.when(levels >= 5, "High-Rise Zone").when(levels >= 3, "Mid-Rise Zone").when(n > 50, "Dense Low-Rise").otherwise("Low-Density")
    return F.when(F.coalesce(n, F.lit(0)) == 0, "Undeveloped").otherwise(F.coalesce(known, rise))


def orientation(ring: Column) -> Column:
    """Degrees in [0, 180) of the longest edge of ``array<struct<x,y>>``, the first on ties; 0 under three points."""
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct((b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy")))
    long2 = lambda e: e["dx"] * e["dx"] + e["dy"] * e["dy"]
    zero = F.struct(F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    best = F.aggregate(edges, zero, lambda a, e: F.when(long2(e) > long2(a), e).otherwise(a))
    return F.when(F.size(ring) >= 3, F.pmod(F.degrees(F.atan2(best["dy"], best["dx"])), F.lit(180.0))).otherwise(F.lit(0.0))


def vertex_mean(ring: Column) -> Column:
    """``struct(x, y)``: the mean of the vertices; (0, 0) for an empty ring."""
    n = F.greatest(F.size(ring), F.lit(1))
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[k]) / n
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def dxf_ring(ring: Column, layer: str, thickness: Column) -> Column:
    """A closed polyline as group-code and value lines; null for rings of one point or none."""
    points = F.flatten(F.transform(ring, lambda p: F.array(F.lit("10"), p["x"].cast("string"), F.lit("20"), p["y"].cast("string"))))
    high = F.when(thickness > 0, F.array(F.lit("39"), thickness.cast("string"))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.lit("0"), F.lit("LWPOLYLINE"), F.lit("8"), F.lit(layer), F.lit("90"), F.size(ring).cast("string"), F.lit("70"), F.lit("1"))
    return F.when(F.size(ring) >= 2, F.concat_ws("\n", F.concat(head, high, points)))
