"""Score models as column expressions: growth, heat, runoff, traffic, transit, mobility, air, scenarios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import band, clamp, half_up_int, let, norm_log, piecewise

# Weights of the growth horizons for built-up expansion, densification and capital.
HORIZONS = {"nowcast": (0.4, 0.3, 0.3), "year_2": (0.2, 0.2, 0.6), "year_5": (0.4, 0.3, 0.3)}
# Relative road capacity by class.
CAPACITY = {
    "motorway": 1.0, "motorway_link": 0.8, "trunk": 0.9, "trunk_link": 0.7, "primary": 0.75, "primary_link": 0.55, "secondary": 0.55, "secondary_link": 0.45,
    "tertiary": 0.4, "tertiary_link": 0.35, "unclassified": 0.3, "residential": 0.25, "living_street": 0.15, "service": 0.15, "track": 0.1,
}
# The capacity of any other class, and the upper ends of the service levels.
DEFAULT_CAPACITY = 0.3
LOS_CUTS = [(0.35, "A"), (0.55, "B"), (0.75, "C"), (0.9, "D"), (1.0, "E")]
# Fixed values: (low, high, index low, index high) of the air quality bands.
PM25 = [(0, 30, 0, 50), (30, 60, 51, 100), (60, 90, 101, 200), (90, 120, 201, 300), (120, 250, 301, 400), (250, 500, 401, 500)]
PM10 = [(0, 50, 0, 50), (50, 100, 51, 100), (100, 250, 101, 200), (250, 350, 201, 300), (350, 430, 301, 400), (430, 600, 401, 500)]


# The numbers in the three sub-scores below are fixed values of the growth model.
def built_up_expansion(last: Column, prev: Column, height_delta: Column, construction: Column) -> Column:
    yoy = F.when(prev > 0, (last - prev) / prev * 100).otherwise(F.lit(0.0))
    boost = F.least(F.lit(10.0), F.coalesce(construction, F.lit(0)) * 2.0)
    score = F.lit(50.0) + F.lit(25.0) * F.tanh(yoy / 8) + F.lit(15.0) * F.tanh(F.coalesce(height_delta, F.lit(0.0))) + boost
    return F.when(last.isNotNull() & prev.isNotNull(), clamp(score, 0.0, 100.0))


def densification(pop_5yr_pct: Column, commercial: Column) -> Column:
    return F.when(pop_5yr_pct.isNotNull(), clamp(F.lit(50.0) + F.lit(25.0) * F.tanh(pop_5yr_pct / 15) + F.least(F.lit(15.0), F.coalesce(commercial, F.lit(0.0)) / 8), 0.0, 100.0))


def capital_flow(projects: Column) -> Column:
    """``array<struct<value, age, km>>``: null if the source is missing, 0 if there are none."""
    weighted = F.aggregate(projects, F.lit(0.0), lambda a, p: a + F.coalesce(p["value"], F.lit(0.0)) * F.exp(-p["age"] / 2) * F.exp(-p["km"] / 1.5))
    return F.when(projects.isNotNull(), norm_log(weighted, 500_000_000.0))


def horizon(bue: Column, den: Column, cap: Column, name: str) -> Column:
    """Weighted mean of the parts that are there, weights scaled to them; null without any."""
    parts = list(zip((bue, den, cap), HORIZONS.get(name, HORIZONS["nowcast"]), strict=True))
    total = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts), F.lit(0.0))
    value = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return F.when(total > 0, half_up_int(value / total))


def emerging_class(level: Column, slope: Column, hot: float = 60.0, eps: float = 0.5) -> Column:
    s = F.coalesce(slope, F.lit(0.0))
    high, rising, falling = level >= hot, s > eps, s < -eps
    return (
        F.when(level.isNull(), F.lit(None)).when(high & rising, "intensifying").when(high & falling, "diminishing").when(high, "persistent")
        .when(rising, "emerging").when(falling, "cooling").otherwise("stable")
    )


def lst_celsius(raw: Column) -> Column:
    """Kelvin times 50 to Celsius; 0 is no data."""
    return F.when(raw != 0, raw / 50.0 - 273.15)


def heat_island(cell: Column, around: Column) -> Column:
    return clamp(half_up_int((cell - around + 2) * 12), 0, 100).cast("int")


def runoff_mm(rain: Column, curve_number: Column) -> Column:
    """Runoff depth for a rainfall by the curve-number method; 0 below the initial abstraction."""
    s = F.lit(25400.0) / curve_number - 254
    excess = rain - s * 0.2
    return F.when((rain > 0) & (curve_number > 0) & (excess > 0), excess * excess / (excess + s)).otherwise(F.lit(0.0))


def capacity_of(road_class: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in CAPACITY.items() for x in (F.lit(k), F.lit(v))]), road_class), F.lit(DEFAULT_CAPACITY))


def level_of_service(ratio: Column) -> Column:
    return band(ratio, LOS_CUTS, "F")


def congestion_risk(ratio: Column) -> Column:
    return F.bround(clamp(ratio, 0.0, 1.0) * 100, 0).cast("int")


def criticality(betweenness: Column, bridge: Column) -> Column:
    return F.when(bridge & (betweenness > 0.01), "critical").when(bridge | (betweenness > 0.01), "high").when(betweenness > 0.005, "medium").otherwise("low")


def mobility_risk(police_km: Column, chokepoint: Column, sealable: Column, road_m: Column, cell_m: float = 200.0, cap_km: float = 5.0) -> Column:
    police = F.least(F.lit(1.0), F.coalesce(police_km, F.lit(cap_km)) / cap_km)
    sparse = F.lit(1.0) - F.least(F.lit(1.0), F.coalesce(road_m, F.lit(0.0)) / (cell_m * 2))
    raw = police * 35 + chokepoint.cast("int") * 25 + sealable.cast("int") * 20 + sparse * 20
    return F.bround(clamp(raw, 0.0, 100.0), 0).cast("int")


def access_class(risk: Column, sealable: Column) -> Column:
    return F.when(risk.isNull(), F.lit(None)).when(sealable | (risk >= 66), "Restricted").when(risk >= 40, "Constrained").otherwise("Smooth")


def transit_access(headway_min: Column, routes: Column) -> Column:
    frequency = F.when(headway_min.isNull(), F.lit(10.0)).otherwise(clamp(F.lit(100.0) - (headway_min - 5) * 4.0, 0.0, 100.0))
    return F.bround(F.least(F.lit(100.0), frequency * 0.8 + F.least(F.lit(20.0), F.coalesce(routes, F.lit(0)) * 5.0)), 0).cast("int")


def coverage_access(stops: Column) -> Column:
    return F.when(stops > 0, F.least(F.lit(100), stops * 25)).otherwise(F.lit(0)).cast("int")


def aqi(pm25: Column, pm10: Column) -> Column:
    """The worse of the two sub-indices that are known."""
    return F.greatest(piecewise(pm25, PM25, 500), piecewise(pm10, PM10, 500))


def scenario(kind: str, p: Column, anchor_km: Column, flood: Column, road: Column) -> Column:
    """Growth probability under a planning scenario: a transit hub, flood protection, or curbed sprawl."""
    if kind == "transit_hub":
        out = F.when(anchor_km.isNotNull(), p + F.lit(25.0) * clamp(F.lit(1.0) - anchor_km / 3, 0.0, 1.0)).otherwise(p)
    elif kind == "protect_flood":
        out = F.when(flood >= 60, p * 0.4).when(flood >= 40, p * 0.7).otherwise(p)
    elif kind == "curb_sprawl":
        out = F.when(road < 50, p * 0.5).when(road < 150, p * 0.8).otherwise(p)
    else:
        out = p
    return half_up_int(clamp(out, 0.0, 100.0))


def crowd_capacity(width_m: Column, length_m: Column) -> tuple[Column, Column]:
    """People per minute past a point and people standing, on three quarters of the width."""
    usable = width_m * 0.75
    return (usable * 82.0).alias("flow_per_min"), (usable * length_m * 2.0).alias("standing")


def parking_pressure(demand: Column, supply: Column, bus: Column, weight: Column) -> Column:
    return F.greatest(F.lit(0.0), (demand * 15 - supply * 10 + bus * 5) * weight)


def hotspot_score(vehicles: Column, speed: Column, limit: Column, waiting: Column, loss: Column, occupancy: Column) -> Column:
    """Congestion of an edge: slowness against its limit, waiting and lost seconds per vehicle and occupancy, by volume; one digit."""
    slow = F.greatest(F.lit(0.0), F.lit(1.0) - F.when(limit > 0, speed / limit).otherwise(F.lit(1.0)))
    each = lambda total: F.when(vehicles > 0, total / vehicles).otherwise(F.lit(0.0))
    level = slow * 40 + F.least(each(waiting), F.lit(30.0)) * 1.5 + F.least(each(loss), F.lit(60.0)) * 0.8 + occupancy * 20
    return F.round(level * F.least(vehicles / 50, F.lit(2.0)), 1)


def discharge_risk(ratio: Column) -> Column:
    """Bands of a day's discharge against day 0, strict at the cuts."""
    return band(ratio, [(1.2, "normal"), (2.0, "elevated"), (4.0, "high"), (6.0, "severe")], "extreme", op="<")


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); 0 where both are 0. Vegetation, water and built-up indices are this of two bands."""
    return F.when(a + b == 0, F.lit(0.0)).otherwise((a - b) / (a + b))


def growth_horizons(bue: Column, den: Column, cap: Column, trend: Column, expansion: Column) -> Column:
    """A cell's growth record, null without any sub-score: now, in two and in five years, each with a band. Each part is worked out once.

    Five years on, the composite follows ``num.trend`` (may be null) of built-up
    presence, and moves up to 20 towards what ``expansion`` (0 to 1, may be null) projects.
    """
    parts = F.struct(bue.alias("bue"), den.alias("den"), cap.alias("cap"), trend.alias("trend"), expansion.alias("expansion"))
    return let(parts, lambda p: _growth_record(p["bue"], p["den"], p["cap"], p["trend"], p["expansion"]))


def _growth_record(bue: Column, den: Column, cap: Column, trend: Column, expansion: Column) -> Column:
    arrow = lambda s: F.when(s.isNull(), "none").when(s > 60, "up").when(s > 45, "level").otherwise("down")
    now, two = horizon(bue, den, cap, "nowcast"), horizon(bue, den, cap, "year_2")
    r2 = trend["r2"]
    ahead = F.when(trend.isNotNull(), clamp(now + trend["slope"] * 5 * 200, 0.0, 100.0)).otherwise(now.cast("double"))
    moved = half_up_int(clamp(ahead + (clamp(expansion, 0.0, 1.0) - 0.5) * 2 * 20, 0.0, 100.0)).cast("double")
    five = half_up_int(F.when(expansion.isNotNull(), moved).otherwise(ahead))
    wide = F.greatest(F.lit(10), half_up_int(25 * (1 - F.when(r2 >= 0, r2).otherwise(F.lit(0.0)))).cast("int"))
    record = F.struct(
        now.alias("now"), F.lit(5).alias("now_band"), two.alias("year_2"), F.lit(10).alias("year_2_band"), five.cast("int").alias("year_5"), wide.alias("year_5_band"),
        arrow(bue).alias("bue"), arrow(den).alias("den"), arrow(cap).alias("cap"),
    )
    return F.when(bue.isNotNull() | den.isNotNull() | cap.isNotNull(), record)


RING = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def heat_ring(lat: Column, lon: Column, degrees: float = 0.09) -> Column:
    """The eight points around a place, about ten kilometres off, as ``array<struct<lat, lon>>``."""
    across = F.lit(degrees) / F.cos(F.radians(lat))
    return F.array(*[F.struct((lat + dy * degrees).alias("lat"), (lon + dx * across).alias("lon")) for dy, dx in RING])
